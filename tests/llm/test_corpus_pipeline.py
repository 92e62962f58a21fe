import hashlib
import importlib.util
from pathlib import Path

import pytest

import corpus_pipeline
from tideglass.llm import byte_bpe, decontaminate, jaccard, quality, secrets
from tideglass.llm.queries import BYTE_BPE

DATA = "/root/testdata/sf0.001"


def similar_heads(rows):
    """Smallest id of each row's component, every pair compared."""
    sets = {k: set(jaccard.shingle_sets([t.encode()])[0].tolist()) for k, t in rows.items()}
    parent = {k: k for k in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(rows)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k for k in keys if find(k) == k}


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, labels)
    kept = {k: t for k, t in rows.items() if model.scores([t])[0] >= quality.THRESHOLD}
    assert 0 < len(kept) < len(rows)
    kept = {k: kept[k] for k in similar_heads(kept)}
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    tables = decontaminate.compile_items(items, 13)
    clean = {}
    for k, t in kept.items():
        words = decontaminate.words_of(t.encode())
        hit = {i for one in tables for s, _ in one.search(words) for i in range(s, s + one.length)}
        if not hit or 20 * len(hit) < len(words):
            clean[k] = secrets.redact(t)
    wanted = []
    for k, t in clean.items():
        ((joined, ids),) = byte_bpe.encode_texts([t], BYTE_BPE)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        wanted.append((k, len(ids), digest(joined.encode()), digest(t.encode())))
    found = sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()))
    assert found == sorted(wanted)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame(
        [(1, long, "en", "a", 5, "z"), (2, long + " x", "en", None, None, None), (None, None, None, None, None, None), (3, "", "de", "b", 0, "")],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, label string",
    )
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, docs.limit(0)):
        state = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            state = stage(spark, state, str(tmp_path))
            assert state.columns == docs.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, state, str(tmp_path))
        assert last.count() == (3 if start is docs else 0)


def test_entry_works_without_these_folders(tmp_path):
    """A copy of the repository without the pipeline's files still answers."""
    import shutil
    import subprocess
    import sys

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "tideglass", tmp_path / "tideglass", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'top_apps' in q and not any(k.startswith('op1') or k == 'pipeline' for k in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(importlib.util.find_spec("__spark_entry__") is None, reason="not at the top of the repository")
def test_all_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
