import zlib

import numpy as np
import pytest

from tideglass.llm import quality as q

DATA = "/root/testdata/sf0.01"


def slow_features(text):
    """Every n-gram and word of one text, by loops."""
    padded = " " + text + " "
    mask = (1 << 64) - 1
    blank = [c.isspace() or ord(c) <= 32 for c in padded]
    codes = [32 if b else ord(c) for c, b in zip(padded, blank)]
    out = []
    for n in q.GRAMS:
        for i in range(len(codes) - n + 1):
            if not any(blank[i + 1 : i + n - 1]):
                h = 0
                for c in codes[i : i + n]:
                    h = (h * 0x100000001B3 + c + 1) & mask
                out.append((((h ^ n) * 0x9E3779B97F4A7C15) & mask) >> (64 - q.BUCKETS.bit_length() + 1))
    words = text.split()
    out += [back for back in (1, 2) for i in range(back, len(words)) if words[i] == words[i - back]]
    return sorted(out), len(words)


@pytest.mark.parametrize("text", ["", "a", "ab cd", " x  yy\nzzz ", "é日本語 ok" * 3, "a a b a b b b c"])
def test_features_equal_loops(text):
    grams, words = slow_features(text)
    found = [b for _, bs in q.batches_of_features([text]) for b in bs.tolist()]
    assert len(found) == len(grams) + words
    left = list(found)
    for g in grams:
        left.remove(g)
    assert len(left) == words


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    model = q.Model(rng.normal(size=q.BUCKETS), 0.3)
    texts = ["", "one two", "x" * 700_000, "é", "a b c " * 100, " "]
    alone = [float(model.scores([t])[0]) for t in texts]
    assert np.allclose(model.scores(texts), alone, rtol=0, atol=1e-12)
    assert alone[0] == pytest.approx(1 / (1 + np.exp(-0.3))) or len(list(q.batches_of_features([""]))) > 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in q.report(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    truth = [(found[r.doc_id], r.quality) for r in labels.collect()]
    held = [(r.predicted, y) for r, y in truth if r.held_out]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95
    again = {r.doc_id: r.score for r in q.report(docs, labels).collect()}
    assert all(again[k] == r.score for k, r in found.items())


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", "x"), (1, "good words here", "x"), (2, None, None), (None, "bad $$$", "y"), (3, "", "z"), (4, "bad $$$ %%%", "z")],
        "doc_id bigint, text string, quality string",
    )
    kinds = "doc_id bigint, quality int, text string"
    labels = spark.createDataFrame([(1, 1, "x"), (4, 0, "y"), (4, 0, "y"), (2, None, None), (None, 1, None), (99, 1, "q")], kinds)
    rows = q.report(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in q.report(docs, labels.limit(0)).collect()} == {1}
    assert q.report(docs.limit(0), labels).collect() == []
    kept = q.accepted(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 6
