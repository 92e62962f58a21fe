import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tideglass.llm import decontaminate as dc

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, items, window=13):
    """Every window tried at every place."""
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    split = lambda t: WORD.findall((t or "").encode().translate(lower))
    wins = []
    for item, text in items:
        words = split(text)
        k = min(window, len(words))
        if item is not None and k:
            wins += [(item, words[i : i + k]) for i in range(len(words) - k + 1)]
    out = []
    for doc, text in docs:
        words = split(text)
        hit, ids = set(), set()
        for item, win in wins:
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    ids.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id bigint, text string, n_words string, item_id int"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )


text = st.lists(st.sampled_from(["a", "b", "A", "c", "é", "1", " ", "-", "ab"]), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(text, max_size=4), st.lists(text, max_size=5), st.integers(1, 4))
def test_tables_equal_plain_search(docs, items, window):
    items = list(enumerate(items))
    tables = dc.compile_items([(i, t.encode()) for i, t in items], window)
    for t in docs:
        words = dc.words_of(t.encode())
        hit, ids = set(), set()
        for one in tables:
            for start, found in one.search(words):
                hit.update(range(start, start + one.length))
                ids.update(found)
        ((_, n, n_hit, n_ids, _, _),) = plain([(0, t)], items, window)
        assert (len(words), len(hit), len(ids)) == (n, n_hit, n_ids)


def test_rows(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [
        (1, f"x {passage} y"), (1, f"x {passage} y"), (None, passage.upper()), (2, None), (3, ""), (4, "z " * 9000 + passage),
        (5, "w0 w1 w2"), (6, "short ITEM, here"), (7, " ".join(f"w{i}" for i in range(12)) + " other"),
    ]
    items = [(10, passage), (9, passage), (9, passage), (11, "short item"), (12, None), (13, " ,"), (None, "other")]
    d, i = frames(spark, docs, items)
    found = sorted(map(tuple, dc.report(d, i).collect()), key=repr)
    assert found == plain(docs, items)
    blocks = sorted(map(tuple, dc.report(d, i, block_bytes=40).collect()), key=repr)
    assert blocks == found
    kept = dc.clean(d, i)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 7]
    assert {r.n_items for r in dc.report(d, i.limit(0)).collect()} == {0}
    assert dc.report(d.limit(0), i).count() == 0
