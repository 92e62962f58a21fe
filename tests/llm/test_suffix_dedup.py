import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideglass.llm import suffix_dedup as sd

LAST = 1 << 63


def plain(rows, length=100):
    """Every string of every document against all strings that start earlier."""
    listed = sorted({(LAST if k is None else k, t or "") for k, t in rows})
    seen, result = set(), {}
    for key, text in listed:
        data = text.encode()
        cover = bytearray(len(data))
        for s in range(len(data) - length + 1):
            string = data[s : s + length]
            if string in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(string)
        kept = bytes(b for b, c in zip(data, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        result[key, text] = (len(data), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((k, *result[LAST if k is None else k, t or ""]) for k, t in rows), key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, h string")
    return sorted(map(tuple, sd.report(docs).collect()), key=repr)


strings = st.lists(st.lists(st.sampled_from([b"a", b"b", b"ab", b"aaaaaaaaa", b"abcdefgh", b"\0", b"\xff" * 9]), max_size=8).map(b"".join), max_size=12)


@settings(max_examples=500, deadline=None)
@given(strings)
def test_deep_shallow_sort(texts):
    order, common = sd.deep_shallow_sort(texts)
    assert [texts[i] for i in order] == sorted(texts) and sorted(order) == list(range(len(texts)))
    for i in range(1, len(order)):
        assert common[i] == sd.common_prefix(texts[order[i - 1]], texts[order[i]])
    if texts:
        order, common = sd.BlindTrie(texts).sorted()
        assert [texts[i] for i in order] == sorted(texts)
        for i in range(1, len(order)):
            assert common[i] == sd.common_prefix(texts[order[i - 1]], texts[order[i]])


def test_every_string_has_its_anchor():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    text[1000:1400] = text[100:500]
    begins, ends = np.array([0, 1200, 1250]), np.array([1200, 1250, 3000])
    owner, lo, hi, at, h, c = sd.anchor_runs(text, begins, ends)
    starts = [s for a, b in zip(lo, hi) for s in range(a, b + 1)]
    assert starts == [*range(0, 1101), *range(1250, 2901)]
    assert all(a <= p and p + sd.GRAM <= a + sd.LENGTH for a, p in zip(hi, at)) and all(a <= p for a, p in zip(lo, at))
    offset = {}
    for a, b, p in zip(lo, hi, at):
        for s in range(a, b + 1):
            assert offset.setdefault(text[s : s + 100].tobytes(), p - s) == p - s


def random_texts(rng, n):
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(999)}é" for _ in range(400)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(15, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randrange(1, 50))))
        text = " ".join(parts)
        if texts and rng.random() < 0.3:
            text = rng.choice(texts)
            if text and rng.random() < 0.7:
                cut = rng.randrange(len(text))
                text = text[:cut] + "#" + text[cut + rng.randrange(3) :]
        texts.append(text)
    return texts


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 3), (3, 2)])
def test_rows_equal_plain_search(spark, monkeypatch, seed, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    rng = random.Random(seed)
    texts = random_texts(rng, 60)
    texts += ["a" * 99, "a" * 100, "a" * 350, "ab" * 300, "Was " * 120, "x" + "Was " * 80, None, "", "é" * 60, "é" * 60]
    rng.shuffle(texts)
    rows = [(i * 2 - 31, t) for i, t in enumerate(texts)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, text), (5, text), (3, "intro " + text), (None, text), (7, text + " more"), (3, "intro " + text), (9, None), (8, ""), (None, "alone " * 3)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:0]) == []
    one = [(1, "very long " + text + " " + "z" * 200_000 + text)]
    assert found(spark, one) == plain(one)


def test_deep_shallow_sort_of_falling_then_rising_strings():
    texts = [b"%08d" % i for i in [*range(3000, 0, -1), *range(3000, 6000)]] + [b"same" * 300] * 3000
    order, common = sd.deep_shallow_sort(texts)
    assert [texts[i] for i in order] == sorted(texts)
    assert all(common[i] == sd.common_prefix(texts[order[i - 1]], texts[order[i]]) for i in range(1, len(order), 7))


def test_contested_contexts_of_one_document_are_dealt(spark, monkeypatch):
    """One document's lines share a prefix; some lines, whole, come again."""
    monkeypatch.setattr(sd, "BLOCK", 4)
    dealt = []
    original = sd._resolve
    monkeypatch.setattr(sd, "_resolve", lambda contexts: (dealt.append(contexts), original(contexts))[1])
    rng = random.Random(8)
    prefix = "level=info service=frontend host=alpha region=north "
    lines = [prefix + " ".join(str(rng.randrange(10**9)) for _ in range(9)) for _ in range(40)]
    rows = [(1, "\n".join(lines + rng.sample(lines, 5))), (2, "\n".join(rng.sample(lines, 3)) + " end"), (3, "other " + prefix * 2)]
    assert found(spark, rows) == plain(rows)
    (contexts,) = dealt
    counts = contexts.groupBy("h", "block").count().agg({"count": "max"}).first()[0]
    whole = contexts.groupBy("h").count().agg({"count": "max"}).first()[0]
    assert whole > 20 and counts <= max(12, whole // 3)
