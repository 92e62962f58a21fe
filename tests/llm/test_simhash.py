import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.llm import simhash


def plain_fingerprint(spark, text):
    """Counts of bits in Spark's own XXH64, one shingle after the other."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    rows = spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g").alias("h")).collect() if grams else []
    values = [r.h % 2**64 for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(rows, distance=4):
    """Every pair of fingerprints compared; smallest id of each component."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return [low.get(find(i)) for i in range(len(rows))]


def test_fingerprints_count_bits(spark):
    texts = ["", " \n", "one", "a b c", "A b\tC d e\x0bf", "é É é É é", "x y z w " * 7, "word " + "q" * 5000]
    for text in texts:
        assert simhash.fingerprint(simhash.shingle_hashes(text.encode())) == plain_fingerprint(spark, text)


def test_spans_do_not_matter(monkeypatch):
    hashes = np.random.default_rng(3).integers(0, 1 << 64, 1000, dtype=np.uint64)
    whole = simhash.fingerprint(hashes)
    monkeypatch.setattr(simhash, "_SPAN", 7)
    assert simhash.fingerprint(hashes) == whole


@pytest.mark.parametrize("bits", range(5))
def test_close_fingerprints_share_a_cell(bits):
    rng = np.random.default_rng(bits)
    ours = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    theirs = np.array([int(a) ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for a in ours], dtype=np.uint64)
    held = []
    for values in (ours, theirs):
        numbers, owners = simhash.cells(values.view(np.int64))
        cells = [set() for _ in values]
        for number, owner in zip(numbers.tolist(), owners.tolist()):
            cells[owner].add(number)
        held.append(cells)
    assert all(a & b for a, b in zip(*held))


@pytest.mark.parametrize("seed, rounds, small", [(1, 3, 256), (2, 1, 1), (3, 2, 8), (4, 0, 1)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, rounds, small):
    monkeypatch.setattr(simhash, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "_PAIRS", 50)
    rng = random.Random(seed)
    values = [0, 1, (1 << 64) - 1, 1 << 63, rng.getrandbits(64)]
    for _ in range(12):
        at = rng.getrandbits(64)
        loose = rng.sample(range(64), 12)
        for _ in range(40):  # a family around one fingerprint
            values.append(at ^ sum(1 << b for b in rng.sample(loose, rng.randrange(6))))
        for _ in range(25):  # a chain that wanders off
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 5])))
            values.append(at)
    values += [rng.getrandbits(64) for _ in range(300)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    heads = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(signed)], "fp bigint, rows bigint")
    labels = {r.fp: r.label for r in simhash.linked(heads).collect()}
    groups = plain_components([(i, v % 2**64) for i, v in enumerate(signed)])
    low = {}
    for value, group in zip(signed, groups, strict=True):
        low[group] = min(low.get(group, value), value)
    assert labels == {v: low[g] for v, g in zip(signed, groups)}


def test_rows(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    rows = [(1, None), (2, ""), (2, ""), (3, " \t"), (None, "no id here at all"), (None, "no id here at all"), (None, "")]
    for base in range(6):
        text = rng.choices(words, k=150)
        for copy in range(8):
            other = list(text)
            for _ in range(rng.randrange(3)):
                other[rng.randrange(150)] = rng.choice(words)
            rows.append((1000 - 10 * base - copy, " ".join(other)))
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, label string, fp int")
    found = sorted(map(tuple, simhash.report(docs).collect()), key=repr)
    prints = [(k, simhash.fingerprint(simhash.shingle_hashes((t or "").encode()))) for k, t in rows]
    wanted = [(k, f"{v:016x}", low) for (k, v), low in zip(prints, plain_components(prints))]
    assert found == sorted(wanted, key=repr)
    assert found.count((2, "0" * 16, 1)) == 2
    assert simhash.report(docs.limit(0)).collect() == []


def test_too_large_a_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.linked(spark.createDataFrame([], "fp bigint, rows bigint"), distance=6)
