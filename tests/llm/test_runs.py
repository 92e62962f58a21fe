import hashlib
import random
import zlib

import pytest

from tideglass.llm import runs


def plain(words, least=6, power=4):
    """Every period tried at every place; a stretch counts under its smallest period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, power * q):
                if not any(words[i : i + length - r] == words[i + r : i + length] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    words = [rng.choice("ab" if rng.random() < 0.5 else "abcdef") for _ in range(rng.randrange(40))]
    for _ in range(rng.randrange(4)):
        period = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        size = rng.randrange(1, 60)
        words[rng.randrange(len(words) + 1) : 0] = (period * size)[:size]
    return [w.encode() for w in words]


@pytest.mark.parametrize("least, power, width", [(6, 4, 4096), (6, 4, 1), (3, 2, 2), (2, 2, 4096), (10, 3, 3)])
def test_runs_equal_all_periods(monkeypatch, least, power, width):
    monkeypatch.setattr(runs, "RANGE", width)
    rng = random.Random(least * 100 + power * 10 + width)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(rng.randrange(6))]
        assert [f.runs for f in runs.find(texts, least, power)] == [plain(t, least, power) for t in texts]


def test_runs_within_runs():
    inner = b"x a a a a a a".split()
    words = inner * 4 + b"y".split()
    (found,) = runs.find([words])
    assert found.runs == plain(words)
    assert {r[2] for r in found.runs} == {1, 7}
    assert found.best() == (1, 6, 1)  # six ones repeat more often than four of seven


def test_tail_and_collapse():
    for key in range(300):
        words = [str(i).encode() for i in range(key % 57)]
        n, h = len(words), zlib.crc32(str(key).encode())
        wanted = words
        if h % 10 == 0 and n:
            g = h // 10
            a, wanted = g % n, list(words)
            p = 1 + (n - a) // (3 + g % 8)
            for i in range(a, n):
                wanted[i] = words[a + (i - a) % p]
        assert runs.periodic_tail(key, words) == wanted
        (found,) = runs.find([wanted])
        dropped = {i for s, length, q in plain(wanted) for i in range(s + q, s + length)}
        assert found.collapsed() == b" ".join(w for i, w in enumerate(wanted) if i not in dropped)


def test_long_single_word_and_long_period():
    (one, two) = runs.find([[b"a"] * 50_000, [str(i % 9_000).encode() for i in range(40_000)]])
    assert one.runs == [(0, 50_000, 1)]
    assert two.runs == [(0, 40_000, 9_000)]


def expected(key, text):
    words = runs.periodic_tail(key, (text or "").encode().split())
    found = plain(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    digest = lambda t: hashlib.sha256(t).hexdigest()
    return (
        key, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()),
        digest(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(1, None, 0), (2, "", 0), (None, "la la la la la la la", 1), (3, " \t\n", 1), (3, "É é É é É é É é\x0bÉ", 1), (3, "É é É é É é É é\x0bÉ", 1)]
    rows += [(k, b" ".join(random_words(rng)).decode(), k) for k in range(4, 80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start bigint")
    found = sorted(map(tuple, runs.report(docs).collect()), key=repr)
    assert found == sorted((expected(k, t) for k, t, _ in rows), key=repr)
    assert runs.report(docs.limit(0)).collect() == []
    listed = sorted(tuple(r)[1:] for r in runs.list_runs(docs.where("doc_id IS NULL")).collect())
    assert listed == [(0, 7, 1)]
    assert runs.collapsed(docs.where("doc_id IS NULL")).first().text == "la"
