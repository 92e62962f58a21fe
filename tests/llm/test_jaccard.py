import random

import numpy as np
import pytest

from tideglass.llm import jaccard


def words(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return (text or "").encode().translate(lower).split()


def plain_set(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def plain(rows, percent=80):
    """Every pair compared, components by union-find."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return sorted(((k, len(sets[i]), low.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, node string")
    return sorted(map(tuple, jaccard.report(docs).collect()), key=repr)


def test_sets_are_exact():
    texts = ["", "a", "a b c d", "a b c d e", "A b\tC d e\x0bf", "é é é é é é é", "a  b\n c d e f a b c d e f", "x" * 5000]
    for text, tokens in zip(texts, jaccard.shingle_sets([t.encode() for t in texts]), strict=True):
        assert len(tokens) == len(plain_set(text))
    alone = [jaccard.shingle_sets([t.encode()])[0].tolist() for t in texts]
    assert alone == [s.tolist() for s in jaccard.shingle_sets([t.encode() for t in texts])]


def test_structured_words_do_not_meet(spark):
    """A word of 1,024 letters that sums of powers cannot tell from its complement."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word[:64]), (4, other[:64]), (5, word.upper())]
    assert found(spark, rows) == plain(rows)
    data = " ".join(f"{c * n}{d}" for n in range(70) for c in "ab" for d in "xyz").encode()
    assert len(set(jaccard.word_hashes(data)[0].tolist())) == len(set(data.split()))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9, 10, 17, 40, 101])
def test_pool_demand_is_met_by_any_similar_pair(n):
    rng = np.random.default_rng(n)
    for _ in range(200):
        m = int(rng.integers(jaccard.least_overlap(n, 80), n * 100 // 80 + 1))
        most = min(n, m)
        overlap = next((k for k in range(most + 1) if 100 * k >= 80 * (n + m - k)), None)
        if overlap is None:
            continue
        pool = rng.permutation(10 * (n + m))
        common, rest = pool[:overlap], pool[overlap:]
        x = np.sort(np.concatenate([common, rest[: n - overlap]]))
        y = np.sort(np.concatenate([common, rest[n - overlap : n - overlap + m - overlap]]))
        a, b = x[: jaccard.pool_length(n, 80)], y[: jaccard.pool_length(m, 80)]
        shared = len(set(a.tolist()) & set(b.tolist()))
        assert shared >= jaccard.pool_demand(n, 80) and shared >= jaccard.pool_demand(m, 80)


def family(rng, base, copies, rates):
    out = []
    for _ in range(copies):
        text = base[:]
        for i in range(len(text)):
            if rng.random() < rng.choice(rates):
                text[i] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed, limit", [(1, 4 << 20), (2, 0), (3, 4 << 20)])
def test_rows_equal_all_pairs(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(jaccard, "SETS_BROADCAST_BYTES", limit)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    passage = rng.choices(vocabulary, k=60)
    for length in (30, 60, 150, 300):
        base = rng.choices(vocabulary, k=length)
        texts += family(rng, base, 25, [0.0, 0.005, 0.01, 0.03, 0.05])
        texts += [" ".join(base[: length - cut]) for cut in range(0, length // 2, max(1, length // 20))]
        texts += [" ".join(base)] * 5
    for _ in range(60):
        own = rng.choices(vocabulary, k=rng.randrange(1, 120))
        texts.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    texts += ["", " \n", None, "a", "A", "a b c", "a b c", "b", "x y z q", " ".join(passage), " ".join(passage).upper()]
    rng.shuffle(texts)
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(40))
    near = same + " tail"
    rows = [(1, same), (1, same), (1, near), (None, near), (None, "only null id has this one here"), (7, None), (7, ""), (9, same + " tail end")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:0]) == []


def test_chain_of_links_is_one_component(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        rows.append((100 - i, " ".join(base[i * 4 : i * 4 + 80])))
    assert found(spark, rows) == plain(rows)


def test_deduplicate(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(2, text, "a"), (1, text + " x", "b"), (3, None, "c"), (4, "", None)], "doc_id bigint, text string, lang string")
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_deduplicate_knows_rows_not_ids(spark):
    text, other, third = (" ".join(f"{c}{i}" for i in range(50)) for c in "wuv")
    rows = [
        (1, text, "a"), (2, text + " x", "near 1"), (2, other, "unique"),
        (5, third, "same"), (5, third, "same"), (None, third + " x", "same"),
        (None, "no id has this text here", "null"), (None, "no id has this text here", "null"),
        (7, "", "empty"), (7, "", "empty"), (None, None, "none"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = sorted(r.lang for r in jaccard.deduplicate(docs).collect())
    assert kept == sorted(["a", "unique", "same", "null", "empty", "empty", "none"])
