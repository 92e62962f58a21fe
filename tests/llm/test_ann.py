import numpy as np
import pytest

from tideglass.llm import ann


def exact(rows, every, k=20):
    out = []
    for q, v in rows:
        if q % every == 0:
            scored = sorted((-float((np.array(x) * np.array(v)).sum()), i) for i, x in rows if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_a_large_shard(clustered):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(8192, 64))
    if clustered:
        rows[:3000] = rows[0] + 0.05 * rng.normal(size=(3000, 64))
    rows *= rng.uniform(0.5, 1.5, (8192, 1))
    norm = float(np.sqrt((rows**2).sum(axis=1).max()))
    shard = ann.Shard(np.arange(8192), rows, norm)
    ids = np.arange(0, 8192, 160)
    found = 0
    for q, (near, scores) in zip(ids, shard.search(ids, rows[ids], 20)):
        truth = (rows * rows[q]).sum(axis=1)
        assert (scores == truth[near]).all() and q not in near
        truth[q] = -np.inf
        found += len(set(near.tolist()) & set(np.argsort(-truth)[:20].tolist()))
    assert found / (20 * len(ids)) >= 0.9


def test_only_open_queries_look_up_wider_windows(monkeypatch):
    rows = np.random.default_rng(4).normal(size=(3000, 16))
    shard = ann.Shard(np.arange(3000), rows, float(np.sqrt((rows**2).sum(axis=1).max())))
    looked, windows = [], shard.windows
    monkeypatch.setattr(shard, "windows", lambda p, w: looked.append(len(p)) or windows(p, w))
    assert len(list(shard.search(np.arange(200), rows[:200], 20))) == 200
    assert looked[0] == 200 and looked[-1] < 200 and looked == sorted(looked, reverse=True)


@pytest.mark.parametrize("count", [5, 3000, 70000])
def test_counts_by_places_are_counts_by_slices(count, monkeypatch):
    rows = np.random.default_rng(5).normal(size=(count, 4))
    shard = ann.Shard(np.arange(count), rows, float(np.sqrt((rows**2).sum(axis=1).max())))
    projected = np.random.default_rng(6).normal(size=(6, ann.PROJECTIONS))
    for lower, higher in zip(*shard.windows(projected, np.array([0.0, 0.1, 0.5, 1.0, 3.0, 9.0]))):
        met = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(shard.order, lower, higher)]), minlength=count)
        for narrow in (0, 10**9):
            monkeypatch.setattr(ann, "NARROW", narrow)
            assert (shard._inside(lower, higher) == met).all()


def recall_of(found, rows, every):
    truth = exact(rows, every)
    scores = {(q, i): s for q, _, i, s in truth}
    assert [(q, r) for q, r, _, _ in found] == [(q, r) for q, r, _, _ in truth]
    vectors = {i: np.array(v) for i, v in rows}
    for q, _, i, s in found:
        assert q != i and s == float((vectors[i] * vectors[q]).sum())
    return sum((q, i) in scores for q, _, i, _ in found) / len(truth)


def test_small_table_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(130, 8)))]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000 + i, [2 * x for x in rows[3][1]]) for i in range(3)]
    found = sorted(map(tuple, ann.nearest(frame(spark, rows), every=20).collect()))
    assert recall_of(found, rows, 20) >= 0.95
    # Of equal vectors the smallest ids are found, in order.
    assert [i for q, _, i, _ in found if q == 1000] == [i for q, _, i, _ in exact(rows, 20) if q == 1000]


@pytest.mark.parametrize("hot", [0, 700])
def test_several_shards_and_blocks(spark, hot):
    rng = np.random.default_rng(9)
    values = rng.normal(size=(2000, 16)) * rng.uniform(0.5, 1.5, (2000, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(values)]
    rows = [(i, rows[5][1] if i % 3 == 0 and i < 3 * hot else v) for i, v in rows]
    near = ann.nearest(frame(spark, rows), every=40, shard_rows=300, query_block=20)
    assert recall_of(sorted(map(tuple, near.collect())), rows, 40) >= 0.95


def test_windows_stand_for_a_distance():
    rng = np.random.default_rng(2)
    for needed in (20, 54, 64):
        half = ann.reach(needed, 64, 0.9)
        met = (np.abs(rng.normal(size=(20000, 64))) < half).sum(axis=1) >= needed
        assert abs(met.mean() - 0.9) < 0.01


def test_odd_rows(spark):
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0]), (3, [-1.0, 0.0])]
    odd = [(None, [1.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [None, 1.0]), (140, []), (160, [1.0, 2.0, 3.0]), (1, [0.5, 0.5])]
    found = sorted(map(tuple, ann.nearest(frame(spark, good + odd), every=20).collect()))
    assert found == exact(good, 20)
    assert ann.nearest(frame(spark, good[:0]), every=20).collect() == []
    assert ann.nearest(frame(spark, good[1:2]), every=20).collect() == []
    assert ann.nearest(frame(spark, good[:1]), every=20).collect() == []
