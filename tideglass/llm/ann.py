"""Approximate nearest neighbours by collision counting over query-centred windows.

Largest inner product is turned into least distance: every vector gets one more component
that brings it to the greatest norm, a query gets a zero there. Rows are dealt at random to
shards. A shard projects its vectors on `PROJECTIONS` random directions and keeps each
projection as one sorted array. A query opens a window around its own projection in every
array; a vector collides where it lies in the window. Virtual rehashing widens all windows
by one factor and counts only what is new; vectors that have collided in `THRESHOLD` of the
arrays are verified by the exact inner product in double precision. A query's first window
is set by the nearest of every `PILOT`th row of the shard; that saves the narrow windows and
bears on nothing else, as a window that is too wide only means more to verify.

One rule ends the search, in tables of every size: the k-th best of the verified vectors is
no farther than the radius that the window stands for, the distance at which a vector still
collides often enough with probability `FOUND`. So every true neighbour in the shard is met
with that probability or better. Where a shard holds fewer than k others, all collide in the
end and all are returned. Nothing is capped: every vector over the threshold is verified.

Shards and blocks of queries are both bounded tables, met as cogroups: each shard is dealt to
every block and each query to every shard, so no query passes through the driver. A shard
returns the best of each query, and these are merged. Equal vectors are thinned to the
`k + 1` smallest ids first, since no further copy can be in any answer; that is a group
limit ahead of the shuffle, so a vector that makes up a third of all rows stays cheap.

Defined results: vectors that are null, zero, or hold a null or a non-finite component take
no part, nor do rows without id or with another number of components than most; of rows
with one id the smallest vector counts; ties go to the smaller id; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import rows_batch, ship
from tideglass.session import materialise

NEIGHBOURS = 20
PROJECTIONS = 128
THRESHOLD = 0.84
FOUND = 0.9
SHARD_ROWS = 16384
QUERY_BLOCK = 2048
SEED = 5
#: Least first half width of a window, in standard deviations of a projection, and its growth.
WIDTH, GROWTH = 0.5, 1.06
#: Every so many rows of a shard tell where a query's first window begins, as a part of the
#: width that the nearest of them asks for.
PILOT, PILOT_PART = 32, 0.92
#: Windows that hold under this part of all places are counted by their slices.
NARROW = 8
#: Sorted arrays whose places are compared together, so that they stay in a core's cache.
_ARRAYS = 16
#: Queries whose window bounds are looked up together.
_TOGETHER = 256

_ARROW = pa.schema(
    [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
)


def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id` and `embedding` of the rows that take part, one row per id."""
    whole = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists("embedding", lambda x: x != 0)
    kept = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(whole, F.lit(False)))
    one = materialise(kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    sizes = one.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return one.where(F.size("embedding") == (sizes["size"] if sizes else 0))


def directions(size: int, count: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(size, count))


def reach(needed: int, count: int, found: float = FOUND) -> float:
    """Half width, in distances, of the window in which a vector at that distance collides in
    `needed` of `count` arrays with probability `found`.
    """

    def often_enough(half: float) -> float:
        p = math.erf(half / math.sqrt(2))
        return sum(math.comb(count, i) * p**i * (1 - p) ** (count - i) for i in range(needed, count + 1))

    low, high = 0.0, 10.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if often_enough(middle) < found else (low, middle)
    return high


@dataclass
class Asked:
    """A query and how far its search has come: its window's bounds, how often each vector has
    collided, which are over the threshold, and their rough products.
    """

    id: int
    vector: np.ndarray
    length: float
    lower: list | None = None
    higher: list | None = None
    hits: np.ndarray | None = None
    found: np.ndarray | None = None
    rough: np.ndarray | None = None


class Shard:
    """Sorted projections of a bounded set of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float) -> None:
        self.ids, self.vectors, self.norm = ids, vectors, norm
        self.rough = vectors.astype(np.float32)
        rest = np.sqrt(np.maximum(0, norm**2 - (vectors**2).sum(axis=1)))
        self.directions = directions(vectors.shape[1] + 1)
        values = (np.column_stack([vectors, rest]) / norm) @ self.directions
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.values = np.take_along_axis(values.T, self.order, axis=1)
        # Each vector's place in each sorted array; places below 2**16 are compared faster.
        self.places = np.empty(self.order.shape, dtype=np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, self.order, np.arange(len(ids), dtype=self.places.dtype)[None, :], axis=1)
        self._gaps = np.empty((_ARRAYS, len(ids)), dtype=self.places.dtype)
        self._within = np.empty((_ARRAYS, len(ids)), dtype=bool)
        self.needed = math.ceil(THRESHOLD * PROJECTIONS)
        self.reach = reach(self.needed, PROJECTIONS)
        self.verified = 0

    def windows(self, projected: np.ndarray, widths: np.ndarray) -> tuple[list, list]:
        """Bounds of each query's window in each sorted array."""
        low = [np.searchsorted(v, p - widths) for v, p in zip(self.values, projected.T)]
        high = [np.searchsorted(v, p + widths) for v, p in zip(self.values, projected.T)]
        return np.array(low).T.tolist(), np.array(high).T.tolist()

    def starts(self, query_ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """First half width of each query's window."""
        products = queries @ self.vectors[::PILOT].T / np.sqrt((queries**2).sum(axis=1))[:, None]
        products[query_ids[:, None] == self.ids[::PILOT]] = -self.norm
        distance = np.sqrt(np.maximum(0, 2 - 2 * products.max(axis=1) / self.norm))
        return np.maximum(WIDTH, PILOT_PART * self.reach * distance)

    def _met(self, slices: list) -> np.ndarray:
        """How often each vector stands in slices of the sorted arrays."""
        return np.bincount(np.concatenate(slices), minlength=len(self.ids)).astype(np.uint8)

    def _inside(self, lower: list, higher: list) -> np.ndarray:
        """How often each vector stands in the windows: by their slices where these are narrow,
        else by each vector's places.
        """
        if NARROW * (sum(higher) - sum(lower)) < self.order.size:
            return self._met([o[a:b] for o, a, b in zip(self.order, lower, higher)])
        kind = self.places.dtype
        begin = np.array(lower, dtype=kind)[:, None]
        width = np.array(higher, dtype=kind)[:, None] - begin
        hits = np.zeros(len(self.ids), dtype=np.uint8)
        for first in range(0, PROJECTIONS, _ARRAYS):
            part = slice(first, first + _ARRAYS)
            many = len(begin[part])
            # Unsigned: a place ahead of the window wraps around to beyond its width.
            gap = np.subtract(self.places[part], begin[part], out=self._gaps[:many])
            inside = np.less(gap, width[part], out=self._within[:many])
            hits += np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
        return hits

    def widen(self, asked: Asked, width: float, lower: list, higher: list, k: int) -> bool:
        """Widen a query's window to these bounds; whether its search is over."""
        if asked.hits is None:
            asked.hits = self._inside(lower, higher)
            asked.rough = np.full(len(self.ids), np.nan, dtype=np.float32)
        else:
            asked.hits += self._met(
                [o[a:b] for o, a, b in zip(self.order, lower, asked.lower)]
                + [o[a:b] for o, a, b in zip(self.order, asked.higher, higher)]
            )
        asked.lower, asked.higher = lower, higher
        found = np.flatnonzero(asked.hits >= self.needed)
        whole = len(found) == len(self.ids)
        if len(found) <= k and not whole:
            return False
        asked.found = found = found[self.ids[found] != asked.id]
        fresh = found[np.isnan(asked.rough[found])]
        asked.rough[fresh] = self.rough[fresh] @ asked.vector.astype(np.float32)
        if whole:
            return True
        rough = asked.rough[found]
        best = float(np.partition(rough, len(rough) - k)[len(rough) - k])
        distance = math.sqrt(max(0.0, 2 - 2 * best / (self.norm * asked.length)))
        return distance * self.reach <= width

    def best(self, asked: Asked, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k verified vectors."""
        near, rough = asked.found, asked.rough[asked.found]
        self.verified += len(near)
        # Single precision settles all but a few; its error is far below the slack.
        if len(rough) > k:
            slack = 1e-4 * self.norm * asked.length
            near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack]
        # A sum per row, so equal vectors get equal scores wherever they stand.
        scores, ids = (self.vectors[near] * asked.vector).sum(axis=1), self.ids[near]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """For each query the ids and scores of its best k verified vectors."""
        for begin in range(0, len(queries), _TOGETHER):
            part = slice(begin, begin + _TOGETHER)
            lengths = np.sqrt((queries[part] ** 2).sum(axis=1))
            turned = queries[part] / lengths[:, None]
            projected = np.column_stack([turned, np.zeros(len(turned))]) @ self.directions
            starts = self.starts(query_ids[part], queries[part])
            asked = [Asked(*q) for q in zip(query_ids[part].tolist(), queries[part], lengths.tolist())]
            results: list = [None] * len(asked)
            # Window after window, for the queries whose search is not over.
            left = list(range(len(asked)))
            for step in itertools.count():
                widths = starts[left] * GROWTH**step
                bounds = zip(left, widths.tolist(), *self.windows(projected[left], widths))
                over = [i for i, *window in bounds if self.widen(asked[i], *window, k)]
                for i in over:
                    results[i], asked[i] = self.best(asked[i], k), None
                left = [i for i in left if asked[i] is not None]
                if not left:
                    break
            yield from results


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, by id, so that a task that is run again finds the same."""
    table = table.sort_by("vec_id")
    ids = table.column("vec_id").to_numpy()
    flat = table.column("embedding").combine_chunks().flatten().to_numpy()
    return ids, flat.reshape(len(ids), -1)


def nearest(
    vectors: DataFrame,
    every: int,
    k: int = NEIGHBOURS,
    shard_rows: int = SHARD_ROWS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For each vector whose id is divisible by `every`, its k nearest others, nearest first."""
    ship(vectors.sparkSession)
    rows = usable(vectors)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    thinned = materialise(rows.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    held = thinned.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("most")).first()
    queries = rows.where(F.col("vec_id") % every == 0)
    shards = max(1, math.ceil(held["n"] / shard_rows))
    blocks = max(1, math.ceil(queries.count() / query_block))
    norm = math.sqrt(held["most"] or 1.0)

    def dealt(count: int, seed: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int")

    def each(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    own = thinned.withColumn("shard", dealt(shards, SEED)).withColumn("block", each(blocks))
    asked = queries.withColumn("block", dealt(blocks, SEED + 1)).withColumn("shard", each(shards))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            query_ids, query_rows = _rows(right)
            shard = Shard(*_rows(left), norm)
            for query_id, (found, scores) in zip(query_ids, shard.search(query_ids, query_rows, k)):
                out.append((np.full(len(found), query_id), found, scores))
        if not out:
            return _ARROW.empty_table()
        return pa.Table.from_batches([rows_batch(_ARROW, [np.concatenate(x) for x in zip(*out)])])

    found = (
        own.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
