"""Periodic runs of words: descending-LCP Kruskal over the suffixes of each document.

A run is a stretch of consecutive words whose smallest period q fits at least `power` times
and that no neighbouring word extends. Suffixes of a document whose first words are equal
form classes; going down from the largest common prefix, classes are united with union-find,
each with the ordered set of its positions. When positions p < q become neighbours in a
united set at common prefix l, the words p to q + l have period q - p and end there; if the
word before p breaks the period, this seeds a run. Each run is seeded once, by its first
word and the one a period later, and its period is the smallest one: a smaller period would
have put a position between the two before.

Only common prefixes that a run needs are looked at: at least `least_common` words. Suffixes
that share so many words with another one of their document are found by hashes and then
ranked exactly by their words; prefix doubling refines the ranks, and the ranks of each
level give the exact common prefix of neighbours where a class splits. Sets hold their
positions by ranges of at least the longest distance that can matter, so no set operation
touches more than a range.

Map only: documents do not touch each other, a worker holds about a mebibyte of text or one
longer document, and its memory is proportional to that. Defined results: a null or empty
text has no words and no runs; the digest of no runs and of no words is that of the empty
string; a null id leaves the words as they are; equal rows give equal rows; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideglass.llm.common import chunks, id_and_text, rows_batch, sha256_hex, ship
from tideglass.llm.hashing import BASE, mix

LEAST_LENGTH = 6
POWER = 4
#: Positions of a set are held in ranges of so many words at least.
RANGE = 1 << 12


def least_common(least: int = LEAST_LENGTH, power: int = POWER) -> int:
    """Least common prefix of the suffixes that seed a run, over all periods."""
    return min(max(least - q, (power - 1) * q) for q in range(1, least + 1))


def periodic_tail(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of all ids, drawn from the id, with a tail made periodic."""
    n = len(words)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


@dataclass
class _Level:
    """Classes of suffixes by their first `length` words; suffixes that are alone are left out."""

    length: int
    places: np.ndarray  # ascending
    classes: np.ndarray

    def at(self, places: np.ndarray) -> np.ndarray:
        """Class of each place, -1 for suffixes that are alone."""
        if not len(self.places):
            return np.full(len(places), -1, dtype=np.int64)
        found = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        return np.where(self.places[found] == places, self.classes[found], -1)


def _repeated(ids: np.ndarray, owner: np.ndarray, ends: np.ndarray, gram: int) -> np.ndarray:
    """Places whose next `gram` words may also begin elsewhere in the same document: by hash."""
    size = len(ids) - gram + 1
    if size <= 0:
        return np.empty(0, dtype=np.int64)
    hashes = mix(owner[:size].astype(np.uint64) * BASE + np.uint64(1))
    for i in range(gram):
        hashes = mix(hashes * BASE + ids[i : i + size].astype(np.uint64))
    inside = np.flatnonzero(np.arange(gram, gram + size) <= ends[owner[:size]])
    hashes = hashes[inside]
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.empty(0, dtype=np.int64)
    found = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    return inside[twice[found] == hashes]


def suffix_edges(
    ids: np.ndarray, owner: np.ndarray, ends: np.ndarray, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, place, common words) of neighbouring classes in suffix order, from `gram` words on.

    `ids` are the words of all documents in turn, `owner` the document of each and `ends`
    where each document ends. Any member stands for its class: what lies between two
    classes is the same for all of them.
    """
    seeds = _repeated(ids, owner, ends, gram)
    none = np.empty(0, dtype=np.int64)
    if not len(seeds):
        return none, none, none
    # Refining asks for the rank a few words further on, repeated or not.
    later = seeds + gram
    places = np.union1d(seeds, later[later < ends[owner[seeds]]])
    columns = [np.where(places + i < ends[owner[places]], ids[np.minimum(places + i, len(ids) - 1)], -1) for i in range(gram)]
    order = np.lexsort([*columns[::-1], owner[places]])
    sorted_columns = [c[order] for c in (owner[places], *columns)]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    starts = np.flatnonzero(fresh)
    rank = np.full(len(ids) + 1, -1, dtype=np.int64)
    first = np.repeat(starts, np.diff(np.append(starts, len(order))))
    rank[places[order]] = first
    sizes = np.diff(np.append(starts, len(order)))
    many = np.repeat(sizes, sizes) > 1
    members, classes = places[order][many], first[many]
    # Short suffixes at the end of a document are alone by their missing words.
    levels: list[_Level] = []
    length = gram
    lefts, rights, commons = [], [], []
    while len(members):
        by_place = np.argsort(members)
        levels.append(_Level(length, members[by_place], classes[by_place]))
        ahead = members + length
        key = np.where(ahead < ends[owner[members]], rank[np.minimum(ahead, len(ids))], -1)
        order = np.lexsort((key, classes))
        members, classes, key = members[order], classes[order], key[order]
        old = np.ones(len(members), dtype=bool)
        old[1:] = classes[1:] != classes[:-1]
        new = old.copy()
        new[1:] |= key[1:] != key[:-1]
        split = np.flatnonzero(new & ~old)
        if len(split):
            left, right = members[split - 1], members[split]
            lefts.append(left)
            rights.append(right)
            commons.append(_common(left, right, levels, ids, ends[owner[left]], gram))
        index = np.arange(len(members))
        begin_old = np.maximum.accumulate(np.where(old, index, 0))
        begin_new = np.maximum.accumulate(np.where(new, index, 0))
        classes = classes + begin_new - begin_old
        rank[members] = classes
        sizes = np.diff(np.append(np.flatnonzero(new), len(members)))
        many = np.repeat(sizes, sizes) > 1
        members, classes = members[many], classes[many]
        length *= 2
    return (np.concatenate(lefts), np.concatenate(rights), np.concatenate(commons)) if lefts else (none, none, none)


def _common(left: np.ndarray, right: np.ndarray, levels: list[_Level], ids: np.ndarray, end: np.ndarray, gram: int) -> np.ndarray:
    """Common words of suffixes that are equal for the last level's length, but not for twice."""
    common = np.full(len(left), levels[-1].length, dtype=np.int64)
    for level in reversed(levels[:-1]):
        a, b = level.at(left + common), level.at(right + common)
        common += np.where((a == b) & (a >= 0), level.length, 0)
    last = len(ids) - 1
    on = np.ones(len(left), dtype=bool)
    for _ in range(gram - 1):
        on &= np.maximum(left, right) + common < end
        on &= ids[np.minimum(left + common, last)] == ids[np.minimum(right + common, last)]
        common += on
    return common


class _Positions:
    """An ordered set of positions, held by ranges."""

    __slots__ = ("size", "ranges")

    def __init__(self, place: int, width: int) -> None:
        self.size = 1
        self.ranges = {place // width: [place]}

    def before(self, place: int, width: int) -> int:
        """Largest position below `place` in its range or the one before, or -1."""
        k = place // width
        held = self.ranges.get(k)
        if held is not None:
            i = bisect_left(held, place)
            if i:
                return held[i - 1]
        held = self.ranges.get(k - 1)
        return held[-1] if held is not None else -1

    def after(self, place: int, width: int) -> int:
        k = place // width
        held = self.ranges.get(k)
        if held is not None and held[-1] > place:
            return held[bisect_left(held, place + 1)]
        held = self.ranges.get(k + 1)
        return held[0] if held is not None else -1

    def take(self, other: "_Positions") -> None:
        self.size += other.size
        for k, places in other.ranges.items():
            held = self.ranges.get(k)
            if held is None:
                self.ranges[k] = places
            elif len(places) == 1:
                insort(held, places[0])
            else:
                held += places
                held.sort()


def _new_neighbours(big: _Positions, small: _Positions, width: int):
    """Pairs that become neighbours when the sets are united, nearer than a range."""
    for places in small.ranges.values():
        for place in places:
            below = big.before(place, width)
            if below >= 0 and below > small.before(place, width):
                yield below, place
            above = big.after(place, width)
            if above >= 0:
                own = small.after(place, width)
                if own < 0 or above < own:
                    yield place, above


def runs_of(
    ids: np.ndarray, owner: np.ndarray, begins: np.ndarray, ends: np.ndarray,
    least: int = LEAST_LENGTH, power: int = POWER,
) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of all runs, ordered; starts count from the document's first word."""
    if power < 2:
        raise ValueError("runs of less than two periods are not told apart by their suffixes")
    left, right, common = suffix_edges(ids, owner, ends, least_common(least, power))
    if not len(left):
        return []
    places = np.unique(np.concatenate([left, right]))
    order = np.argsort(-common, kind="stable")
    left, right, common = left[order], right[order], common[order]
    # Neighbours further apart than this seed no run, at this or any smaller common prefix.
    width = max(RANGE, int(common[0]) // (power - 1) + 1)
    parent = list(range(len(places)))
    sets: list[_Positions | None] = [None] * len(places)
    where = places.tolist()
    seeds = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = zip(np.searchsorted(places, left).tolist(), np.searchsorted(places, right).tolist(), common.tolist())
    for i, j, words in pairs:
        i, j = root(i), root(j)
        big = sets[i] or _Positions(where[i], width)
        small = sets[j] or _Positions(where[j], width)
        if big.size < small.size:
            i, j, big, small = j, i, small, big
        for p, q in _new_neighbours(big, small, width):
            if (power - 1) * (q - p) <= words and q - p + words >= least:
                seeds.append((p, q, words))
        big.take(small)
        sets[i], sets[j] = big, None
        parent[j] = i
    if not seeds:
        return []
    p, q, words = np.array(sorted(seeds), dtype=np.int64).T
    document = owner[p]
    whole = (p == begins[document]) | (ids[p - 1] != ids[q - 1])
    p, q, words, document = p[whole], q[whole], words[whole], document[whole]
    return list(zip(document.tolist(), (p - begins[document]).tolist(), (q - p + words).tolist(), (q - p).tolist()))


@dataclass(frozen=True)
class Found:
    """Runs (start, length, period) of a text, by start and then period, and its words."""

    words: list[bytes]
    runs: list[tuple[int, int, int]]

    def best(self) -> tuple[int, int, int] | None:
        """The run of greatest length over period, then smallest start, then period."""
        best = None
        for run in self.runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        return best

    def collapsed(self) -> bytes:
        """The words that no run repeats."""
        if not self.runs:
            return b" ".join(self.words)
        change = np.zeros(len(self.words) + 1, dtype=np.int64)
        start, length, period = np.array(self.runs, dtype=np.int64).T
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        return b" ".join([self.words[i] for i in kept.tolist()])


def find(texts: list[list[bytes]], least: int = LEAST_LENGTH, power: int = POWER) -> list[Found]:
    """Runs of each list of words."""
    table: defaultdict[bytes, int] = defaultdict()
    table.default_factory = table.__len__
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ids = np.fromiter(map(table.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for document, *run in runs_of(ids, owner, ends - sizes, ends, least, power):
        runs[document].append(tuple(run))
    # By start and then period: within a document they come by start and next position.
    return [Found(t, r) for t, r in zip(texts, runs)]


_SCHEMA = [
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
]


def _map(docs: DataFrame, schema: pa.Schema, ddl: str, make) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                keys = part.column("doc_id").to_pylist()
                texts = [t.as_buffer().to_pybytes().split() for t in part.column("text")]
                yield rows_batch(schema, make(keys, texts))

    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, ddl)


def list_runs(docs: DataFrame, least: int = LEAST_LENGTH, power: int = POWER) -> DataFrame:
    """(doc_id, start, length, period) of every run of every text as it stands."""
    names = ("doc_id", "start", "length", "period")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def make(keys, texts):
        rows = [(k, *r) for k, f in zip(keys, find(texts, least, power)) for r in f.runs]
        return list(zip(*rows)) if rows else [[]] * 4

    return _map(docs, schema, ", ".join(f"{n} bigint" for n in names), make)


def collapsed(docs: DataFrame, least: int = LEAST_LENGTH, power: int = POWER) -> DataFrame:
    """(doc_id, text): the words that no run repeats, joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def make(keys, texts):
        return [keys, [f.collapsed().decode() for f in find(texts, least, power)]]

    return _map(docs, schema, "doc_id bigint, text string", make)


def report(docs: DataFrame, tail=periodic_tail) -> DataFrame:
    """One row per document: its runs, counted and digested, the one repeated most, and what is left.

    `tail` may change a document's words beforehand; by default a tenth of all ids get a
    periodic tail.
    """
    schema = pa.schema(_SCHEMA)
    ddl = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"

    def make(keys, texts):
        found = find([tail(k, t) for k, t in zip(keys, texts)])
        best = [f.best() or (None, None, None) for f in found]
        return [
            keys,
            [len(f.runs) for f in found],
            *zip(*best),
            [None if b[0] is None else 1000 * b[1] // b[2] for b in best],
            [sha256_hex("".join(f"{s},{n},{p}\n" for s, n, p in f.runs).encode()) for f in found],
            [sha256_hex(f.collapsed()) for f in found],
        ]

    return _map(docs, schema, ddl, make)
