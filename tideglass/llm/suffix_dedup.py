"""Removal of repeated byte strings, by sorting the suffixes that can repeat.

A byte goes if a string of `LENGTH` bytes over it also starts earlier (a smaller document,
or the same document further left). Where strings may repeat is found first:

1. Equal texts are one class; the first is searched, the others are repeats as a whole.
2. Of the `GRAM`-byte pieces in a string, the one with the smallest hash, leftmost, is its
   anchor. It depends on the string alone, so equal strings have equal anchors at equal
   offsets. An anchor owns a run of starts; the bytes of all their strings are its context.
3. Anchors meet by hash. A context that is equal to an earlier one repeats with all its
   starts. Contexts that share the anchor but differ are *contested*; an anchor met once is
   done. Each batch of documents settles its own anchors first and sends one row for each,
   so an anchor that stands in a third of all documents is a row per batch.
4. The contested contexts of an anchor are sorted as suffixes: the bytes from the anchor on,
   and the bytes before it read backwards. Sorting is deep-shallow: multikey quicksort over
   8-byte symbols to a shallow depth, then a blind trie for each group that still shares a
   prefix, which also gives the common prefix of neighbours. From the common lengths to both
   sides follows which starts of a context have an equal string in an earlier one; all bytes
   compared are the texts', so an accidental equal hash of an anchor does no harm.
5. An anchor with more than `BLOCK` contested contexts is dealt in blocks. Strings that are
   first in their block then meet by a 128-bit hash, and the smallest place wins.

Documents are never grouped; per document only its own ranges come together. Intermediates
are tables in the shared folder.

Defined results: null and empty texts have no bytes and lose none, as do texts under LENGTH
bytes; rows with one `doc_id` and one text are one document listed twice and get one
result; of different texts under one `doc_id` the one with the smaller text hash comes
first; null ids come after all others; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import chunks, rows_batch, ship
from tideglass.llm.hashing import BASE, BYTE_CODES, OTHER_CODES, mix, prefix_sums, slice_hashes
from tideglass.operators.lookup import lookup_join
from tideglass.session import materialise

LENGTH = 100
GRAM = 32
SHALLOW = 2  # symbols of 8 bytes
BLOCK = 4096
_REACH = LENGTH - GRAM + 1  # anchors a string can have
_LAST = (1 << 63) - 1
_SETTLE_ROWS = 1 << 19

REPEAT, CONTESTED, SINGLE, MARKER = 3, 2, 0, 1
_ROWS = pa.schema(
    [
        ("route", pa.int64()), ("kind", pa.int8()), ("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()),
        ("th", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()),
    ]
)
_ROWS_TYPE = "route bigint, kind tinyint, h bigint, c bigint, doc bigint, th bigint, lo int, hi int, at int"


# Anchors.


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling."""
    hashes, size, factor = mix(BYTE_CODES[points]), 1, int(BASE)
    while size < GRAM:
        hashes = hashes[:-size] * np.uint64(factor) + hashes[size:]
        size, factor = 2 * size, (factor * factor | 1) % (1 << 64)
    return mix(hashes)


def anchor_runs(points: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """Runs of starts that share an anchor: owner (index of the document), first and last
    start, anchor, hash of the anchor and of the context; places are in `points`."""
    whole = np.flatnonzero(ends - begins >= LENGTH)
    if len(whole) == 0:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    hashes = gram_hashes(points)
    places = np.arange(len(hashes), dtype=np.uint64)
    low = (hashes >> np.uint64(31) << np.uint64(31)) | places
    size = 1
    while 2 * size <= _REACH:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < _REACH:
        low = np.minimum(low[: len(low) - (_REACH - size)], low[_REACH - size :])
    anchors = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
    # Starts of documents in turn; a run ends with its anchor or its document.
    change = np.zeros(len(anchors) + 1, dtype=bool)
    change[1:-1] = anchors[1:] != anchors[:-1]
    valid = np.zeros(len(anchors) + 1, dtype=np.int8)
    np.add.at(valid, begins[whole], 1)
    np.add.at(valid, ends[whole] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    change[begins[whole]] = True
    first = np.flatnonzero(valid & change[:-1])
    owner = np.searchsorted(begins, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(anchors)) - 1, ends[owner] - LENGTH)
    at = anchors[first]
    sums = prefix_sums(points)
    return owner, first, last, at, hashes[at], slice_hashes(sums, first, last + LENGTH)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64) if values.dtype == np.uint64 else values


def _merged(doc, th, lo, hi):
    """Ranges of starts of each document, joined where they touch."""
    order = np.lexsort((lo, th, doc))
    doc, th, lo, hi = doc[order], th[order], lo[order], hi[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (lo[1:] > hi[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], th[at], lo[at], np.maximum.reduceat(hi, at) if len(at) else hi


def _settle(h, c, doc, th, lo, hi, at) -> pa.RecordBatch:
    """What a batch knows of its own anchors: repeats, contested contexts, and one row each."""
    order = np.lexsort((lo, th, doc, c, h))
    h, c, doc, th, lo, hi, at = (x[order] for x in (h, c, doc, th, lo, hi, at))
    new_h = np.ones(len(h), dtype=bool)
    new_h[1:] = h[1:] != h[:-1]
    new_c = new_h.copy()
    new_c[1:] |= c[1:] != c[:-1]
    first = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), 0))
    same = (doc == doc[first]) & (th == th[first]) & (lo == lo[first])
    repeat = ~new_c & ~same
    group = np.cumsum(new_h) - 1
    contexts = np.bincount(group, new_c, minlength=int(group[-1]) + 1 if len(group) else 0)
    contested = new_c & (contexts[group] > 1)
    single = new_c & (contexts[group] == 1)
    marker = new_h & (contexts[group] > 1)
    r = _merged(doc[repeat], th[repeat], lo[repeat], hi[repeat])
    parts = [
        (REPEAT, mix(r[0].view(np.uint64) + r[2].astype(np.uint64)), 0 * r[0], 0 * r[0], *r, 0 * r[2]),
        *[
            (kind, mix(doc[m].view(np.uint64) + lo[m].astype(np.uint64)) if kind == CONTESTED else h[m], h[m], c[m], doc[m], th[m], lo[m], hi[m], at[m])
            for kind, m in ((CONTESTED, contested), (SINGLE, single), (MARKER, marker))
        ],
    ]
    columns = [np.concatenate([_signed(p[i]) for p in parts]) for i in range(1, 9)]
    kinds = np.repeat(np.array([p[0] for p in parts], dtype=np.int8), [len(p[1]) for p in parts])
    return rows_batch(_ROWS, [columns[0], kinds, *columns[1:]])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        held, count = [], 0
        for batch in batches:
            for part in chunks(batch):
                texts = [t.as_buffer().to_pybytes() for t in part.column("text")]
                doc, th = (part.column(n).to_numpy() for n in ("doc", "th"))
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                points = np.frombuffer(b"".join(texts), dtype=np.uint8)
                owner, lo, hi, at, h, c = anchor_runs(points, begins, ends)
                shift = begins[owner]
                held.append((h, c, doc[owner], th[owner], lo - shift, hi - shift, at - shift))
                count += len(h)
                if count >= _SETTLE_ROWS:
                    yield _settle(*(np.concatenate(x) for x in zip(*held)))
                    held, count = [], 0
        if count:
            yield _settle(*(np.concatenate(x) for x in zip(*held)))

    return docs.mapInArrow(run, _ROWS_TYPE)


def _meet(rows: DataFrame) -> DataFrame:
    """Repeats and contested contexts, from what all batches sent for each anchor."""

    def judge(t: pa.Table) -> pa.RecordBatch:
        cols = {n: t.column(n).to_numpy() for n in _ROWS.names}
        passed = cols["kind"] >= CONTESTED
        rest = np.flatnonzero(~passed)
        rest = rest[np.lexsort([cols[n][rest] for n in ("lo", "th", "doc", "c", "kind", "h")])]
        h, c, kind = (cols[n][rest] for n in ("h", "c", "kind"))
        new_h = np.ones(len(h), dtype=bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c = new_h | np.append(True, (c[1:] != c[:-1]) | (kind[1:] != kind[:-1]))[: len(h)]
        first = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), 0))
        same = np.ones(len(h), dtype=bool)
        for n in ("doc", "th", "lo"):
            values = cols[n][rest]
            same &= values == values[first]
        group = np.cumsum(new_h) - 1
        heads = np.bincount(group, new_c, minlength=1)
        repeat = (kind == SINGLE) & ~same
        contested = (kind == SINGLE) & new_c & (heads[group] > 1)
        kinds = np.concatenate([cols["kind"][passed], np.full(int(repeat.sum()), REPEAT), np.full(int(contested.sum()), CONTESTED)])
        taken = np.concatenate([np.flatnonzero(passed), rest[repeat], rest[contested]])
        return rows_batch(_ROWS, [kinds if n == "kind" else cols[n][taken] for n in _ROWS.names])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= 1 << 19:
                t = pa.Table.from_batches(held)
                routes = t.column("route").to_numpy()
                cut = int(np.searchsorted(routes, routes[-1]))
                if cut:
                    yield judge(t.slice(0, cut))
                    held, size = t.slice(cut).to_batches(), t.num_rows - cut
        if size:
            yield judge(pa.Table.from_batches(held))

    return rows.repartition("route").sortWithinPartitions("route").mapInArrow(run, _ROWS_TYPE)


# Deep-shallow sorting.


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    difference = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (difference.bit_length() + 7) // 8


class BlindTrie:
    """Strings by the places where they branch; bytes between branches are not stored.

    A node is [depth, {next byte: node}, strings that end or are equal here]. Inserting
    walks down by branching bytes alone, compares once with a string found there, and
    branches where they part.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root = None
        for i in range(len(strings)):
            self.insert(i)

    def insert(self, i: int) -> None:
        text = self.strings[i]
        if self.root is None:
            self.root = [len(text), {}, [i]]
            return
        node = self.root
        while node[1]:
            step = text[node[0]] if node[0] < len(text) else None
            node = node[1].get(step) or next(iter(node[1].values()))
        other = self.strings[self._any(node)]
        part = common_prefix(text, other)
        parent, node = None, self.root
        while node[0] < part and node[1]:
            parent, node = node, node[1][text[node[0]]]
        if node[0] > part:
            fork = [part, {other[part]: node}, []]
            if parent is None:
                self.root = fork
            else:
                parent[1][text[parent[0]]] = fork
            node = fork
        if part == len(text):
            node[2].append(i)
        elif text[part] in node[1]:
            raise AssertionError("a blind walk ends at a longest match")
        else:
            node[1][text[part]] = [len(text), {}, [i]]

    def _any(self, node: list) -> int:
        while not node[2]:
            node = next(iter(node[1].values()))
        return node[2][0]

    def sorted(self) -> tuple[list[int], list[int]]:
        """Strings in order, and the common prefix of each with the one before."""
        order, common, stack, depth = [], [], [(self.root, 0)], 0
        while stack:
            node, shared = stack.pop()
            for i in node[2]:
                order.append(i)
                common.append(shared)
                shared = node[0]
            following = shared if node[2] else None
            keys = sorted(node[1])
            # The first branch keeps what its node shares with what came before.
            for n, key in reversed(list(enumerate(keys))):
                stack.append((node[1][key], node[0] if n or following is not None else shared))
        return order, common


def deep_shallow_sort(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of strings, and the common prefix of each with the one before it in order.

    Shallow: multikey quicksort on 8-byte symbols; a group shares the symbols so far. Deep:
    groups that are still equal at the shallow depth go to a blind trie.
    """
    order: list[int] = []
    shared: list[int] = []

    # A stack of groups in order, so that depth of the split costs no recursion; below zero: equal strings.
    stack = [(list(range(len(strings))), 0)] if strings else []
    while stack:
        members, depth = stack.pop()
        if depth < 0 or len(members) == 1:
            order.extend(members)
            shared.extend([-1] + [len(strings[members[0]])] * (len(members) - 1))
            continue
        if depth == SHALLOW:
            inner, common = BlindTrie([strings[i] for i in members]).sorted()
            order.extend(members[i] for i in inner)
            shared.extend([-1, *common[1:]])
            continue
        symbol = {i: strings[i][8 * depth : 8 * depth + 8] for i in members}
        pivot = sorted(symbol[members[i]] for i in (0, len(members) // 2, -1))[1]
        less = [i for i in members if symbol[i] < pivot]
        equal = [i for i in members if symbol[i] == pivot]
        more = [i for i in members if symbol[i] > pivot]
        # A short symbol holds all bytes that were left.
        parts = ((more, depth), (equal, depth + 1 if len(pivot) == 8 else -1), (less, depth))
        stack.extend(part for part in parts if part[0])
    common = [
        common_prefix(strings[order[i - 1]], strings[order[i]]) if i and shared[i] < 0 else max(shared[i], 0)
        for i in range(len(order))
    ]
    return order, common


def _common_with_all(order: np.ndarray, common: np.ndarray, place: int) -> np.ndarray:
    """Common prefix of the string at `place` of the order with every string, by index."""
    out = np.empty(len(order), dtype=np.int64)
    out[order[place]] = 1 << 20
    if place:
        out[order[place - 1 :: -1]] = np.minimum.accumulate(common[place:0:-1])
    if place + 1 < len(order):
        out[order[place + 1 :]] = np.minimum.accumulate(common[place + 1 :])
    return out


def repeated_starts(contexts: list[bytes], offsets: list[int], counts: list[int]) -> list[np.ndarray]:
    """For contexts in order of place: which of their starts have an equal string in an
    earlier context. `offsets` are the anchors' places in the contexts, `counts` the starts."""
    right = deep_shallow_sort([c[o : o + LENGTH] for c, o in zip(contexts, offsets)])
    left = deep_shallow_sort([c[:o][::-1] for c, o in zip(contexts, offsets)])
    sides = []
    for order, common in (right, left):
        order = np.array(order)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        sides.append((order, np.array(common), place))
    out = []
    for i, (offset, count) in enumerate(zip(offsets, counts)):
        marks = np.zeros(count + 1, dtype=np.int64)
        if i:
            after, before = (_common_with_all(o, c, int(p[i]))[:i] for o, c, p in sides)
            # Start `offset - j` repeats if j bytes before and LENGTH - j after are common.
            least = np.maximum(LENGTH - after, offset - (count - 1))
            most = np.minimum(before, offset)
            fits = least <= most
            np.add.at(marks, offset - most[fits], 1)
            np.add.at(marks, offset - least[fits] + 1, -1)
        out.append(np.cumsum(marks[:-1]) > 0)
    return out


# The jobs.

_DUP = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64())])
_DUP_TYPE = "doc bigint, th bigint, lo int, hi int, f1 bigint, f2 bigint"


def _context_rows(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """The bytes of contested contexts, read from the documents."""
    wanted = materialise(
        contested.groupBy("doc", "th").agg(
            F.collect_list(F.struct("h", "lo", "hi", "at", "blocks")).alias("runs"), F.lit(1).alias("_one")
        )
    )
    size = wanted.agg(F.sum(40 + 32 * F.size("runs").cast("long"))).first()[0] or 0
    found = lookup_join(docs, wanted, ["doc", "th"], weight="_one", spread="doc", how="inner", dim_bytes=size)
    schema = pa.schema([("h", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("doc", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("at", pa.int32()), ("context", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                out = []
                texts, runs = part.column("text"), part.column("runs").to_pylist()
                for text, doc, th, own in zip(texts, part.column("doc").to_pylist(), part.column("th").to_pylist(), runs):
                    data = text.as_buffer().to_pybytes()
                    for r in own:
                        # Hashes of integers are the same in every worker; one document's contexts are dealt too.
                        block = hash((doc, th, r["lo"])) % r["blocks"]
                        out.append((r["h"], block, r["blocks"], doc, th, r["lo"], r["at"], data[r["lo"] : r["hi"] + LENGTH]))
                if out:
                    yield rows_batch(schema, list(zip(*out)))

    return found.select("doc", "th", "text", "runs").mapInArrow(
        run, "h bigint, block int, blocks int, doc bigint, th bigint, lo int, at int, context binary"
    )


def _resolve(contexts: DataFrame) -> DataFrame:
    """Repeats among the contexts of each anchor's block; of anchors in several blocks also
    the strings that are first in their block, with their hashes."""

    def group(rows: list[dict]):
        # A document listed twice brings each of its contexts twice.
        kept = {(r["doc"], r["th"], r["lo"]): r for r in rows}
        rows = [kept[k] for k in sorted(kept)]
        texts = [r["context"] for r in rows]
        counts = [len(t) - LENGTH + 1 for t in texts]
        marks = repeated_starts(texts, [r["at"] - r["lo"] for r in rows], counts)
        for row, text, mark in zip(rows, texts, marks):
            edge = np.diff(mark.astype(np.int8), prepend=0, append=0)
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                yield (row["doc"], row["th"], row["lo"] + a, row["lo"] + b - 1, 0, 0)
            if row["blocks"] > 1:
                points = np.frombuffer(text, dtype=np.uint8)
                at = np.flatnonzero(~mark)
                for start, f1, f2 in zip(
                    at.tolist(),
                    _signed(slice_hashes(prefix_sums(points), at, at + LENGTH)).tolist(),
                    _signed(slice_hashes(prefix_sums(points, OTHER_CODES), at, at + LENGTH)).tolist(),
                ):
                    yield (row["doc"], row["th"], row["lo"] + start, -1, f1, f2)

    def run(batches):
        key, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["h"], row["block"]) != key:
                    out += group(held) if len(held) > 1 or (held and held[0]["blocks"] > 1) else ()
                    key, held = (row["h"], row["block"]), []
                    if len(out) > 1 << 16:
                        yield rows_batch(_DUP, list(zip(*out)))
                        out = []
                held.append(row)
        out += group(held) if held else ()
        if out:
            yield rows_batch(_DUP, list(zip(*out)))

    return contexts.repartition("h", "block").sortWithinPartitions("h", "block").mapInArrow(run, _DUP_TYPE)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc, th, ranges, copy) of documents that lose bytes: ranges of repeated starts, or all."""
    members = materialise(docs.select("doc", "th", F.octet_length("text").alias("size"), F.xxhash64("text", F.lit(1)).alias("th2")))
    heads = members.groupBy("th", "th2").agg(F.min("doc").alias("head"), F.max("doc").alias("tail"), F.count(F.lit(1)).alias("_rows")).where("head <> tail")
    twins = lookup_join(members, materialise(heads), ["th", "th2"], weight="_rows", spread="doc", how="inner")
    copies = materialise(twins.where((F.col("doc") != F.col("head")) & (F.col("size") >= LENGTH)).select("doc", "th").distinct())

    bytes_of = 32 * copies.count()
    marked = lookup_join(docs, copies.withColumn("_one", F.lit(1)).withColumn("_copy", F.lit(True)), ["doc", "th"], weight="_one", spread="doc", dim_bytes=bytes_of)
    single = marked.where(F.col("_copy").isNull() & (F.octet_length("text") >= LENGTH)).select("doc", "th", "text")
    met = materialise(_meet(_anchor_rows(single)))

    contested = met.where(F.col("kind") == CONTESTED).select("h", "doc", "th", "lo", "hi", "at")
    crowds = contested.groupBy("h").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > BLOCK)
    # Anchors beyond BLOCK rows are few: at most one in BLOCK rows.
    crowds = materialise(crowds.withColumn("_blocks", F.ceil(F.col("_rows") / BLOCK).cast("int")))
    dealt = lookup_join(contested, crowds, ["h"], weight="_rows", spread="doc").withColumn("blocks", F.coalesce("_blocks", F.lit(1)))
    resolved = materialise(_resolve(_context_rows(docs, dealt)))

    firsts = resolved.where(F.col("hi") < 0)
    least = firsts.groupBy("f1", "f2").agg(
        F.min(F.struct("doc", "th", "lo")).alias("least"), F.count(F.lit(1)).alias("_rows")
    ).where("_rows > 1")
    again = lookup_join(firsts, materialise(least), ["f1", "f2"], weight="_rows", spread="doc", how="inner")
    later = again.where(F.struct("doc", "th", "lo") > F.col("least"))

    ranges = (
        met.where(F.col("kind") == REPEAT).select("doc", "th", "lo", "hi")
        .union(resolved.where(F.col("hi") >= 0).select("doc", "th", "lo", "hi"))
        .union(later.select("doc", "th", "lo", F.col("lo").alias("hi")))
    )
    lost = ranges.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")).withColumn("copy", F.lit(False))
    none = F.array().cast("array<struct<lo: int, hi: int>>")
    return lost.union(copies.select("doc", "th", none.alias("ranges"), F.lit(True).alias("copy")))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_OUT_TYPE = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def removed_spans(size: int, ranges: list[tuple[int, int]], copy: bool) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes, from ranges of repeated starts."""
    if copy:
        return [(0, size)]
    spans: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi + LENGTH)
        else:
            spans.append([lo, hi + LENGTH])
    return [(a, b) for a, b in spans]


def report(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, bytes and runs removed, digest of what is left."""
    ship(docs.sparkSession)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    lost = materialise(repeated_ranges(docs.select("doc", "th", "text")).withColumn("_one", F.lit(1)))
    size = lost.agg(F.sum(48 + 16 * F.size("ranges").cast("long"))).first()[0] or 0
    found = lookup_join(docs, lost, ["doc", "th"], weight="_one", spread="doc", dim_bytes=size)

    def run(batches):
        for batch in batches:
            out = []
            for key, text, ranges, copy in zip(
                batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ranges").to_pylist(), batch.column("copy").to_pylist()
            ):
                data = text.as_buffer().to_pybytes()
                spans = removed_spans(len(data), [(r["lo"], r["hi"]) for r in ranges or ()], bool(copy))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((key, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
            if out:
                yield rows_batch(_OUT, list(zip(*out)))

    return found.select("doc_id", "text", "ranges", "copy").mapInArrow(run, _OUT_TYPE)
