"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A fingerprint has a bit set where over half of the document's shingle hashes have it set;
two link when at most `distance` bits differ. The search works on distinct fingerprints:

1. *Embedding.* A fingerprint is cut into two parts and each part into segments of two bits,
   mapped to the segments' bit counts. The Manhattan distance of two such vectors never
   exceeds the number of differing bits, and of two fingerprints that differ in at most four
   bits either the first parts differ in two at most or the second parts in one at most. So
   a pair that links has vectors within that radius in one part.
2. *Grid.* A vector goes to its own cell and to those one step along one axis; for radius
   one, steps up are enough. Two vectors within the radius share a cell, as the grid holds a
   point halfway between them. Cells are counted first.
3. *Small cells*, of at most `SMALL` fingerprints, are brought together; all their pairs are
   verified in arrays, and a spanning forest of the links found is kept.
4. *Large cells: stars, then the rest.* In rounds, every member is compared with hubs of the
   cell: the fingerprint of most rows, then members of its lowest and highest component;
   links unite components. Then, in cells that still hold several components, the members
   outside the cell's largest component are compared with all others. So every pair across
   components that shares a cell is verified, no link between components is lost, and a
   family of thousands of near copies costs its members, not its pairs.

In large cells comparing is one expression of the join's condition, so nothing but links
leaves a join; a hot cell's members are split by the skew handling of the join, and its hubs and
sizes are pre-aggregated. Intermediates are tables in the shared folder. A fingerprint has 40
cells on average and a random pair shares one with a chance of about 1 in 25,000, so
comparisons, cheap as they are, grow with the square of the distinct fingerprints; rows
shuffled for the cells do not.

Defined results: null and empty texts and texts of white space have fingerprint zero, which
links like any other; fewer than `SIZE` words are one shingle; repeated rows and ids are
judged by each of their texts; null ids get the component of their text, null if no member
has an id; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import chunks, id_and_text, rows_batch, ship
from tideglass.llm.jaccard import components
from tideglass.operators.lookup import lookup_join
from tideglass.session import materialise

SIZE = 4
SEED = 42
DISTANCE = 4
#: Rounds of stars at most; they save work and decide nothing.
STAR_ROUNDS = 3
#: A list of large cells is broadcast up to this size.
BROADCAST_BYTES = 4 << 20
#: Bits of a segment; segments and radius of both parts. Radii of r and s bits leave no pair
#: out that differs in up to r + s + 1.
WIDTH = 2
PARTS = ((18, 2), (14, 1))
#: Fingerprints of a cell whose pairs are all verified in one place; larger cells go by stars.
SMALL = 256
#: Pairs held as arrays at a time.
_PAIRS = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are held as an array at a time.
_SPAN = 1 << 16


def shingle_hashes(text: bytes, size: int = SIZE) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    stops = ends[min(size, len(words)) - 1 :]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins[:last].tolist(), stops.tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; no hash gives zero."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SPAN):
        rows = hashes[at : at + _SPAN].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document, as a signed 64-bit integer."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                found = np.array([fingerprint(shingle_hashes(t.as_buffer().to_pybytes(), size)) for t in part.column("text")], dtype=np.uint64)
                yield rows_batch(schema, [part.column("doc_id"), found.view(np.int64)])

    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint) of both parts' vectors and their steps along one axis.

    A cell's number has the bit counts of the segments as digits; the parts' numbers do not meet.
    """
    values = fps.view(np.uint64)
    base = WIDTH + 1
    numbers, owners = [], []
    first_bit = offset = 0
    for segments, radius in PARTS:
        powers = base ** np.arange(segments, dtype=np.int64)
        shifts = np.arange(segments, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(first_bit)
        counts = np.bitwise_count((values[:, None] >> shifts) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
        own = counts @ powers + offset
        numbers.append(own)
        owners.append(np.arange(len(values)))
        for step, fits in ((1, counts < WIDTH), (-1, counts > 0))[:radius]:
            row, axis = np.nonzero(fits)
            numbers.append(own[row] + step * powers[axis])
            owners.append(row)
        first_bit += segments * WIDTH
        offset += base**segments
    return np.concatenate(numbers).astype(np.int32), np.concatenate(owners)


def _cell_rows(heads: DataFrame) -> DataFrame:
    """(cell, fp, rows) of the distinct fingerprints."""
    schema = pa.schema([("cell", pa.int32()), ("fp", pa.int64()), ("rows", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = part.column("fp").to_numpy()
                numbers, owners = cells(fps)
                yield rows_batch(schema, [numbers, fps[owners], part.column("rows").to_numpy()[owners]])

    return heads.select("fp", "rows").mapInArrow(run, "cell int, fp bigint, rows bigint")


def cell_links(members: list[np.ndarray], distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links within cells, each given by its fingerprints."""
    sizes = np.array([len(m) for m in members], dtype=np.int64)
    flat = np.concatenate(members)
    # Each member meets those behind it in its cell.
    behind = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat)) - 1
    left = np.repeat(np.arange(len(flat)), behind)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(behind) - behind, behind)
    near = np.bitwise_count((flat[left] ^ flat[right]).view(np.uint64)) <= distance
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for x, y in zip(flat[left[near]].tolist(), flat[right[near]].tolist()):
        a, b = root(x), root(y)
        if a != b:
            parent[a] = b
            kept.append((x, y))
    return kept


def _small_links(rows: DataFrame, distance: int) -> DataFrame:
    """Links (x, y) within cells of at most `SMALL` fingerprints."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches):
        for batch in batches:
            lists = batch.column("fps")
            fps, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            parts = np.split(fps, np.cumsum(sizes)[:-1])
            upto = np.cumsum(sizes * (sizes - 1) // 2)
            for at in np.split(np.arange(len(sizes)), np.searchsorted(upto, np.arange(_PAIRS, int(upto[-1]), _PAIRS)) + 1 if len(upto) else []):
                if len(at):
                    found = cell_links([parts[i] for i in at.tolist()], distance)
                    if found:
                        yield rows_batch(schema, list(zip(*found)))

    held = rows.groupBy("cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return held.select("fps").mapInArrow(run, "x bigint, y bigint")


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _united(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, label) of all fingerprints once the components that links (x, y) join are one.

    Only edges between components are looked at, each once.
    """
    x, y = (labels.select(F.col("fp").alias(n), F.col("label").alias(f"_{n}")) for n in "xy")
    edges = links.join(x, "x").join(y, "y").where("_x <> _y")
    edges = materialise(edges.select(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y")).distinct())
    renamed = components(edges).select(F.col("node").alias("label"), F.col("label").alias("_low"))
    # A component that takes others in keeps the smallest of their labels.
    return materialise(labels.join(renamed, "label", "left").select("fp", F.coalesce("_low", "label").alias("label")))


def _stars(placed: DataFrame, distance: int, first: bool) -> DataFrame:
    """Links of members with their cell's hubs of another component, one for each pair of components."""
    member = F.struct("fp", "label")
    ends = [
        F.min_by(member, F.struct(F.col("label"), -F.col("rows"), F.col("fp"))),
        F.max_by(member, F.struct("label", "rows", "fp")),
    ]
    hubs = (
        placed.groupBy("cell")
        .agg(
            F.array_distinct(F.array(F.max_by(member, F.struct("rows", "fp")), *([] if first else ends))).alias("hubs"),
            F.min("label").alias("_least"),
            F.max("label").alias("_most"),
        )
        .where("_least <> _most")
        .select("cell", "hubs")
    )
    met = placed.join(hubs, "cell").select("fp", "label", F.explode("hubs").alias("hub"))
    found = met.where((F.col("label") != F.col("hub.label")) & _near(F.col("fp"), F.col("hub.fp"), distance))
    one = found.groupBy("label", F.col("hub.label").alias("_other")).agg(F.min(F.struct("fp", F.col("hub.fp").alias("y"))).alias("link"))
    return one.select(F.col("link.fp").alias("x"), F.col("link.y").alias("y"))


def _rest(placed: DataFrame, distance: int) -> DataFrame:
    """All links across components in cells: who is outside a cell's largest component meets all."""
    sizes = placed.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("held"))
    largest = (
        sizes.groupBy("cell")
        .agg(F.max_by("label", F.struct("held", "label")).alias("largest"), F.count(F.lit(1)).alias("_labels"))
        .where("_labels > 1")
        .drop("_labels")
    )
    open_cells = materialise(placed.drop("rows").join(largest, "cell"))
    few = open_cells.where("label <> largest").select("cell", F.col("fp").alias("x"), F.col("label").alias("_x"))
    all_of = open_cells.select(F.col("cell").alias("_cell"), F.col("fp").alias("y"), F.col("label").alias("_y"), "largest")
    met = few.join(
        all_of,
        (F.col("cell") == F.col("_cell"))
        & (F.col("_x") != F.col("_y"))
        & ((F.col("_y") == F.col("largest")) | (F.col("x") < F.col("y")))
        & _near(F.col("x"), F.col("y"), distance),
    )
    return met.select("x", "y").distinct()


def linked(heads: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, label): each fingerprint's component, as the smallest one in it.

    `heads` has distinct fingerprints and their numbers of rows.
    """
    if distance > sum(radius for _, radius in PARTS) + 1:
        raise ValueError("the cells bring together fingerprints that differ in four bits at most")
    rows = _cell_rows(heads)
    large = materialise(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") > SMALL))
    if 16 * large.count() <= BROADCAST_BYTES:
        keys = F.broadcast(large.select("cell"))
    else:
        keys = large.select("cell")
    links = materialise(_small_links(rows.join(keys, "cell", "left_anti"), distance))
    labels = _united(heads.select("fp", F.col("fp").alias("label")), links)
    hot = materialise(rows.join(keys, "cell", "left_semi"))
    if not hot.limit(1).count():
        return labels
    for i in range(STAR_ROUNDS):
        new = materialise(_stars(hot.join(labels, "fp"), distance, i == 0))
        found = new.count()
        if found:
            labels = _united(labels, new)
        if i and not found:
            break
    rest = materialise(_rest(materialise(hot.join(labels, "fp")), distance))
    return _united(labels, rest) if rest.limit(1).count() else labels


def report(docs: DataFrame, size: int = SIZE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: its fingerprint and the smallest id of its component."""
    members = materialise(fingerprints(docs, size))
    heads = materialise(members.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("rows")))
    placed = materialise(heads.join(linked(heads, distance), "fp"))
    lowest = placed.groupBy("label").agg(F.min("head").alias("component_id"), F.count(F.lit(1)).alias("_fps"))
    named = lookup_join(placed, materialise(lowest), ["label"], weight="_fps", spread="fp")
    named = materialise(named.select("fp", "component_id", F.col("rows").alias("_rows")))
    found = lookup_join(members, named, ["fp"], weight="_rows", spread="doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
