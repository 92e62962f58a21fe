"""N-gram Jaccard join with adaptive multi-match prefixes; components of the link graph.

A document's set is its distinct `size`-word shingles, as 64-bit hashes. Equal sets are one
class, known by a hash of the set, so copies cost one row each from then on. The join:

1. *Pools.* With tokens in hash order, two similar sets share k tokens within the first
   n - least overlap + k of each. Every class sends such a pool (k = a fifth of its size);
   a class of which too few pool tokens occur in another class has no partner. Tokens that
   repeat within a batch are settled there, so a token met everywhere costs one row a batch.
2. *Survivors* are counted with all their tokens. Tokens no one shares bound the overlap
   from above; what cannot reach its least overlap goes.
3. *Adaptive prefixes.* Tokens are ordered rare first. Each survivor chooses how many
   matches k it asks for: a prefix longer by k-1 tokens admits only candidates that share
   min(k, their k) prefix tokens. It takes the k of least estimated cost: the postings
   read plus the candidates expected.
4. *Stars, then the rest.* Per token the member with the fewest tokens of its own, and one
   of two components, are hubs; in rounds, each class verifies its best hubs outside its
   component, and linked classes form components. What is left are pairs across components that share enough prefix tokens and whose bounds allow
   a link: all of these are verified. So no link between components is lost, and a family
   of near copies costs about one pair a member, not all its pairs.

Verification counts the exact intersection of the sets. Joins on hubs and components are
salted when a key is hot; intermediates are tables in the shared folder.

Defined results: null and empty texts, and texts of white space, have no shingles, no links
and are their own component; fewer than `size` words count as one shingle; a repeated
`doc_id` is judged by each of its texts; null ids get a component by their text, null if no
member has an id; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import chunks, id_and_text, lean, rows_batch, ship
from tideglass.llm.hashing import BASE, mix
from tideglass.operators.lookup import BROADCAST_BYTES, lookup_join
from tideglass.session import materialise

SIZE = 5
PERCENT = 80
MOST_MATCHES = 6
#: Rounds of stars at most; they save work and decide nothing.
STAR_ROUNDS = 6
#: Sets in a broadcast at most; the driver and every executor hold it.
SETS_BROADCAST_BYTES = 4 << 20
_VERIFY_COST = 50  # one verified candidate, in postings
_ROW = "_tideglass_row"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words up to so many bytes are hashed together, eight bytes a step; longer ones by a digest each.
_SHORT = 64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ASCII-lower-cased bytes.

    Every eight bytes are mixed in, so no two words of up to eight bytes share a hash and no
    structure of longer ones makes them meet.
    """
    points = np.frombuffer(data, dtype=np.uint8)
    solid = (points != 32) & ((points < 9) | (points > 13))
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - begin
    hashes = mix(size.astype(np.uint64) * BASE)
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([points, np.zeros(8, np.uint8)]), 8)
    on = np.flatnonzero(size <= _SHORT)
    at = 0
    while len(on):
        block = np.ascontiguousarray(eights[begin[on] + at]).view("<u8").ravel()
        hashes[on] = mix(hashes[on] * BASE + (block & _MASKS[np.minimum(size[on] - at, 8)]))
        at += 8
        on = on[size[on] > at]
    for i in np.flatnonzero(size > _SHORT).tolist():
        digest = hashlib.blake2b(data[begin[i] : end[i]], digest_size=8).digest()
        hashes[i] = np.uint64(int.from_bytes(digest, "little"))
    return hashes, begin


def shingle_sets(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    words, at = word_hashes(b" ".join(texts).translate(_LOWER))
    first = np.cumsum(lengths + 1) - lengths - 1
    bounds = np.searchsorted(at, np.concatenate([first, [lengths.sum() + len(texts)]]))
    grams = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            grams = mix(grams * BASE + words[i : i + len(grams)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for word in words[a:b]:
                whole = mix(whole * BASE + word)
            out.append(whole)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _class_of(tokens: np.ndarray) -> int | None:
    """Class of a set: a hash of all its tokens; null for the empty set."""
    if not len(tokens):
        return None
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: int, percent: int) -> int:
    """Least intersection of a set of n tokens with any set it is similar to."""
    return -(-percent * n // 100)


def _pool_matches(n: int) -> int:
    return n // 5 + 1


def pool_length(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + _pool_matches(n))


def pool_demand(n: int, percent: int) -> int:
    """Pool tokens that any partner, however small, shares and sends as well."""
    return min(_pool_matches(least_overlap(n, percent)), least_overlap(n, percent))


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [t.as_buffer().to_pybytes() for t in part.column("text")]


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def classify(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """`doc_id`, class and number of shingles of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(_texts(part), size)
                yield rows_batch(schema, [part.column("doc_id"), [_class_of(s) for s in sets], [len(s) for s in sets]])

    return docs.mapInArrow(lean(run), "doc_id bigint, node bigint, n bigint")


def _pool_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(token, node, seen) of pools. `seen` 1 asks whether the token is met elsewhere; 0 says
    that it is met here more than once; -k says that k of the node's tokens are met here."""
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("seen", pa.int64())])

    def settle(nodes: list[int], pools: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(pools) if pools else np.empty(0, np.uint64)
        owner = np.repeat(np.array(nodes, dtype=np.int64), [len(p) for p in pools])
        kinds, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
        met = count[place] > 1
        known, times = np.unique(owner[met], return_counts=True)
        repeated = kinds[count > 1]
        return rows_batch(
            schema,
            [
                np.concatenate([_signed(tokens[~met]), _signed(repeated), known]),
                np.concatenate([owner[~met], np.zeros(len(repeated), np.int64), known]),
                np.concatenate([np.ones(int((~met).sum()), np.int64), np.zeros(len(repeated), np.int64), -times]),
            ],
        )

    def run(batches):
        nodes, pools, held, seen = [], [], 0, set()
        for batch in batches:
            for part in chunks(batch):
                for tokens in shingle_sets(_texts(part), size):
                    node = _class_of(tokens)
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    nodes.append(node)
                    pools.append(tokens[: pool_length(len(tokens), percent)])
                    held += len(pools[-1])
                if held > 1 << 20:
                    yield settle(nodes, pools)
                    nodes, pools, held, seen = [], [], 0, set()
        if nodes:
            yield settle(nodes, pools)

    return docs.mapInArrow(lean(run), "token bigint, node bigint, seen bigint")


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                sets = [s for s in shingle_sets(_texts(part), size) if len(s)]
                yield rows_batch(schema, [[_class_of(s) for s in sets], [len(s) for s in sets], [_signed(s) for s in sets]])

    return docs.mapInArrow(lean(run), "node bigint, n bigint, tokens array<bigint>")


def _prefix_rows(shared: DataFrame, percent: int) -> DataFrame:
    """Prefix postings of each node from its shared tokens, with the matches it asks for."""
    schema = pa.schema(
        [
            ("token", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("common", pa.int64()),
            ("k", pa.int64()), ("pos", pa.int64()),
        ]
    )

    def run(batches):
        for batch in batches:
            lists = batch.column("pairs")
            flat = lists.flatten()
            dfs, tokens = flat.field("df").to_numpy(), flat.field("token").to_numpy()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            out = []
            for node, n, end, common in zip(
                batch.column("node").to_pylist(), batch.column("n").to_pylist(), ends, lists.value_lengths().to_pylist()
            ):
                # Tokens of its own come first in the order and match no one.
                first = n - least_overlap(n, percent) - (n - common)
                if first < 0:
                    continue
                df, own = dfs[end - common : end], tokens[end - common : end]
                order = np.lexsort((own, df))
                read = np.cumsum(df[order])
                most = max(1, min(MOST_MATCHES, common - first, least_overlap(n, percent)))
                k = np.arange(1, most + 1)
                postings = read[np.minimum(first + k, common) - 1]
                best = int(np.argmin(postings + _VERIFY_COST * postings / k**2)) + 1
                taken = own[order[: first + best]]
                places = n - common + np.arange(len(taken))
                out.append((taken, *(np.full(len(taken), x) for x in (node, n, common, best)), places))
            if out:
                yield rows_batch(schema, [np.concatenate(c) for c in zip(*out)])

    lists = shared.groupBy("node").agg(
        F.first("n").alias("n"), F.collect_list(F.struct("df", "token")).alias("pairs")
    )
    return lists.mapInArrow(lean(run), "token bigint, node bigint, n bigint, common bigint, k bigint, pos bigint")


def _least_common(n: Column, m: Column, percent: int) -> Column:
    """Least intersection of two similar sets of n and m tokens."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether a shared token counts for a pair: sizes and shared tokens leave room for a link,
    and the token is early enough in both. Of sets that share o tokens, the first k shared ones
    have places below n - o + k in each."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    least = _least_common(n, m, percent)
    k = F.least(F.col(f"{a}.k"), F.col(f"{b}.k"))
    return (
        (F.least(F.col(f"{a}.common"), F.col(f"{b}.common")) >= least)
        & (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & (F.col(f"{a}.pos") < n - least + k)
        & (F.col(f"{b}.pos") < m - least + k)
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets are similar, by the exact intersection."""
    uses = pairs.groupBy("y").agg(F.count(F.lit(1)).alias("_uses"))
    right = sets.join(uses, sets["node"] == uses["y"]).select("y", F.col("n").alias("_m"), F.col("tokens").alias("_other"), "_uses")
    right = materialise(right)
    held = right.agg(F.sum(24 + 8 * F.col("_m"))).first()[0] or 0
    # Light pairs meet the y sets first, salted where one y is in many pairs. Sets are bulky:
    # all but few of them are shuffled.
    with_y = lookup_join(
        pairs.select("x", "y"), right, ["y"], weight="_uses", spread="x", how="inner",
        dim_bytes=held if held <= SETS_BROADCAST_BYTES else BROADCAST_BYTES + 1,
    )
    both = with_y.join(sets, with_y["x"] == sets["node"])
    overlap = F.size(F.array_intersect("tokens", "_other"))
    return both.where(100 * overlap >= percent * (F.col("n") + F.col("_m") - overlap)).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes in links (x, y): the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label's own label, so
    labels travel in jumps; labels only fall, and a round without change ends it.
    """
    edges = materialise(
        links.select(F.col("x").alias("a"), F.col("y").alias("b"))
        .union(links.select(F.col("y").alias("a"), F.col("x").alias("b")))
        .distinct()
    )
    labels = materialise(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("best"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "best").alias("label"), F.col("label").alias("old"))
        hooked = materialise(hooked)
        up = hooked.select(F.col("node").alias("parent"), F.col("label").alias("above"))
        jumped = hooked.join(up, hooked["label"] == up["parent"]).select("node", F.least("label", "above").alias("label"), "old")
        jumped = materialise(jumped)
        changed = jumped.where(F.col("label") != F.col("old")).limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def _fewest_matches(rows: DataFrame) -> DataFrame:
    """Choose anew, by what is left of the postings, how many matches each node asks for.

    k matches admit at most postings read / k candidates. Asking for fewer than before is
    always allowed: the prefix for fewer matches is a part of the one at hand.
    """
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    room = F.col("n") - F.col("_asked")
    costs = [
        F.struct(
            (F.sum(F.when(F.col("pos") < room + k, F.col("_df"))) * (1 + _VERIFY_COST / k)).alias("cost"),
            F.lit(k).cast("bigint").alias("k"),
        )
        for k in range(1, MOST_MATCHES + 1)
    ]
    chosen = rows.join(lists, "token").groupBy("node").agg(F.array(*costs).alias("costs"))
    known = F.filter("costs", lambda c: c["cost"].isNotNull())
    chosen = chosen.select("node", F.array_min(known)["k"].alias("_k"))
    fewer = rows.join(chosen, "node").withColumn("k", F.least("k", "_k"))
    return materialise(fewer.where(F.col("pos") < room + F.col("k")).drop("_asked", "_k"))


def _candidates(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that share enough prefix tokens and may link."""
    placed = materialise(_labelled(postings, labels))
    # Only tokens that more than one component has, and members that fit someone there.
    spread = placed.groupBy("token").agg(
        F.min("label").alias("_low"), F.max("label").alias("_high"), F.min("n").alias("_least")
    ).where("_low <> _high").select("token", "_least")
    # The smallest partner that a member can have in the token's list asks least of it.
    smallest = F.greatest(F.col("_least"), F.ceil(F.col("n") * percent / 100))
    asked = _least_common(F.col("n"), smallest, percent)
    fit = (F.col("common") >= asked) & (F.col("pos") < F.col("n") - asked + F.col("k"))
    rows = _fewest_matches(materialise(placed.join(spread, "token").where(fit).withColumn("_asked", asked)))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(
        b,
        (F.col("a.token") == F.col("b.token")) & (F.col("a.label") < F.col("b.label")) & _may_link("a", "b", percent),
    )
    return (
        met.groupBy(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
        .agg(F.count(F.lit(1)).alias("met"), F.min(F.least("a.k", "b.k")).alias("asked"))
        .where("met >= asked")
        .select("x", "y")
    )


def _stars(postings: DataFrame, percent: int) -> DataFrame:
    """For each node its best hubs in other components, by matches and by rare matches.

    A token offers three hubs: its least changed member and one member of each of its lowest
    and highest component, so any member meets another component if the token has one.
    """
    ratio = F.col("common") / F.col("n")
    member = F.struct("node", "n", "common", "label")
    hubs = postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"),
        F.array(
            F.max_by(member, F.struct(ratio, F.col("node"))),
            F.min_by(member, F.struct(F.col("label"), -ratio, F.col("node"))),
            F.max_by(member, F.struct(F.col("label"), ratio, F.col("node"))),
        ).alias("hubs"),
    ).where("hubs[1].label <> hubs[2].label")
    offered = postings.join(hubs, "token").select(
        "node", "n", "common", "label", "df", F.explode(F.array_distinct("hubs")).alias("h")
    )
    fits = (F.least("common", "h.common") * (100 + percent) >= percent * (F.col("n") + F.col("h.n"))) & (
        F.col("label") != F.col("h.label")
    )
    met = offered.where(fits).groupBy("node", F.col("h.node").alias("y")).agg(
        F.count(F.lit(1)).alias("met"), F.sum(1 / F.col("df")).alias("rare")
    )
    best = met.groupBy("node").agg(
        F.array(F.max_by("y", F.struct("met", "y")), F.max_by("y", F.struct("rare", "y"))).alias("ys")
    )
    return best.select(F.col("node").alias("x"), F.explode(F.array_distinct("ys")).alias("y"))


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("label", F.col("node"))
    return postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _collapse(postings: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of rounds of stars, and the components they form.

    Ends with the first round that finds few new links: what is left is for the exact step.
    """
    links, labels, tested = None, None, None
    for _ in range(STAR_ROUNDS):
        pairs = _stars(_labelled(postings, labels), percent)
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = materialise(pairs)
        new = materialise(_verified(pairs, sets, percent))
        found = new.count()
        links = new if links is None else links.union(new)
        tested = pairs if tested is None else tested.union(pairs)
        if found or labels is None:
            labels = components(links)
        if found * 100 <= pairs.count():
            break
    return links, labels


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose id is not in `ids`; broadcast only if the list is measured to be small."""
    if 24 * ids.count() <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return docs.join(ids, key, "left_anti")


def _with_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    if 24 * ids.count() <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return docs.join(ids, key, "left_semi")


def similar_classes(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label) of classes that have a link to another class."""
    held = members.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    heads = held.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    # A class whose rows all lack an id is rare; its rows are simply all kept.
    heads = materialise(heads)
    repeats = held.join(heads.select("doc_id"), "doc_id", "left_anti").select("doc_id").distinct()
    single = without_ids(docs, materialise(repeats))

    rows = _pool_rows(single, size, percent)
    asked = rows.select(
        "token", "node", "seen", F.sum(F.when(F.col("seen") >= 0, 1).otherwise(0)).over(Window.partitionBy("token")).alias("times")
    )
    hits = (
        asked.where("seen < 0 OR (seen = 1 AND times > 1)")
        .groupBy("node")
        .agg(F.sum(F.abs("seen")).alias("hits"))
    )
    demand = F.least(
        F.floor(F.ceil(F.col("n") * percent / 100) / 5) + 1, F.ceil(F.col("n") * percent / 100)
    )
    sized = members.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
    survivors = materialise(hits.join(sized, "node").where(F.col("hits") >= demand).select("node", "doc_id"))
    # Rows without an id are few or broken input: they are read again as they are.
    kept = _with_ids(docs, survivors.select("doc_id").where("doc_id IS NOT NULL").distinct())
    kept = kept.union(docs.where(F.col("doc_id").isNull()))
    sets = materialise(_full_sets(kept, size).dropDuplicates(["node"]))

    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(frequency, "token")
    postings = materialise(_prefix_rows(shared, percent))

    links, labels = _collapse(postings, sets, percent)
    more = materialise(_candidates(postings, labels, percent))
    links = links.union(_verified(more, sets, percent))
    return components(links)


def report(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per document: size of its set and the smallest id of its component."""
    ship(docs.sparkSession)
    docs = id_and_text(docs)
    members = materialise(classify(docs, size))
    labels = similar_classes(docs, members, size, percent)
    classes = members.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("rows")
    )
    placed = materialise(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    lowest = placed.groupBy("label").agg(F.min("head").alias("component_id"), F.count(F.lit(1)).alias("_classes"))
    named = lookup_join(placed, materialise(lowest), ["label"], weight="_classes", spread="node")
    named = materialise(named.select("node", "component_id", F.col("rows").alias("_rows")))
    found = lookup_join(members, named, ["node"], weight="_rows", spread="doc_id")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component: of its smallest id, nulls last; of rows that tie, the first read.

    A row is known by a key of its own, so neither rows that repeat an id nor rows without
    one are taken for each other. Rows without shingles are all kept. All columns.
    """
    ship(docs.sparkSession)
    keyed = materialise(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    # Rows are told apart by key, so that the search for components may know them by it too.
    rows = id_and_text(keyed.drop("doc_id").withColumnRenamed(_ROW, "doc_id"))
    found = report(rows).select(F.col("doc_id").alias(_ROW), F.col("component_id").alias("_component"), "n_shingles")
    found = found.where("n_shingles > 0").drop("n_shingles")
    ids = keyed.select(_ROW, F.col("doc_id").cast("long").alias("doc_id"))
    # Only rows of components of two or more are told apart.
    many = materialise(found.groupBy("_component").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"))
    many = many.withColumn("_many", F.lit(True))
    met = lookup_join(found, many, ["_component"], weight="_rows", spread=_ROW).where("_many")
    met = materialise(met.select(_ROW, "_component").join(ids, _ROW))
    first = met.groupBy("_component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", _ROW)).alias("first")
    )
    extra = met.select(_ROW).join(materialise(first.select(F.col("first")[_ROW].alias(_ROW))), _ROW, "left_anti")
    return without_ids(keyed, materialise(extra), _ROW).select(*[F.col(f"`{c}`") for c in docs.columns])
