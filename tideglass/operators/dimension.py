"""The window dimension: derived from the log, and folded forward batch by batch.

Arrivals are payload rows with an `event_id`, which gives the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.hashing import context_hash
from tideglass.operators.lookup import BROADCAST_BYTES, content_bytes, lookup_join
from tideglass.operators.numbering import number_rows
from tideglass.schemas import GEOMETRY, IDENTITY, WINDOW_STATE
from tideglass.session import materialise


def identity_partials(arrivals: DataFrame) -> DataFrame:
    """One row per spelling of a window identity, with its context hash.

    All buffers are fixed-width, so this stays a hash aggregate with map-side
    combining: a window that holds most of the log is one row per map task. The hash
    is computed after it, once per spelling.
    """
    seen = arrivals.where(F.col("window").isNotNull()).select(
        "event_id", "occurred_at", "window.*"
    )
    return (
        seen.groupBy(*IDENTITY)
        .agg(
            F.min("occurred_at").alias("first_seen_at"),
            F.max("occurred_at").alias("last_seen_at"),
            F.count(F.lit(1)).alias("event_count"),
            F.min("event_id").alias("first_event_id"),
            F.max("event_id").alias("last_event_id"),
            # The last arrival wins, and its NULL overwrites: max_by keeps NULLs.
            *[F.max_by(name, "event_id").alias(name) for name in GEOMETRY],
        )
        .withColumn("context_hash", context_hash(*[F.col(name) for name in IDENTITY]))
    )


def fold(partials: DataFrame) -> DataFrame:
    """Merge partial rows by hash; independent of their order and of how they were cut.

    Spellings that hash alike (NULL and '' paths) merge, the first arrived one stays.
    A row without `window_id` is a partial that has not been numbered yet.
    """
    ids = [F.max("window_id").alias("window_id")] if "window_id" in partials.columns else []
    return (
        partials.groupBy("context_hash")
        .agg(
            F.min_by(F.struct(*IDENTITY), "first_event_id").alias("identity"),
            F.max_by(F.struct(*GEOMETRY), "last_event_id").alias("geometry"),
            F.min("first_seen_at").alias("first_seen_at"),
            F.max("last_seen_at").alias("last_seen_at"),
            F.sum("event_count").alias("event_count"),
            F.min("first_event_id").alias("first_event_id"),
            F.max("last_event_id").alias("last_event_id"),
            *ids,
        )
        .select("*", "identity.*", "geometry.*")
        .drop("identity", "geometry")
    )


def shape(dim: DataFrame) -> DataFrame:
    return dim.select(*[F.col(f.name).cast(f.dataType) for f in WINDOW_STATE.fields])


def number_windows(partials: DataFrame, after: int = 0) -> DataFrame:
    """Give folded partials ids in the order of first arrival, from `after` + 1."""
    return shape(
        number_rows(partials, [F.col("first_event_id")], "window_id", start=after + 1)
    )


def build_dimension(arrivals: DataFrame) -> DataFrame:
    """The whole dimension from the whole log: one pass over the arrivals."""
    return number_windows(fold(identity_partials(arrivals)))


def known_pairs(parts: DataFrame, partials: DataFrame) -> DataFrame:
    """The (context_hash, window_id) pairs of `parts` that a batch asks for, each once.

    A batch brings few windows and the parts of a dimension hold many, so the batch's own
    hashes go to the parts: what is shuffled are the batch's windows, not the dimension's.
    Only where the batch's hashes outgrow a broadcast are all pairs returned.
    """
    pairs = parts.select("context_hash", "window_id")
    hashes = partials.select("context_hash")
    if content_bytes(hashes) <= BROADCAST_BYTES:
        pairs = pairs.join(F.broadcast(hashes), "context_hash", "left_semi")
    return pairs.distinct()


def dimension_part(known: DataFrame, partials: DataFrame, after: int) -> DataFrame:
    """What a batch adds to a dimension: its own windows, known ones under their ids.

    `known` are the (context_hash, window_id) pairs so far and `after` is the highest id
    given. The join works on one row per hash; the dimension's other columns are not read.
    """
    batch = fold(partials)
    if after == 0:
        # No window has been numbered yet: all of the batch's windows are new.
        return number_windows(batch)
    batch = materialise(batch.join(known, "context_hash", "left"))
    fresh = number_windows(batch.where(F.col("window_id").isNull()).drop("window_id"), after)
    return shape(batch.where(F.col("window_id").isNotNull())).unionByName(fresh)


def advance_dimension(
    current: DataFrame, partials: DataFrame, after: int
) -> tuple[DataFrame, DataFrame]:
    """Fold a batch's identity partials into the current dimension.

    `after` is the highest id given so far. Returns the next dimension and the batch's
    (context_hash, window_id) pairs.
    """
    part = dimension_part(known_pairs(current, partials), partials, after)
    following = part if after == 0 else shape(fold(current.unionByName(part)))
    return following, part.select("context_hash", "window_id")


def assign_windows(arrivals: DataFrame, partials: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add `window_id` to arrivals by looking their identity up; NULL without a window.

    `partials` are the stored identity_partials of the arrivals, `pairs` their window ids
    by hash. Comparing the four identity fields finds the same window as comparing hashes,
    and spares hashing every event.
    """
    spellings = (
        partials.select("context_hash", *IDENTITY, "event_count")
        .join(pairs, "context_hash")
        .drop("context_hash")
    )
    size = content_bytes(partials)
    if size > BROADCAST_BYTES:
        spellings = materialise(spellings)
    names = {name: f"_window_{name}" for name in IDENTITY}
    facts = arrivals.withColumns(
        {alias: F.col(f"window.{name}") for name, alias in names.items()}
    )
    found = lookup_join(
        facts,
        spellings.withColumnsRenamed(names),
        list(names.values()),
        nullable=[names["process_id"], names["process_path"]],
        weight="event_count",
        spread="event_id",
        dim_bytes=size,
    )
    return found.drop(*names.values())
