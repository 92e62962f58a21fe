"""The stored timeline: an event log and versions of its window dimension.

Layout below the store's root, all Parquet but the commits:

    events/version=N/occurred_date=D/   events appended by version N
    windows/version=N/                  what version N adds to the dimension
    files/version=N/                    files of text that version N took from a stream
    quarantine/version=N/               rejected payloads of version N
    commits/version=N/                  one JSON row, written last

A version counts once its commit exists. Files of a version are overwritten when it is
tried again, so a failed or repeated attempt leaves nothing behind. One writer at a time.
The dimension is the fold of its parts from the version that last compacted it, so a batch
writes in proportion to its own windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.operators import dimension as dim
from tideglass.operators import timeline
from tideglass.operators.lookup import lookup_join
from tideglass.operators.numbering import number_rows
from tideglass.operators.quality import constraint_report
from tideglass.operators.summary import SummaryQuery, activity_summary, last_event_at
from tideglass.operators.timeline import EventQuery, Page, WindowQuery
from tideglass.schemas import (
    DEFAULT_COLLECTOR_NAME,
    DEFAULT_COLLECTOR_VERSION,
    EVENT,
    EVENT_KINDS,
    PROCESS_ID,
    WINDOW,
    WINDOW_STATE,
)
from tideglass.session import delete_folder, materialise, prepare, scratch_scope, shared_folder
from tideglass.sources.lines import (
    FILE_ORDER,
    MAX_PROCESS_ID,
    decode_events,
    event_lines,
    number_placed,
    place_lines,
    wire_json,
)

_COMMIT = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("source_batch", T.LongType()),
        T.StructField("events", T.LongType()),
        T.StructField("first_event_id", T.LongType()),
        T.StructField("last_event_id", T.LongType()),
        T.StructField("last_window_id", T.LongType()),
        T.StructField("window_base", T.LongType()),
    ]
)
_LOG = T.StructType(
    EVENT.fields
    + [
        T.StructField("version", T.LongType()),
        T.StructField("occurred_date", T.DateType()),
    ]
)


@dataclass(frozen=True)
class SourceBatch:
    """One micro-batch of a stream: its feed's name, the id kept with the stream's
    checkpoint, and the batch number. The same stream id and number mean the same rows."""

    source: str
    stream: str
    number: int


@dataclass(frozen=True)
class Snapshot:
    """The store as of its last commit; reads of one snapshot agree with each other."""

    spark: SparkSession
    root: str
    commits: tuple

    @property
    def version(self) -> int:
        return self.commits[-1]["version"] if self.commits else 0

    @cached_property
    def last_event_id(self) -> int | None:
        ids = [c["last_event_id"] for c in self.commits if c["last_event_id"] is not None]
        return max(ids, default=None)

    @property
    def last_window_id(self) -> int:
        return (self.commits[-1]["last_window_id"] or 0) if self.commits else 0

    @property
    def window_base(self) -> int:
        """The version from which on the parts of the dimension count."""
        return (self.commits[-1]["window_base"] or 1) if self.commits else 1

    def holds(self, batch: SourceBatch | None) -> bool:
        """Whether this very micro-batch is committed."""
        return batch is not None and any(
            (c["stream"], c["source_batch"]) == (batch.stream, batch.number) for c in self.commits
        )

    def resumes(self, batch: SourceBatch | None) -> bool:
        """Whether streams of other ids read the feed before: a checkpoint was lost, or the
        name is used for a second feed. Which of the batch's rows are old is unknown."""
        return batch is not None and any(
            c["source"] == batch.source and c["stream"] != batch.stream for c in self.commits
        )

    @cached_property
    def log(self) -> DataFrame:
        """The event log with its partition columns."""
        if not self.commits:
            return self.spark.createDataFrame([], _LOG)
        table = self.spark.read.schema(_LOG).parquet(f"{self.root}/events")
        return table.where(F.col("version") <= self.version)

    @property
    def events(self) -> DataFrame:
        return self.log.select(*EVENT.names)

    @cached_property
    def window_parts(self) -> DataFrame:
        """Parts of the dimension, a row per window and version that saw it."""
        if not self.commits:
            return self.spark.createDataFrame([], WINDOW_STATE)
        schema = T.StructType([*WINDOW_STATE.fields, T.StructField("version", T.LongType())])
        parts = self.spark.read.schema(schema).parquet(f"{self.root}/windows")
        return parts.where(F.col("version").between(self.window_base, self.version)).drop("version")

    @cached_property
    def window_state(self) -> DataFrame:
        """The dimension with the arrival positions it is folded by."""
        if self.version <= self.window_base:
            return self.window_parts
        return dim.shape(dim.fold(self.window_parts))

    @property
    def windows(self) -> DataFrame:
        return self.window_state.select(*WINDOW.names)

    # The query surface.

    def list_events(self, query: EventQuery = EventQuery()) -> Page:
        return timeline.list_events(self.log, self.windows, query)

    def list_windows(self, query: WindowQuery = WindowQuery()) -> Page:
        return timeline.list_windows(self.windows, query)

    def event(self, event_id: int) -> DataFrame:
        """One event; only versions whose id range covers it are read."""
        versions = [
            c["version"]
            for c in self.commits
            if c["events"] and c["first_event_id"] <= event_id <= c["last_event_id"]
        ]
        return timeline.event_by_id(self.log.where(F.col("version").isin(versions)), event_id)

    def window(self, window_id: int) -> DataFrame:
        return timeline.window_by_id(self.windows, window_id)

    def window_by_hash(self, context_hash: str) -> DataFrame:
        return timeline.window_by_hash(self.windows, context_hash)

    def summary(self, query: SummaryQuery = SummaryQuery()) -> DataFrame:
        return activity_summary(self.log, self.windows, query)

    def last_event_at(self) -> DataFrame:
        return last_event_at(self.log)

    def constraint_report(self) -> DataFrame:
        return constraint_report(self.events, self.windows)

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """Free SQL over the views `input_events` and `observed_windows`."""
        self.events.createOrReplaceTempView("input_events")
        self.windows.createOrReplaceTempView("observed_windows")
        return self.spark.sql(text, args=args)


class TimelineStore:
    """Reads and appends to the timeline below `root`, a folder all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = prepare(spark)
        self.root = shared_folder(spark, root.rstrip("/"))

    def snapshot(self) -> Snapshot:
        try:
            found = self.spark.read.schema(_COMMIT).json(f"{self.root}/commits/*").collect()
            rows = [row.asDict() for row in found]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return Snapshot(self.spark, self.root, tuple(sorted(rows, key=lambda r: r["version"])))

    def ingest(
        self, payloads: DataFrame, batch: SourceBatch | None = None, order_by: Sequence[str] = ()
    ) -> Snapshot:
        """Append payloads and fold the dimension; rows that break a constraint are quarantined.

        Payloads either carry an `event_id` in arrival order, above all ids stored before, or
        have none and get the next ids in the order of the columns `order_by`. A micro-batch
        that is committed already is not applied again. When a feed comes back under another
        stream id, payloads with ids are judged by them; payloads without cannot be told from
        those stored, and the call raises.
        """
        before = self.snapshot()
        if before.holds(batch):
            return before
        given = "event_id" in payloads.columns
        if not given and before.resumes(batch):
            raise RuntimeError(
                f"{batch.source!r} was read before by another stream, and its rows carry no ids:"
                " go on with its checkpoint, or name a new feed"
            )
        if not given and not order_by:
            raise ValueError("payloads without event_id need order_by")
        with scratch_scope(self.spark):
            rows = payloads.withColumn("_slot", F.monotonically_increasing_id())
            if given:
                landed = materialise(reject_reason(rows))
                checked = _reject_repeats(landed, before.last_event_id)
            else:
                keys = [F.col(name) for name in (*order_by, "_slot")]
                numbered = number_rows(rows, keys, "event_id", (before.last_event_id or 0) + 1)
                checked = materialise(reject_reason(numbered))
            return self._append(before, checked.drop("_slot"), wire_json(), batch)

    def ingest_lines(
        self,
        lines: DataFrame,
        prefix: str = "",
        batch: SourceBatch | None = None,
        order_by: Sequence[str] = FILE_ORDER,
    ) -> Snapshot:
        """Append text lines in the order of `order_by`; malformed ones are quarantined.

        A micro-batch that is committed already is not applied again. When a feed comes back
        under another stream id, lines of files (path and time) that were taken from it before
        are left out and all others kept; lines without file columns raise instead.
        """
        before = self.snapshot()
        if before.holds(batch):
            return before
        by_file = {"file_path", "file_time"} <= set(lines.columns)
        if before.resumes(batch):
            if not by_file:
                raise RuntimeError(
                    f"{batch.source!r} was read before by another stream, and its lines have no"
                    " file columns: go on with its checkpoint, or name a new feed"
                )
            taken = self._taken_files(before, batch.source)
            lines = lines.join(taken, ["file_path", "file_time"], "left_anti")
        with scratch_scope(self.spark):
            placed = place_lines(event_lines(lines, prefix))
            landed = materialise(decode_events(placed))
            if batch is not None and by_file:
                files = landed.select(F.lit(batch.source).alias("source"), "file_path", "file_time")
                files.distinct().write.mode("overwrite").parquet(
                    f"{self.root}/files/version={before.version + 1}"
                )
            numbered = number_placed(landed, before.last_event_id or 0, order_by)
            return self._append(before, numbered, F.col("payload"), batch)

    def compact(self) -> Snapshot:
        """Write the dimension as one part, and drop the parts it was folded from.

        Snapshots taken before lose their dimension; take a new one.
        """
        before = self.snapshot()
        if before.version <= before.window_base:
            return before
        version = before.version + 1
        before.window_state.write.mode("overwrite").parquet(f"{self.root}/windows/version={version}")
        commit = dict.fromkeys(_COMMIT.names) | {
            "version": version, "events": 0, "last_window_id": before.last_window_id,
            "window_base": version,
        }
        after = self._commit(before, commit)
        for old in range(before.window_base, version):
            delete_folder(self.spark, f"{self.root}/windows/version={old}")
        return after

    def _taken_files(self, before: Snapshot, source: str) -> DataFrame:
        """Files that were taken from the feed; none if its streams had no file columns."""
        schema = "source string, file_path string, file_time timestamp, version bigint"
        try:
            files = self.spark.read.schema(schema).parquet(f"{self.root}/files")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise RuntimeError(f"{source!r} was read before without file columns") from error
        held = files.where((F.col("source") == source) & (F.col("version") <= before.version))
        return held.select("file_path", "file_time").distinct()

    def quarantine(self) -> DataFrame:
        version = self.snapshot().version
        schema = "event_id bigint, payload string, reason string, version bigint"
        if version == 0:
            return self.spark.createDataFrame([], schema)
        return (
            self.spark.read.schema(schema)
            .parquet(f"{self.root}/quarantine")
            .where(F.col("version") <= version)
        )

    def _write_quarantine(self, version: int, rejected: DataFrame) -> None:
        rejected.write.mode("overwrite").parquet(f"{self.root}/quarantine/version={version}")

    def _append(
        self, before: Snapshot, checked: DataFrame, payload: Column, batch: SourceBatch | None
    ) -> Snapshot:
        """Write what `checked` accepts (`reason` NULL) and rejects as the next version."""
        version = before.version + 1
        rejected = checked.where(F.col("reason").isNotNull())
        self._write_quarantine(
            version, rejected.select("event_id", payload.alias("payload"), "reason")
        )
        payloads = checked.where(F.col("reason").isNull()).drop("reason", "payload")

        partials = materialise(dim.identity_partials(payloads))
        known = dim.known_pairs(before.window_parts, partials)
        part = materialise(dim.dimension_part(known, partials, before.last_window_id))
        part.write.mode("overwrite").parquet(f"{self.root}/windows/version={version}")
        pairs = part.select("context_hash", "window_id")

        events_path = f"{self.root}/events/version={version}"
        (
            to_records(dim.assign_windows(payloads, partials, pairs))
            .withColumn("occurred_date", F.to_date("occurred_at"))
            # Days of a file's size each: large days are split, small ones share a task.
            .hint("rebalance", "occurred_date")
            .sortWithinPartitions("occurred_date", "occurred_at")
            .write.mode("overwrite")
            .partitionBy("occurred_date")
            .parquet(events_path)
        )
        written = self.spark.read.schema(EVENT).parquet(events_path)
        counted = written.selectExpr(
            "count(*) AS events",
            "min(event_id) AS first_event_id",
            "max(event_id) AS last_event_id",
        ).first()
        newest = part.agg(F.max("window_id")).first()[0] or 0
        commit = {
            "version": version,
            "source": batch.source if batch else None,
            "stream": batch.stream if batch else None,
            "source_batch": batch.number if batch else None,
            **counted.asDict(),
            "last_window_id": max(newest, before.last_window_id),
            "window_base": before.window_base,
        }
        return self._commit(before, commit)

    def _commit(self, before: Snapshot, commit: dict) -> Snapshot:
        self.spark.range(1).coalesce(1).select(
            *[F.lit(commit[f.name]).cast(f.dataType).alias(f.name) for f in _COMMIT.fields]
        ).write.mode("overwrite").json(f"{self.root}/commits/version={commit['version']}")
        return Snapshot(self.spark, self.root, (*before.commits, commit))


def _reject_repeats(landed: DataFrame, last_event_id: int | None) -> DataFrame:
    """Mark rows whose id is stored already, or was taken by an earlier row of the batch."""
    valid = landed.where(F.col("reason").isNull())
    repeated = materialise(
        valid.groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_slot").alias("_first"))
        .where("_rows > 1")
    )
    marked = lookup_join(landed, repeated, ["event_id"], weight="_rows", spread="_slot")
    again = F.coalesce(F.col("_slot") != F.col("_first"), F.lit(False))
    if last_event_id is not None:
        again = again | (F.col("event_id") <= last_event_id)
    reason = F.coalesce("reason", F.when(again, F.lit("duplicate:event_id")))
    return marked.withColumn("reason", reason).drop("_first")


def to_records(payloads: DataFrame) -> DataFrame:
    """Payloads with `event_id` and `window_id` as log records; fills the column defaults."""
    return payloads.select(
        "event_id",
        "occurred_at",
        F.col("kind").alias("event_kind"),
        F.col("value").alias("event_value"),
        "delta_x",
        "delta_y",
        "window_id",
        "raw_event",
        "raw_window",
        F.coalesce("collector_name", F.lit(DEFAULT_COLLECTOR_NAME)).alias("collector_name"),
        F.coalesce("collector_version", F.lit(DEFAULT_COLLECTOR_VERSION)).alias(
            "collector_version"
        ),
        F.current_timestamp().alias("created_at"),
    )


def reject_reason(payloads: DataFrame) -> DataFrame:
    """Add `reason` to typed payloads: the first log constraint a row breaks, else NULL."""
    process_id = F.col("window.process_id")
    rules = [
        *[
            (F.col(name).isNull(), f"missing:{name}")
            for name in ("event_id", "occurred_at", "kind", "value")
        ],
        (~F.col("kind").isin(*EVENT_KINDS), "unknown_kind"),
        *[
            (F.col("window").isNotNull() & F.col(f"window.{name}").isNull(), f"missing:window.{name}")
            for name in ("app_name", "title")
        ],
        (
            (process_id < 0) | (process_id > F.lit(str(MAX_PROCESS_ID)).cast(PROCESS_ID)),
            "out_of_range:window.process_id",
        ),
    ]
    return payloads.withColumn(
        "reason", F.coalesce(*[F.when(broken, F.lit(name)) for broken, name in rules])
    )
