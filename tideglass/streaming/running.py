"""Running results over a stream, kept in the streaming state.

The state has one row per spelling of a window identity: it grows with the windows,
not with the events. Each trigger writes the whole result anew, which suits dashboards
over moderate dimensions; for large ones read snapshots of a stored timeline instead.

Below `path`, `results/batch=N` holds a trigger's result and `published/batch=N` says that
it is whole. Readers take the newest published one, so they see a former result while one is
being written; the one before the newest is kept for readers under way. Batch -1 is the result
over no events: it is published before the stream starts, for readers ahead of its first trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideglass.functions.hashing import context_hash
from tideglass.operators.dimension import fold, identity_partials, number_windows
from tideglass.operators.summary import kind_counts, summarise
from tideglass.schemas import IDENTITY, UNKNOWN_APP
from tideglass.session import delete_folder, scratch_scope, shared_folder
from tideglass.streaming.pipeline import ALL_AVAILABLE


KEPT_RESULTS = 2
NO_EVENTS = -1


def _published(spark: SparkSession, path: str) -> list[int]:
    """Published batches in order; at most KEPT_RESULTS and one."""
    try:
        marks = spark.read.schema("number bigint").json(f"{path}/published/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(row["number"] for row in marks.collect())


def running_result(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole result of a running stream, that over no events before its first trigger."""
    return spark.read.parquet(f"{path}/results/batch={_published(spark, path)[-1]}")


def stream_dimension(
    arrivals: DataFrame, path: str, checkpoint: str, trigger: dict = ALL_AVAILABLE
) -> StreamingQuery:
    """Keep the whole window dimension; read it with `running_result`."""
    return _start(
        identity_partials(arrivals),
        lambda state: number_windows(fold(state)),
        path,
        checkpoint,
        trigger,
    )


def stream_summary(
    arrivals: DataFrame, path: str, checkpoint: str, trigger: dict = ALL_AVAILABLE
) -> StreamingQuery:
    """Keep the activity summary of all events so far; read it with `running_result`."""
    counts = (
        arrivals.select(
            *[F.col(f"window.{name}").alias(name) for name in IDENTITY],
            F.col("kind").alias("event_kind"),
        )
        .groupBy(*IDENTITY)
        .agg(*kind_counts())
    )
    return _start(counts, summary_of_counts, path, checkpoint, trigger)


def summary_of_counts(counts: DataFrame) -> DataFrame:
    """Summary from counts per identity; spellings of one window count once."""
    numbers = [name for name in counts.columns if name not in IDENTITY]
    has_window = F.col("app_name").isNotNull()
    hashed = counts.withColumn(
        "context_hash", F.when(has_window, context_hash(*[F.col(name) for name in IDENTITY]))
    )
    per_window = hashed.groupBy("context_hash").agg(
        F.coalesce(F.min("app_name"), F.lit(UNKNOWN_APP)).alias("app_name"),
        *[F.sum(name).alias(name) for name in numbers],
    )
    return summarise(
        per_window.withColumn(
            "active_windows", F.col("context_hash").isNotNull().cast("bigint")
        )
    )


def _start(
    state: DataFrame,
    finish: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    trigger: dict,
) -> StreamingQuery:
    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            finish(batch).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        mark = spark.range(1).select(F.lit(number).cast("bigint").alias("number"))
        mark.coalesce(1).write.mode("overwrite").json(f"{path}/published/batch={number}")
        for old in _published(spark, path)[:-KEPT_RESULTS]:
            delete_folder(spark, f"{path}/published/batch={old}")
            delete_folder(spark, f"{path}/results/batch={old}")

    spark = state.sparkSession
    shared_folder(spark, path)
    shared_folder(spark, checkpoint)
    if not _published(spark, path):
        publish(spark.createDataFrame([], state.schema), NO_EVENTS)
    return (
        state.writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
