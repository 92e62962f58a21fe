"""Streams into the stored timeline, one committed version per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tideglass.session import shared_folder
from tideglass.sources.lines import FILE_ORDER
from tideglass.store import SourceBatch, TimelineStore

ALL_AVAILABLE = {"availableNow": True}


def stream_lines(
    store: TimelineStore,
    lines: DataFrame,
    checkpoint: str,
    source: str,
    prefix: str = "",
    trigger: dict = ALL_AVAILABLE,
    order_by: Sequence[str] = FILE_ORDER,
) -> StreamingQuery:
    """Decode a stream of text lines into the store; malformed lines are quarantined.

    `source` names the feed. A micro-batch is known by the id kept in the checkpoint and its
    number; after a lost checkpoint the files taken before are left out, and only they.
    Events may come arbitrarily late, so there is no watermark.
    """

    def apply(batch: DataFrame, number: int) -> None:
        named = SourceBatch(source, stream_id(batch.sparkSession, checkpoint), number)
        TimelineStore(batch.sparkSession, store.root).ingest_lines(batch, prefix, named, order_by)

    return _start(lines, apply, checkpoint, trigger)


def stream_payloads(
    store: TimelineStore,
    payloads: DataFrame,
    checkpoint: str,
    source: str,
    trigger: dict = ALL_AVAILABLE,
    order_by: Sequence[str] = (),
) -> StreamingQuery:
    """Append a stream of payloads, by their `event_id`s or numbered by `order_by`."""

    def apply(batch: DataFrame, number: int) -> None:
        named = SourceBatch(source, stream_id(batch.sparkSession, checkpoint), number)
        TimelineStore(batch.sparkSession, store.root).ingest(batch, named, order_by)

    return _start(payloads, apply, checkpoint, trigger)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a stream keeps in its checkpoint folder, the same after every restart."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def _start(stream: DataFrame, apply, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", shared_folder(stream.sparkSession, checkpoint))
        .trigger(**trigger)
        .start()
    )
