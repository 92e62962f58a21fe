"""Reading tables, shipping the package to Python workers, and text batches as arrays."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tideglass

#: Characters of text a worker holds as arrays at a time; a longer document is taken alone.
CHUNK_CHARS = 1 << 20

#: Bytes of rows that Spark hands to a worker at a time, where the session does not say it.
#: Whole texts come in batches of 10,000 rows otherwise, tens of megabytes on both sides.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once per application.

    Same as `--py-files`: workers import the modules however the driver found them. Bounds
    the batches of texts that workers hold, too.
    """
    if spark.conf.get(_BATCH) == "67108864b":  # Spark's default
        spark.conf.set(_BATCH, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(tideglass.__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="tideglass-"), "tideglass-src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as bundle:
            for source in sorted(package.rglob("*.py")):
                bundle.write(source, source.relative_to(package.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark


_POOL = pa.default_memory_pool()


def give_back() -> None:
    """In a worker: return freed memory to the system, as far as the C library can.

    Arrow's own pool keeps freed buffers, the system's does not, so that one is used from now on.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    _POOL.release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """`run` for `mapInArrow`, in a worker that keeps no memory of the batches when its task ends.

    Workers serve many tasks and stages, and several share a machine: what one holds while
    idle is taken from the others.
    """

    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return wrapped


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text only: a null text counts as empty, other columns do not matter."""
    return docs.select(
        F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text)
    )


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; no text is cut."""
    column = batch.column(batch.schema.get_field_index(text))
    if len(column) == 0:
        return
    sizes = np.asarray(column.cast(pa.large_string()).buffers()[1]).view(np.int64)
    offsets = sizes[column.offset : column.offset + len(column) + 1]
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield batch.slice(begin, end - begin)
        begin = end


def rows_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=f.type) for values, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
