"""Session settings and the shared scratch folder."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Without it a variant refuses an object with a member given twice, which JSON readers take.
REPEATS_ALLOWED = "spark.sql.variant.allowDuplicateKeys"


def build_session(app_name: str = "tideglass", **conf: str) -> SparkSession:
    """A session with the settings the library expects; `conf` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        REPEATS_ALLOWED: "true",
        # Call sites recorded per column cost more than planning a small query.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what the library relies on: instants in UTC, as the model stores and partitions by
    UTC date, and JSON objects that may repeat a member.
    """
    if spark.conf.get(REPEATS_ALLOWED) != "true":
        spark.conf.set(REPEATS_ALLOWED, "true")
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own through the file system it is on."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables materialised within are dropped at the end: for calls that commit their result.

    Nothing lazy may leave the scope. An inner scope leaves its tables to the outer one.
    """
    if _scope.get() is not None:
        yield
        return
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            delete_folder(spark, path)


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediates: the session's checkpoint folder.

    Only a local master may fall back to a folder of its own; on a cluster a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="tideglass-")
        context.setCheckpointDir(configured)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _local_path(path: str) -> str | None:
    """The plain path of a `file:` address, else None."""
    scheme = path.split("://")[0] if "://" in path else path.split(":/")[0]
    return posixpath.normpath("/" + path.removeprefix("file:").lstrip("/")) if scheme == "file" else None


def shared_folder(spark: SparkSession, path: str) -> str:
    """`path`, unless it lies on a machine's own disk while the session runs on a cluster.

    The session's checkpoint folder is shared by all executors, on whatever file system, and so
    is all below it. A `local-cluster` master and `spark.tideglass.sharedLocalFolders=true` (a
    mount that all machines share) may use other local paths too.
    """
    context = spark.sparkContext
    if context.master.startswith("local") or spark.conf.get("spark.tideglass.sharedLocalFolders", "false") == "true":
        return path
    local = _local_path(path)
    if local is not None:
        shared = _local_path(context.getCheckpointDir() or "")
        if shared is None or not f"{local}/".startswith(f"{shared}/"):
            raise RuntimeError(f"{path} is a machine's own folder; all executors must share it")
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back.

    Cuts lineage, so that a lost executor does not replay the plan above and so
    that several readers see the same rows. Columnar, so that each reader prunes.
    """
    spark = df.sparkSession
    path = shared_folder(spark, f"{scratch_folder(spark)}/tables/{uuid.uuid4().hex}")
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
