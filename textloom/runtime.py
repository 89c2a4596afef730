"""Session-level helpers shared by the operators: shared storage, lineage cuts, sizing."""

from __future__ import annotations

import atexit
import shutil
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting that removes a finished query's shuffle files (Spark 4.1); ignored where unknown.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Where a local session without the setting keeps its tables; each process removes its own when it ends.
_LOCAL = "/tmp/checkpoints"
_written: list[str] = []
#: Per thread, the tables that each settled() around has to remove.
_scratch = threading.local()


@atexit.register
def _remove_local_tables() -> None:
    for path in _written:
        shutil.rmtree(path, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read and write.

    It is the one named by ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one process, falls back to a folder of its own when the setting is absent.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{_LOCAL}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet to the shared folder and return a DataFrame that reads it.

    It cuts the lineage the durable way: a lost executor costs its running tasks, never the work
    behind the table. Shuffle files of the finished query are released where Spark can do so.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    if path.startswith(f"file://{_LOCAL}/"):
        _written.append(path.removeprefix("file://"))
    for tables in getattr(_scratch, "open", [])[-1:]:
        tables.append(path)
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame], spark: SparkSession, name: str = "t") -> DataFrame:
    """Write what build() returns, as materialize() does, and then remove the tables that were written on the way.

    Only the result is read from then on, so that a long-lived cluster's folder keeps results alone.
    """
    if not hasattr(_scratch, "open"):
        _scratch.open = []
    _scratch.open.append([])
    try:
        df = build()
    finally:
        tables = _scratch.open.pop()
    out = materialize(df, name)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in tables:
        at = hadoop(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size of a scan with projections and filters: the bytes of its files; None where that is a guess."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return None if size >= 1 << 56 or "Join" in plan.toString() else size


def parts_for(df: DataFrame, text: str, bytes_each: int, least: int = 1) -> int:
    """How many pieces of about bytes_each the input makes; grows with the input.

    The size is that of the files where the plan is a plain scan, else that of the text column, counted.
    """
    size = plan_bytes(df.select(text))
    if size is None:
        size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-size // bytes_each))


def small_batches(df: DataFrame, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch for the session, as texts are long: a batch is a copy in three places."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))
