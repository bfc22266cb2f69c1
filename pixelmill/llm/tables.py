"""Tables kept in the cluster's shared folder, and the number of buckets a shuffle gets."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from pixelmill.llm.textarrays import Memo

#: Whether the engine removes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The bytes of a batch on its way to Python, and what they are where the session says nothing: the engine's 64 MB and as much again
#: while its buffers double, in each task, and twice in its Python worker.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast of a value of any class; what is returned gives the value inside a task.

    It goes as bytes that hold this package's classes, too: a broadcast of the value itself names them
    only, and executors have no copy of the package.
    """
    held, seen = spark.sparkContext.broadcast(cloudpickle.dumps(value)), Memo()

    def get() -> Any:
        if "value" not in seen:
            seen["value"] = cloudpickle.loads(held.value)
        return seen["value"]

    return get


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of its own only where that is unset on a single machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pixelmill-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """From now on batches of texts go to Python workers in BATCH_BYTES, unless the session has a limit of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended and its folder goes with the cluster
        return


def stage(df: DataFrame, lean: bool = False) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them back.

    Lost executors cost no recomputation beyond the files' readers, and a table used twice is
    made once. The files go when the program ends, or by `discard`. Lean: files by zstd, and the
    shuffles behind them go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    if lean:
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path, compression="zstd")
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    else:
        df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that `stage` returned; nothing may read them afterwards."""
    for table in tables:
        _remove(table.sparkSession, table.staged_at)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
