"""A watched folder: new files once each, then the usual chain, then the ledger."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelmill.functions.paths import is_image_suffix, parent_dir, suffix
from pixelmill.operators.ordering import natural_sort
from pixelmill.sources.files import BINARY_SCHEMA, local_path, without_scheme

SETTLE = "1 second"  # fixed value: silence after which a group of changes is taken


def watch_folder(
    spark: SparkSession, folder: str, since: datetime | None = None, max_files: int | None = None
) -> DataFrame:
    """New image files of one folder, not of the folders below it.

    The source's checkpoint remembers which files were seen. `since` ignores files
    that were there before. `max_files` bounds a micro-batch; the rest waits.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(folder).select(
        local_path(F.col("path")).alias("path"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"),
    )
    here = without_scheme(parent_dir(F.col("path"))) == without_scheme(F.lit(folder.rstrip("/")))
    files = files.where(here & is_image_suffix(suffix(F.col("path"))))
    return files if since is None else files.where(F.col("mtime") > F.lit(since))


def settle(changes: DataFrame, at: str = "ts", key: str = "folder", gap: str = SETTLE, late: str = "10 seconds") -> DataFrame:
    """Groups of changes with no silence longer than `gap`, per folder, once closed.

    On a stream the group appears after the watermark has passed its end; the same
    call on a table gives every group.
    """
    return (
        changes.withWatermark(at, late)
        .groupBy(key, F.session_window(at, gap))
        .agg(F.count(F.lit(1)).alias("n_changes"))
        .select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_changes")
    )


def process_new_files(
    files: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    ledger_path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Runs `process` on each micro-batch of files and appends its ledger rows.

    `process` gets the files that are not done yet and returns one ledger row per file
    (input_path and status first of all). Batches run one at a time. The ledger is
    written after the work, in folders by the day of the file's time: a batch reads only the
    days of its own files, leaves out what is finished there, and takes up what failed, so a
    batch that is run again does no file twice.
    """
    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("day", F.to_date("mtime"))
        todo = dated
        if _exists(spark, ledger_path):
            # A semi join on the partition column: the engine prunes the other days at run time.
            before = spark.read.parquet(ledger_path).join(dated.select("day").distinct(), "day", "left_semi")
            gone = before.where(F.col("status") != "failed").select(F.col("input_path").alias("path")).distinct()
            todo = dated.join(gone, "path", "left_anti")
        days = todo.select(F.col("path").alias("input_path"), "day")
        # In the natural order of their paths, as the watched list shows them.
        done = process(natural_sort(todo.drop("day")))
        done.join(days, "input_path").write.mode("append").partitionBy("day").parquet(ledger_path)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def failed_files(ledger: DataFrame) -> DataFrame:
    """Paths whose latest ledger row says failed: what a later run takes up again (input_path, status, ts)."""
    last = ledger.groupBy("input_path").agg(F.max_by("status", "ts").alias("status"))
    return last.where(F.col("status") == "failed").select(F.col("input_path").alias("path"))
