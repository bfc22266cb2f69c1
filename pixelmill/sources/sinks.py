"""Writers: raster tables, log export, raw video files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def write_rasters(rasters: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Raster rows as parquet, in folders by a hash bucket of the picture.

    Rows are spread by (picture, row band) within their folder, so one huge picture is
    written by several tasks and many small ones by as many tasks as there are.
    """
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int")
    (
        rasters.withColumn("bucket", bucket)
        .repartition("bucket", "image_id", F.floor(F.col("y") / 1024))
        .write.mode(mode).partitionBy("bucket").parquet(path)
    )


def read_rasters(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def export_log_csv(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One column `Entry`, every value quoted, quotes doubled."""
    (
        entries.select(F.col("entry").alias("Entry")).write.mode(mode)
        .option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    )


@dataclass
class _Written(WriterCommitMessage):
    """Files of one task under their passing names, with the names they get."""

    files: list[tuple[str, str]]


class _Y4mWriter(DataSourceWriter):
    """Streams the parts of each animation into a file of a passing name; commit gives it its own."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, folder = FileSystem.from_uri(self.path)
        now, out, at, files = None, None, 0, []
        attempt = TaskContext.get().taskAttemptId()
        try:
            for row in rows:
                if out is None or row.anim_id != now:
                    if out is not None:
                        out.close()
                    now, at = row.anim_id, 0
                    name = f"{folder}/{quote(str(now), safe='')}.y4m"
                    files.append((f"{name}.{attempt}", name))
                    out = store.open_output_stream(files[-1][0])
                if row.offset != at:
                    raise ValueError(f"animation {now}: {at} bytes are there where a part begins at {row.offset}")
                out.write(bytes(row.bytes))
                at += len(row.bytes)
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = FileSystem.from_uri(self.path)
        for message in messages:
            for passing, name in message.files if message else ():
                store.move(passing, name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = FileSystem.from_uri(self.path)
        for message in messages:
            for passing, _ in message.files if message else ():
                store.delete_file(passing)


class Y4mFiles(DataSource):
    """One file per animation from sorted parts (anim_id, offset, bytes)."""

    @classmethod
    def name(cls) -> str:
        return "y4m_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Y4mWriter(self.options["path"])


def write_y4m(parts: DataFrame, path: str) -> None:
    """The parts of `frames.y4m_parts` as one file per animation, `<anim_id>.y4m`, in a folder given as an address (file:, hdfs:, s3:).

    An animation's parts stream through one task in order; no row and no list holds a frame. A missing or
    repeated part is an error. Files appear when all are written.
    """
    spark = parts.sparkSession
    spark.dataSource.register(Y4mFiles)
    store, folder = FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    ordered = parts.select("anim_id", "offset", "bytes").repartition("anim_id").sortWithinPartitions("anim_id", "offset")
    ordered.write.format("y4m_files").mode("append").save(path)
