"""Fetched pages and chapter manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Size given to a manifest's images, which is unknown until download.
MANIFEST_WIDTH, MANIFEST_HEIGHT = 1000, 1500

_MANIFEST = "baseUrl string, chapter struct<hash:string,data:array<string>>"


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (page_id, url, html) from parquet; unused columns are not read."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def chapter_id(url):
    """Identifier in a chapter address, or the empty string."""
    return F.regexp_extract(url, r"/chapter/([a-f0-9-]+)", 1)


def read_manifest_json(replies: DataFrame) -> DataFrame:
    """Chapter manifests (page_id, url, json) to one row per image, in order.

    A manifest with a missing part, and an address without an identifier, give none.
    """
    m = F.from_json("json", _MANIFEST)
    full = (
        replies.withColumn("m", m)
        .where(
            (chapter_id(F.col("url")) != "")
            & (F.col("m.baseUrl") != "") & (F.col("m.chapter.hash") != "")
            & (F.size("m.chapter.data") > 0)
        )
    )
    return full.select(
        "page_id", chapter_id(F.col("url")).alias("chapter_id"),
        F.col("m.baseUrl").alias("base"), F.col("m.chapter.hash").alias("hash"),
        F.posexplode("m.chapter.data").alias("pos", "file"),
    ).select(
        "page_id", "chapter_id", "pos",
        F.concat_ws("/", "base", F.lit("data"), "hash", "file").alias("url"),
        F.lit(MANIFEST_WIDTH).alias("width"), F.lit(MANIFEST_HEIGHT).alias("height"),
        F.concat(F.lit("Page "), (F.col("pos") + 1).cast("string")).alias("alt"),
    )
