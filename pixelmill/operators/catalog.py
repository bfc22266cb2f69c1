"""Work-item look-ups: existing outputs, model queues, stale artifacts, profiles, sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pixelmill.functions.filters import aspect_ratio
from pixelmill.functions.metadata import keep_png_text, read_model_list, strip_exif
from pixelmill.functions.paths import is_image_suffix
from .skew import ordered


def filter_extension(assets: DataFrame, column: str = "ext") -> DataFrame:
    return assets.where(is_image_suffix(F.col(column)))


def mark_existing(assets: DataFrame, outputs: DataFrame, on: str = "output_path") -> DataFrame:
    """Adds `exists`: whether the output path is already there."""
    there = outputs.select(on).distinct().withColumn("__there", F.lit(True))
    return (
        assets.join(there, on, "left")
        .withColumn("exists", F.coalesce("__there", F.lit(False))).drop("__there")
    )


def model_queue(assets: DataFrame, models: DataFrame, queue: Column) -> DataFrame:
    """Every item once per model of the queue, in queue order, missing models dropped.

    `queue` is a JSON list of paths (one run's setting). It is exploded inside the
    item's row; the model listing is only asked whether a path exists.
    """
    known = models.select(F.col("path").alias("model_path")).distinct()
    listed = assets.select("*", F.posexplode(read_model_list(queue)).alias("model_pos", "model_path"))
    return listed.join(known, "model_path", "left_semi")


def stale(inputs: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """Inputs whose artifact is missing or not newer than they are."""
    built = artifacts.groupBy(key).agg(F.max("mtime").alias("__built"))
    return (
        inputs.join(built, key, "left")
        .where(F.col("__built").isNull() | (F.col("__built") <= F.col("mtime"))).drop("__built")
    )


def copy_metadata(target: DataFrame, source: DataFrame) -> DataFrame:
    """Puts the cleaned metadata of the source picture on each output of it."""
    meta = source.select(
        "image_id", strip_exif(F.col("exif")).alias("exif"), keep_png_text(F.col("text")).alias("text")
    )
    return target.join(meta, "image_id", "left")


def output_collisions(assets: DataFrame, column: str = "output_path") -> DataFrame:
    """Output paths that more than one item would write."""
    return assets.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def aspect_class(width: Column, height: Column) -> Column:
    ratio = aspect_ratio(width, height)
    return (
        F.when(width.isNull() | height.isNull(), "unknown")
        .when(ratio.between(0.95, 1.05), "square")
        .when(ratio > 1.0, "landscape").otherwise("portrait")
    )


def corpus_profile(assets: DataFrame) -> DataFrame:
    """Counts and bytes by suffix and aspect class, with subtotals (null = all)."""
    return (
        assets.withColumn("suffix", F.lower("ext"))
        .withColumn("aspect", aspect_class(F.col("width"), F.col("height")))
        .rollup("suffix", "aspect")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"),
            F.max("width").alias("max_width"), F.max("height").alias("max_height"),
            F.grouping_id().alias("level"),
        )
    )


def ready_files(listings: DataFrame) -> DataFrame:
    """Looks (path, size_bytes, seen_at) at which a file's size is positive and unchanged."""
    seen = ordered(listings, ["path"], ["seen_at", "look_id"], previous={"__before": "size_bytes"})
    return seen.where((F.col("size_bytes") > 0) & (F.col("__before") == F.col("size_bytes"))).drop("__before")


def new_files(current: DataFrame, previous: DataFrame, on: str = "path") -> DataFrame:
    return current.join(previous.select(on), on, "left_anti")


def remove(items: DataFrame, selected: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    return items.join(selected.select(*on), list(on), "left_anti")


def add_unique(a: DataFrame, b: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """List `a` followed by what `b` adds to it; first occurrences, with their place."""
    tagged = a.select(F.lit(0).alias("list_no"), pos, key).unionByName(b.select(F.lit(1).alias("list_no"), pos, key))
    return (
        tagged.groupBy(key).agg(F.min(F.struct("list_no", pos)).alias("s"))
        .select(key, "s.list_no", F.col(f"s.{pos}").alias(pos))
    )
