"""Global order: natural sort, exact global rank, first n, largest first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pixelmill.functions.paths import natural_key
from .skew import rank_within


def natural_sort(df: DataFrame, column: str = "path") -> DataFrame:
    """Range-partitioned sort by natural key; equal keys tie on the text itself."""
    return df.orderBy(natural_key(F.col(column)), F.col(column))


def global_rank(df: DataFrame, column: str = "path", name: str = "rank") -> DataFrame:
    """Exact 0-based position in the natural order, without one big task; equal texts in any order.

    The ordered scan of `skew` with no key at all: as many range partitions as the session shuffles into,
    each with the count of those before it.
    """
    keyed = df.withColumn("__key", natural_key(F.col(column)))
    return rank_within(keyed, [], ["__key", column], name).drop("__key")


def resume_from(df: DataFrame, index: int, column: str = "path") -> DataFrame:
    """The naturally sorted list without its first `index` entries."""
    return global_rank(df, column, "__rank").where(F.col("__rank") >= index).drop("__rank")


def largest_first(page_images: DataFrame, name: str = "rank") -> DataFrame:
    """Adds each image's 1-based place on its page: by area, largest first; equal areas keep phase and document order."""
    area = F.col("width").cast("bigint") * F.col("height").cast("bigint")
    page = Window.partitionBy("page_id").orderBy(area.desc(), "phase", "pos", "sub")
    return page_images.withColumn(name, F.row_number().over(page))


def recent(history: DataFrame, n: int = 10, key: str = "path", at: str = "used_at") -> DataFrame:
    """The n most recently used distinct entries, newest first."""
    return history.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.desc(at), key).limit(n)


def top_per_key(
    counts: DataFrame, keys: Sequence[str], by: Sequence[Column], n: int, name: str = "rank"
) -> DataFrame:
    """First n rows per key. The rank limit is pushed below the shuffle by Spark."""
    window = Window.partitionBy(*keys).orderBy(*by)
    return counts.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
