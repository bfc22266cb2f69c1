"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pixelmill.llm.tables import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b); component is the least node reachable.

    Alternating stars: each node hands its larger neighbours to its least neighbour, then its
    smaller ones, until nothing moves. A round only regroups the links there are, so the table
    never grows, and a chain shortens to half or less.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.distinct())
        if (now := _state(edges)) == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
