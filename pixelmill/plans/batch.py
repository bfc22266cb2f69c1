"""Work items of a batch: output path, existing outputs, skip reason, ledger rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pixelmill.functions.filters import SkipRules, skip_reason
from pixelmill.functions.paths import base_name, output_path, parent_dir
from pixelmill.operators.catalog import mark_existing
from pixelmill.operators.names import unique_names


def _free_names(items: DataFrame, outputs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Items with output paths that neither a file nor another item has."""
    split = lambda path: (parent_dir(path), base_name(path))
    folder, name = split(F.col("output_path"))
    kept = [c for c in items.columns if c != "output_path"]
    # Only these columns take part, whatever the items' own are called.
    asked = items.select(
        F.struct(*kept).alias("item"), *[F.col(c).alias(f"order{k}") for k, c in enumerate(order)], folder.alias("dir"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("base"), F.regexp_extract(name, r"\.[^.]*$", 0).alias("ext"),
    )
    there = outputs.select(*(c.alias(n) for c, n in zip(split(F.col("output_path")), ("dir", "name"))))
    named = unique_names(asked, there, [f"order{k}" for k in range(len(order))])
    return named.select("item.*", F.concat("dir", F.lit("/"), "name").alias("output_path"))


def plan_items(
    assets: DataFrame, outputs: DataFrame, rules: SkipRules, overwrite: bool = True,
    order: Sequence[str] = ("path",), **naming,
) -> DataFrame:
    """Assets with `output_path`, `exists` and `reason`; a null reason means: do it.

    With `overwrite` off every item first gets a free name in `order`, so none of them
    exists when the rules are asked.
    """
    named = assets.withColumn("output_path", output_path(F.col("path"), **naming))
    if not overwrite:
        named = _free_names(named, outputs, list(order))
    marked = mark_existing(named, outputs)
    return marked.withColumn(
        "reason", skip_reason(rules, F.col("width"), F.col("height"), F.col("exists"))
    )


def skipped_entries(items: DataFrame, run_id: int, model: str) -> DataFrame:
    """Ledger rows of the items left out."""
    return items.where(F.col("reason").isNotNull()).select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.col("path").alias("input_path"), "output_path",
        F.lit(model).alias("model"), F.lit("skipped").alias("status"), "reason",
        F.lit(0.0).alias("elapsed_s"), F.current_timestamp().alias("ts"),
    )
