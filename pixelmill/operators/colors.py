"""Colour reduction by popularity and by median cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pixelmill.functions.pixels import flatten_on_white
from .batches import groups, met
from .frames import flat_rows
from .ordering import top_per_key

BITS = 5  # bits kept per channel: at most 32,768 colours per picture


def color_code(r: Column, g: Column, b: Column) -> Column:
    """15-bit code of an 8-bit colour."""
    cut = lambda a: F.shiftright(a, 8 - BITS)
    return F.shiftleft(cut(r), 2 * BITS) + F.shiftleft(cut(g), BITS) + cut(b)


def color_counts(rasters: DataFrame, on_white: bool = False) -> DataFrame:
    """Pixels per (picture, 15-bit colour), as they are or over white; combined before the shuffle."""
    rows = flat_rows(rasters)
    if on_white:
        over = lambda name: F.when(F.col("a").isNull(), F.col(name)).otherwise(
            F.zip_with(name, "a", lambda p, alpha: F.floor(flatten_on_white(p, alpha / 255.0)).cast("int"))
        )
        rows = rows.withColumns({name: over(name) for name in "rgb"})
    codes = F.transform(F.arrays_zip("r", "g", "b"), lambda p: color_code(p["r"], p["g"], p["b"]))
    return rows.select("image_id", F.explode(codes).alias("color")).groupBy("image_id", "color").agg(
        F.count(F.lit(1)).alias("n")
    )


def top_colors(rasters: DataFrame, n: int) -> DataFrame:
    """The n most frequent colours of every picture; equal counts take the lower code."""
    return top_per_key(color_counts(rasters), ["image_id"], [F.desc("n"), F.col("color")], n)


def palette_map(rasters: DataFrame, n: int = 16) -> DataFrame:
    """For every colour of a picture its nearest palette colour (squared distance).

    The palette of a picture is one array of at most n entries, and a picture has at
    most 32,768 colours: nothing here grows with the number of pixels but the count.
    """
    counts = color_counts(rasters)
    best = top_per_key(counts, ["image_id"], [F.desc("n"), F.col("color")], n)
    palettes = best.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "color"))).alias("palette"))
    part = lambda code, shift: F.shiftright(code, shift).bitwiseAND(F.lit((1 << BITS) - 1))

    def distance(code: Column) -> Column:
        total = F.lit(0)
        for shift in (2 * BITS, BITS, 0):
            d = part(code, shift) - part(F.col("color"), shift)
            total = total + d * d
        return total

    nearest = F.array_min(F.transform(
        "palette", lambda p: F.struct(distance(p["color"]).alias("d"), p["rank"].alias("rank"), p["color"].alias("color"))
    ))
    return (
        counts.join(palettes, "image_id")
        .withColumn("near", nearest)
        .select("image_id", "color", "n", F.col("near.color").alias("palette_color"), F.col("near.d").alias("dist"))
    )


def median_cut(codes: np.ndarray, n: np.ndarray, colors: int) -> tuple[np.ndarray, np.ndarray]:
    """The palette entry of each 15-bit colour, and the palette as rows of 8-bit (r, g, b).

    The box with the most pixels that holds two colours or more is cut, the first of equals, across its
    widest channel (red, green, blue in ties), after the colour that completes half of its pixels; both
    sides keep a colour. An entry is the mean of its box.
    """
    parts = np.stack([codes >> shift & (1 << BITS) - 1 for shift in (2 * BITS, BITS, 0)], 1)
    boxes = [np.arange(len(codes))]
    sizes = [int(n.sum()) if len(codes) > 1 else 0]
    while len(boxes) < colors and max(sizes) > 0:
        k = int(np.argmax(sizes))
        own = boxes[k]
        channel = int(np.argmax(np.ptp(parts[own], axis=0)))
        own = own[np.lexsort((codes[own], parts[own, channel]))]
        reached = np.cumsum(n[own])
        cut = min(int(np.searchsorted(2 * reached, reached[-1])) + 1, len(own) - 1)
        halves = own[:cut], own[cut:]
        boxes[k] = halves[0]
        boxes.append(halves[1])
        sizes[k], more = (int(n[h].sum()) if len(h) > 1 else 0 for h in halves)
        sizes.append(more)
    entry, palette = np.zeros(len(codes), np.int64), []
    middle = parts * (1 << 8 - BITS) + (1 << 7 - BITS)
    for k, own in enumerate(boxes):
        entry[own] = k
        palette.append((middle[own] * n[own, None]).sum(0) // n[own].sum())
    return entry, np.array(palette)


def adaptive_palette(rasters: DataFrame, colors: int = 256) -> DataFrame:
    """For every 15-bit colour of a picture, over white, its entry in a palette of its own: image_id, color, n, entry, r, g, b.

    A picture comes as its histogram, at most 32,768 rows whatever its size.
    """
    counts = color_counts(rasters, on_white=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["image_id"]):
            entry, palette = median_cut(group.column("color").to_numpy().astype(np.int64), group.column("n").to_numpy(), colors)
            own = [pa.array(palette[entry, c].astype(np.int32)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*group.columns, pa.array(entry.astype(np.int32)), *own], ["image_id", "color", "n", "entry", "r", "g", "b"])

    schema = f"image_id {dict(counts.dtypes)['image_id']}, color int, n long, entry int, r int, g int, b int"
    return met(counts.withColumn("color", F.col("color").cast("int")), ["image_id"], ["color"]).mapInArrow(run, schema)
