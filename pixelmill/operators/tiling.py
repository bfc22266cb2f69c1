"""Tiles: grids, cutting, padding, cropping, blending, model inference.

`raster_rows` is the format of every raster here: one record per picture row and
channel, `image_id LONG, c INT, y INT, h INT, v ARRAY<DOUBLE>`; `h` is the picture
height, so no operator has to gather a picture to learn its size. No operator puts a
whole picture into one task: the units are a row and a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pixelmill.functions.pixels import mirror
from .batches import lists, met, whole_groups

ALIGNMENT = 64  # fixed value: tile sides are cut to a multiple of this
TINY_WEIGHT = 1e-8  # fixed value: below this a blended value is left as it is
CACHED_AXES = 64  # weights of picture sides a task keeps at a time


def aligned_tile(side: int, align: bool = True) -> int:
    return (side // ALIGNMENT) * ALIGNMENT if align else side


def _check(tile_w: int, tile_h: int, overlap: int) -> None:
    if tile_w <= 0 or tile_h <= 0:
        raise ValueError("tile sides must be positive (they are cut to multiples of 64)")
    if overlap < 0 or 2 * overlap >= min(tile_w, tile_h):
        raise ValueError("twice the overlap must be smaller than the tile")


def tiles_along(size: Column, tile: int, overlap: int) -> Column:
    """Number of tiles along one axis."""
    step = tile - 2 * overlap
    return F.greatest(F.lit(1), F.ceil((size - overlap) / step)).cast("int")


def tile_grid(
    images: DataFrame, tile_w: int = 512, tile_h: int = 512, overlap: int = 16, align: bool = True
) -> DataFrame:
    """One row per tile of every (image_id, w, h)."""
    tile_w, tile_h = aligned_tile(tile_w, align), aligned_tile(tile_h, align)
    _check(tile_w, tile_h, overlap)
    step_x, step_y = tile_w - 2 * overlap, tile_h - 2 * overlap
    nx, ny = tiles_along(F.col("w"), tile_w, overlap), tiles_along(F.col("h"), tile_h, overlap)
    return (
        images.where((F.col("w") > 0) & (F.col("h") > 0))
        .withColumn("nx", nx)
        .withColumn("iy", F.explode(F.sequence(F.lit(0), ny - 1)))
        .withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
        .select(
            "image_id",
            (F.col("iy") * F.col("nx") + F.col("ix")).alias("tile_no"),
            (F.col("ix") * step_x).alias("x0"),
            (F.col("iy") * step_y).alias("y0"),
            F.least(F.lit(tile_w), F.col("w") - F.col("ix") * step_x).alias("tw"),
            F.least(F.lit(tile_h), F.col("h") - F.col("iy") * step_y).alias("th"),
        )
    )


def _covering(pos: Column, size: Column, tile: int, overlap: int) -> Column:
    """Numbers of the tiles along an axis that contain `pos`."""
    step = tile - 2 * overlap
    first = F.greatest(F.lit(0), F.ceil((pos - tile + 1) / step)).cast("int")
    last = F.least(tiles_along(size, tile, overlap) - 1, F.floor(pos / step)).cast("int")
    return F.sequence(first, last)


def tiles_for_pixels(pixels: DataFrame, tile_w: int, tile_h: int, overlap: int) -> DataFrame:
    """Every pixel (image_id, w, h, c, y, x, v) with each tile that holds it.

    The tiles are computed, not joined: a pixel lies in a few tiles per axis, and
    their numbers follow from its position.
    """
    _check(tile_w, tile_h, overlap)
    return (
        pixels
        .withColumn("iy", F.explode(_covering(F.col("y"), F.col("h"), tile_h, overlap)))
        .withColumn("ix", F.explode(_covering(F.col("x"), F.col("w"), tile_w, overlap)))
        .withColumn("tile_no", F.col("iy") * tiles_along(F.col("w"), tile_w, overlap) + F.col("ix"))
        .withColumn("ty", F.col("y") - F.col("iy") * (tile_h - 2 * overlap))
        .withColumn("tx", F.col("x") - F.col("ix") * (tile_w - 2 * overlap))
        .drop("iy", "ix")
    )


def tile_rows(rasters: DataFrame, tile_w: int, tile_h: int, overlap: int) -> DataFrame:
    """Cuts raster rows into tile rows; narrow, no shuffle.

    Adds `w` (picture width), `tile_no`, the tile's place `x0, y0` and size `tw, th`,
    and `ty`, the row inside the tile.
    """
    _check(tile_w, tile_h, overlap)
    step_x, step_y = tile_w - 2 * overlap, tile_h - 2 * overlap
    cut = (
        rasters.withColumn("w", F.size("v"))
        .withColumn("iy", F.explode(_covering(F.col("y"), F.col("h"), tile_h, overlap)))
        .withColumn("nx", tiles_along(F.col("w"), tile_w, overlap))
        .withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    )
    return cut.select(
        "image_id", "c", "w", "h",
        (F.col("iy") * F.col("nx") + F.col("ix")).alias("tile_no"),
        (F.col("ix") * step_x).alias("x0"),
        (F.col("iy") * step_y).alias("y0"),
        F.least(F.lit(tile_w), F.col("w") - F.col("ix") * step_x).alias("tw"),
        F.least(F.lit(tile_h), F.col("h") - F.col("iy") * step_y).alias("th"),
        (F.col("y") - F.col("iy") * step_y).alias("ty"),
        F.slice("v", F.col("ix") * step_x + 1, F.lit(tile_w)).alias("v"),
    )


def nearest_rows(tiles: DataFrame, scale: int) -> DataFrame:
    """Nearest-neighbour enlargement of tile rows: the built-in stand-in model."""
    wide = F.flatten(F.transform("v", lambda a: F.array_repeat(a, scale)))
    return (
        tiles.withColumn("v", wide)
        .withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(scale - 1))))
        .withColumn("ty", F.col("ty") * scale + F.col("__r"))
        .drop("__r")
        .transform(lambda d: _scaled(d, scale))
    )


def _scaled(tiles: DataFrame, scale: int) -> DataFrame:
    for name in ("w", "h", "x0", "y0", "tw", "th"):
        tiles = tiles.withColumn(name, F.col(name) * scale)
    return tiles


def _ramp(length: int, ramp: int, start: bool, end: bool, inclusive: bool) -> np.ndarray:
    """Blend weights along one side of a tile."""
    at = np.arange(length)
    steps = max(ramp - 1, 1) if inclusive else max(ramp, 1)
    fade = lambda far: np.where(far < ramp, far / steps, 1.0)
    return (fade(at) if start else np.ones(length)) * (fade(length - 1 - at) if end else 1.0)


class _Axis:
    """The weights of all tiles along one axis of a picture, and their totals per pixel."""

    def __init__(self, size: int, tile: int, ramp: int, faded: bool, feather_edges: bool, inclusive: bool):
        step = tile - 2 * ramp
        starts = np.arange(max(1, -(-(size - ramp) // step))) * step
        self.tiles, self.total = {}, np.zeros(size)
        for a in starts.tolist():
            n = min(tile, size - a)
            start, end = faded and (feather_edges or a > 0), faded and (feather_edges or a + n < size)
            self.tiles[a] = _ramp(n, ramp, start, end, inclusive)
            self.total[a : a + n] += self.tiles[a]


def _weighted(tile_w: int, tile_h: int, ramp: int, feather_edges: bool, inclusive: bool) -> Callable:
    """Tile rows times their share of the total weight, which follows from a pixel's place alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[tuple[int, int, bool], _Axis] = {}

        def axis(size: int, tile: int, faded: bool) -> _Axis:
            if (size, tile, faded) not in axes:
                if len(axes) >= CACHED_AXES:
                    axes.clear()
                axes[size, tile, faded] = _Axis(size, tile, ramp, faded, feather_edges, inclusive)
            return axes[size, tile, faded]

        for batch in batches:
            place = np.stack([batch.column(k).to_numpy() for k in ("w", "h", "x0", "tw", "y0", "th")], 1)
            ty, starts = batch.column("ty").to_numpy(), batch.column("v").offsets.to_numpy()
            flat = batch.column("v").values.to_numpy(zero_copy_only=False)
            for w, h, x0, tw, y0, th in np.unique(place, axis=0).tolist():
                rows = np.flatnonzero((place == (w, h, x0, tw, y0, th)).all(1))
                faded = tw < w or th < h
                across, down = axis(w, tile_w, faded), axis(h, tile_h, faded)
                y = y0 + ty[rows]
                weight = down.tiles[y0][ty[rows], None] * across.tiles[x0]
                total = down.total[y, None] * across.total[x0 : x0 + tw]
                share = np.divide(weight, total, out=weight.copy(), where=total > TINY_WEIGHT)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(take) for k in ("image_id", "c")), pa.array(y.astype(np.int32)), *(batch.column(k).take(take) for k in ("h", "w", "x0")),
                     lists(flat[starts[rows][:, None] + np.arange(tw)] * share)],
                    ["image_id", "c", "y", "h", "w", "x0", "v"],
                )

    return run


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Picture rows from their pieces, which are added where they overlap."""
    for batch, first in whole_groups(batches, ["image_id", "c", "y"]):
        width = batch.column("w").to_numpy()[first].astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(width)])
        size = np.diff(batch.column("v").offsets.to_numpy()).astype(np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
        start = edges[group] + batch.column("x0").to_numpy()
        where = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        made = np.bincount(where, batch.column("v").flatten().to_numpy(), minlength=edges[-1])
        take = pa.array(first)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(take) for k in ("image_id", "c", "y", "h")), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(made))],
            ["image_id", "c", "y", "h", "v"],
        )


def blend_tiles(
    tiles: DataFrame, tile_w: int, tile_h: int, ramp: int, feather_edges: bool = False, inclusive: bool = False
) -> DataFrame:
    """Weighted mean of overlapping tile rows, back to raster rows.

    Sides of a whole tile and `ramp`, the overlap, in output pixels. With `feather_edges` the
    picture's own border fades as well, so its outermost pixels have weight 0 and stay 0; without
    it only inner sides fade. A picture that is one tile is never faded. `inclusive` lets a ramp
    reach its full weight on its last pixel.

    A pixel's total weight is a product of one number per axis, known from its place, so pieces are
    divided before they meet, and no weight is shuffled. They meet by picture row, once.
    """
    _check(tile_w, tile_h, ramp)
    key = f"image_id {dict(tiles.dtypes)['image_id']}, c int, y int, h int"
    numbers = [F.col(k).cast("int") for k in ("c", "w", "h", "x0", "y0", "tw", "th", "ty")]
    shares = tiles.select("image_id", *numbers, F.col("v").cast("array<double>")).mapInArrow(
        _weighted(tile_w, tile_h, ramp, feather_edges, inclusive), f"{key}, w int, x0 int, v array<double>"
    )
    return met(shares, ["image_id", "c", "y"], ["x0"]).mapInArrow(_row_sums, f"{key}, v array<double>")


def upscale(
    rasters: DataFrame,
    scale: int,
    model: Callable | None = None,
    tile_w: int = 512,
    tile_h: int = 512,
    overlap: int = 16,
    align: bool = True,
    feather_edges: bool = False,
    inclusive: bool = False,
) -> DataFrame:
    """Tile, run the model on each tile, blend. Alpha is one more channel.

    `model` is a loader as `infer_tiles` takes it; None uses nearest neighbour.
    """
    from .inference import infer_tiles

    tile_w, tile_h = aligned_tile(tile_w, align), aligned_tile(tile_h, align)
    tiles = tile_rows(rasters, tile_w, tile_h, overlap)
    if model is None:
        enlarged = nearest_rows(tiles, scale)
    else:
        enlarged = infer_tiles(tiles, model, scale, pad_to=ALIGNMENT if align else 1)
    return blend_tiles(enlarged, tile_w * scale, tile_h * scale, overlap * scale, feather_edges, inclusive)


def pad_to_multiple(rasters: DataFrame, multiple: int = ALIGNMENT) -> DataFrame:
    """Mirrors rows and columns at the right and bottom up to a multiple; narrow.

    A picture row is copied to each padded row that mirrors it.
    """
    up = lambda n: (F.ceil(n / multiple) * multiple).cast("int")
    w, h = F.size("v"), F.col("h")
    new_h = up(h)
    wide = F.transform(F.sequence(F.lit(0), up(w) - 1), lambda x: F.get("v", mirror(x, w).cast("int")))
    # Rows y' >= h with mirror(y') = y, found from the row's side so nothing is joined.
    period = F.greatest((h - 1) * 2, F.lit(1))
    turns = F.sequence(F.lit(0), F.ceil(new_h / period).cast("int"))
    ups = F.transform(turns, lambda k: k * period + F.col("y"))
    downs = F.transform(turns, lambda k: (k + 1) * period - F.col("y"))
    places = F.when(h == 1, F.sequence(F.lit(0), new_h - 1)).otherwise(
        F.array_distinct(F.filter(F.concat(ups, downs), lambda t: t < new_h))
    )
    return rasters.select(
        "image_id", "c", F.explode(places).alias("y"), new_h.alias("h"), wide.alias("v")
    )


def crop_back(rasters: DataFrame, width: Column, height: Column) -> DataFrame:
    """Keeps the top-left width x height corner (undoes padding); narrow."""
    return (
        rasters.where(F.col("y") < height)
        .withColumn("v", F.slice("v", F.lit(1), width))
        .withColumn("h", F.least(F.col("h"), height))
    )


def clamp_rois(rois: DataFrame, images: DataFrame) -> DataFrame:
    """Rectangles (image_id, x, y, w, h) fitted into their pictures (image_id, img_w, img_h).

    The size is cut to the picture, the old centre is kept, then the place is cut.
    """
    half = lambda n: F.floor(n / 2).cast("int")
    fitted = (
        rois.join(images, "image_id")
        .withColumn("cx", F.col("x") + half(F.col("w")))
        .withColumn("cy", F.col("y") + half(F.col("h")))
        .withColumn("w", F.least("w", "img_w"))
        .withColumn("h", F.least("h", "img_h"))
    )
    place = lambda centre, size, limit: F.greatest(
        F.lit(0), F.least(F.col(centre) - half(F.col(size)), F.col(limit) - F.col(size))
    )
    return fitted.select(
        "image_id", place("cx", "w", "img_w").alias("x"), place("cy", "h", "img_h").alias("y"), "w", "h"
    )


def crop(rasters: DataFrame, rois: DataFrame) -> DataFrame:
    """Cuts one clamped rectangle out of each picture.

    The engine splits a picture that holds a large share of the rows (skewed join).
    """
    box = rois.select(
        "image_id", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh")
    )
    return (
        rasters.join(box, "image_id")
        .where((F.col("y") >= F.col("ry")) & (F.col("y") < F.col("ry") + F.col("rh")))
        .select(
            "image_id", "c", (F.col("y") - F.col("ry")).alias("y"), F.col("rh").alias("h"),
            F.slice("v", F.col("rx") + 1, F.col("rw")).alias("v"),
        )
    )


def split_alpha(rasters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Colour channels (c < 3) and alpha (c = 3)."""
    return rasters.where(F.col("c") < 3), rasters.where(F.col("c") == 3)


def merge_alpha(colour: DataFrame, alpha: DataFrame) -> DataFrame:
    return colour.unionByName(alpha)


def pixels_of(rasters: DataFrame) -> DataFrame:
    """Long form: one record per pixel and channel, with picture size."""
    return rasters.select(
        "image_id", F.size("v").alias("w"), "h", "c", "y", F.posexplode("v").alias("x", "v")
    )


def has_transparency(rasters: DataFrame) -> DataFrame:
    """Per picture: whether any alpha is below 1; false without an alpha channel."""
    alpha = F.when(F.col("c") == 3, F.array_min("v"))
    return rasters.groupBy("image_id").agg(
        F.coalesce(F.min(alpha) < 1.0, F.lit(False)).alias("transparent")
    )


def normalize_range(rasters: DataFrame) -> DataFrame:
    """Divides pictures whose largest colour value is above 1 by 255."""
    peak = rasters.groupBy("image_id").agg(
        F.max(F.when(F.col("c") < 3, F.array_max("v"))).alias("peak")
    )
    scaled = F.when(F.col("peak") > 1.0, F.transform("v", lambda a: a / 255.0)).otherwise(F.col("v"))
    colour = F.when(F.col("c") < 3, scaled).otherwise(F.col("v"))
    return rasters.join(peak, "image_id").withColumn("v", colour).drop("peak")


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean absolute difference per picture of two results of the same input.

    Rows are matched on (image_id, c, y), so a large picture spreads over tasks.
    """
    other = b.select("image_id", "c", "y", F.col("v").alias("vb"))
    diff = F.aggregate(
        F.zip_with("v", "vb", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d
    )
    return (
        a.join(other, ["image_id", "c", "y"])
        .groupBy("image_id")
        .agg(F.sum(diff).alias("total"), F.sum(F.size("v").cast("bigint")).alias("n_values"))
        .select("image_id", "n_values", (F.col("total") / F.col("n_values")).alias("mean_abs_diff"))
    )
