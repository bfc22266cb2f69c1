"""Pixel arithmetic, target sizes and blend ramps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# BT.601 luma weights, and the full-range U and V rows.
LUMA = (0.299, 0.587, 0.114)
YUV_U = (-0.169, -0.331, 0.500)
YUV_V = (0.500, -0.419, -0.081)

# Device memory in GB from which a tile size (width, height) is used.
TILE_BANDS = (
    (16, 1088, 1920),
    (12, 1024, 1024),
    (10, 768, 1024),
    (8, 768, 768),
    (6, 512, 768),
)
SMALLEST_TILE = (512, 512)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def _truncated(value: Column) -> Column:
    return F.floor(clamp(value, 0.0, 255.0)).cast("int")


def rgb_to_yuv444(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit Y, U and V planes of 8-bit RGB, clipped and truncated."""
    mix = lambda k: r * k[0] + g * k[1] + b * k[2]
    return _truncated(mix(LUMA)), _truncated(mix(YUV_U) + 128.0), _truncated(mix(YUV_V) + 128.0)


def to_uint8(value: Column) -> Column:
    """[0,1] float to 8 bits: NaN is 0, infinities are the ends, then truncation."""
    finite = F.when(F.isnan(value), F.lit(0.0)).otherwise(clamp(value, 0.0, 1.0))
    return F.floor(finite * 255.0).cast("smallint")


def to_unit(value: Column) -> Column:
    return value.cast("double") / 255.0


def flatten_on_white(channel: Column, alpha: Column) -> Column:
    """One 8-bit channel over white; `alpha` in [0,1]."""
    return channel * alpha + (F.lit(1.0) - alpha) * 255.0


def target_size(
    width: Column, height: Column, mode: str, target_w: int = 1920, target_h: int = 1080,
    keep_aspect: bool = True,
) -> tuple[Column, Column]:
    """Size after scaling by mode `2x` (halves), `width` or `height`."""
    if mode == "2x":
        return F.floor(width / 2).cast("int"), F.floor(height / 2).cast("int")
    if mode == "width":
        scaled = F.floor(height * (F.lit(float(target_w)) / width)).cast("int")
        return F.lit(target_w), scaled if keep_aspect else F.lit(target_h)
    if mode == "height":
        scaled = F.floor(width * (F.lit(float(target_h)) / height)).cast("int")
        return scaled if keep_aspect else F.lit(target_w), F.lit(target_h)
    raise ValueError(f"unknown size mode: {mode}")


def tile_band(memory_gb: Column) -> tuple[Column, Column]:
    """Tile width and height for a device with that much memory."""
    width, height = F.lit(SMALLEST_TILE[0]), F.lit(SMALLEST_TILE[1])
    for least, w, h in reversed(TILE_BANDS):
        width = F.when(memory_gb >= least, F.lit(w)).otherwise(width)
        height = F.when(memory_gb >= least, F.lit(h)).otherwise(height)
    return width, height


def mirror(index: Column, size: Column) -> Column:
    """Index reflected into 0..size-1 without repeating the edge (period 2(size-1))."""
    period = F.greatest((size - 1) * 2, F.lit(1))
    folded = F.pmod(index, period)
    return F.when(size <= 1, F.lit(0)).when(folded < size, folded).otherwise(period - folded)
