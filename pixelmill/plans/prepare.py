"""The chain an image goes through, and the same chain for animations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from pixelmill.functions.pixels import target_size, to_uint8
from pixelmill.operators import frames as FR
from pixelmill.operators.resize import resize
from pixelmill.operators.sharpen import adaptive_sharpen, cas_sharpen
from pixelmill.operators.tiling import upscale


@dataclass(frozen=True)
class Scaling:
    """One resize step; `mode` is 2x, width or height."""

    mode: str
    width: int = 1920
    height: int = 1080
    keep_aspect: bool = True
    kernel: str = "lanczos"


@dataclass(frozen=True)
class Recipe:
    """What is done to each picture. Steps left at None or 0 are skipped."""

    prescale: Scaling | None = None
    scale: int = 1
    model: Callable | None = None
    tile: tuple[int, int] = (512, 512)
    overlap: int = 16
    align: bool = True
    feather_edges: bool = False
    custom: Scaling | None = None
    sharpen: float = 0.0
    sharpen_method: str = "cas"
    anime: bool = False
    secondary: Scaling | None = None
    user_step: Callable[[DataFrame], DataFrame] | None = field(default=None)


def scaled(rasters: DataFrame, step: Scaling, keep_aspect: bool | None = None) -> DataFrame:
    keep = step.keep_aspect if keep_aspect is None else keep_aspect
    w, h = target_size(F.size("v"), F.col("h"), step.mode, step.width, step.height, keep)
    return resize(rasters, w, h, step.kernel)


def prepare(rasters: DataFrame, recipe: Recipe) -> DataFrame:
    """Pre-scale, upscale, custom size, sharpen, user step; raster rows in and out.

    Pre-scaling and secondary copies always keep the aspect ratio.
    """
    out = rasters
    if recipe.prescale:
        out = scaled(out, recipe.prescale, keep_aspect=True)
    if recipe.scale > 1 or recipe.model:
        out = upscale(
            out, recipe.scale, recipe.model, *recipe.tile, recipe.overlap, recipe.align, recipe.feather_edges
        )
    if recipe.custom:
        out = scaled(out, recipe.custom)
    if recipe.sharpen > 0:
        if recipe.sharpen_method == "adaptive":
            out = adaptive_sharpen(out, recipe.sharpen, anime=recipe.anime)
        else:
            out = cas_sharpen(out, recipe.sharpen)
    if recipe.user_step:
        out = out.transform(recipe.user_step)
    return out


def with_secondary_output(results: DataFrame, spec: Scaling) -> DataFrame:
    """Primary rows and a smaller copy of every picture, told apart by `variant`."""
    # Both variants come from one reading of the results; a primary row keeps its size.
    both = results.withColumn("variant", F.explode(F.array(F.lit("primary"), F.lit("secondary"))))
    w, h = target_size(F.size("v"), F.col("h"), spec.mode, spec.width, spec.height, True)
    small = F.col("variant") == "secondary"
    return resize(both, F.when(small, w).otherwise(F.size("v")), F.when(small, h).otherwise(F.col("h")), spec.kernel, also=["variant"])


def eight_bit(rasters: DataFrame) -> DataFrame:
    """Raster rows as they are saved: 8-bit values."""
    return rasters.withColumn("v", F.transform("v", lambda a: to_uint8(a)))


def upscale_animation(frames: DataFrame, rasters: DataFrame, recipe: Recipe) -> tuple[DataFrame, DataFrame]:
    """Merged frame list and processed rows of the kept frames only.

    `frames`: anim_id, frame_no, duration_ms, image_id and perhaps sig; without it the
    signature of each picture, as 8-bit values, is computed. Runs of equal input
    frames are merged first, so the costly steps never see a repeated frame.
    """
    if "sig" not in frames.columns:
        seen = eight_bit(rasters).withColumn("v", F.transform("v", lambda a: a / 255.0))
        frames = frames.join(FR.frame_signature(seen), "image_id", "left")
    kept = FR.merge_islands(frames)
    ids = frames.select("anim_id", "frame_no", "image_id").join(
        kept.select("anim_id", "frame_no"), ["anim_id", "frame_no"], "left_semi"
    )
    wanted = ids.select("image_id").distinct()
    used = rasters.join(wanted, "image_id", "left_semi")
    merged = kept.join(ids, ["anim_id", "frame_no"])
    return merged, prepare(used, recipe)
