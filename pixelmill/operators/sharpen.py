"""Contrast-adaptive and edge-adaptive sharpening of raster rows.

A stencil needs neighbouring rows, so pictures are cut into bands of rows; a band also
receives the few rows above and below it. One band is one group of bounded size: the wider
a picture, the lower its bands. NumPy works on the whole band at once. Alpha is in its band's
group and passes unchanged, so the input is read once.

Pictures may lack rows or channels; a row without values (null) is one that lacks. What lacks gets no
output and adds nothing to its neighbours; a lone channel is a grey picture. A row that comes twice
moves the rows below it down.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import groups, joined, lists, matrix, met

BAND, BAND_LEAST, BAND_CELLS = 64, 8, 1 << 20  # picture rows per group at most and at least, pixels per group
EPSILON = 1e-6  # fixed value

# Fixed values of the edge-adaptive method.
CURVE_HEIGHT = 1.0
CURVE_SLOPE = 0.5
OVERSHOOT = 0.003
COMPRESSION = {False: (0.167, 0.250), True: (0.334, 0.500)}  # overshoot control -> (light, dark)
SCALE_LIMIT = 0.1
SCALE_STEEPNESS = 0.056
LUMA = (0.299, 0.587, 0.114)
EDGE_CENTRE, EDGE_SIDE, EDGE_CORNER, EDGE_FAR = 1.38, 1.15, 0.92, 0.23

# Fixed sets of (dy, dx) neighbours.
SIDES = ((-1, 0), (0, -1), (0, 1), (1, 0))
CORNERS = ((-1, -1), (-1, 1), (1, -1), (1, 1))
FAR = ((-2, 0), (0, -2), (0, 2), (2, 0))
OUTER = (
    (3, 0), (2, 1), (2, -1), (0, 3), (1, 2), (-1, 2),
    (0, -3), (1, -2), (-1, -2), (-3, 0), (-2, 1), (-2, -1),
)

# band: array [channels, rows, width], `at(dy, dx, missing)` gives a shifted view of the core rows,
# with `missing` (a number or an array like the core) where the picture lacks a row.
At = Callable[..., np.ndarray]


def _cas(at: At, amount: float, diagonals: bool) -> np.ndarray:
    centre, cross = at(0, 0, 0.0), [at(*o, 0.0) for o in SIDES]
    around = [at(*o, centre) for o in ((0, 0), *SIDES, *(CORNERS if diagonals else ()))]
    low, high = np.fmin.reduce(around), np.fmax.reduce(around)
    room = np.minimum(low, (2.0 if diagonals else 1.0) - high) / (high + EPSILON)
    weight = -np.sqrt(np.maximum(room, 0.0)) * (amount * (1 / 5 - 1 / 8) + 1 / 8)
    return np.clip((sum(cross) * weight + centre) / (1.0 + 4.0 * weight), 0.0, 1.0)


def _soft_limit(value: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """|value| bent smoothly towards `limit` (rational form of tanh)."""
    t = np.abs(value) / (limit + EPSILON)
    return np.clip(t * (27.0 + t * t) / (27.0 + 9.0 * t * t), 0.0, 1.0) * limit


def _adaptive(at: At, strength: float, overshoot: bool, anime: bool) -> np.ndarray:
    light, dark = COMPRESSION[overshoot]
    centre = at(0, 0, 0.0)
    sides, corners, far = ([at(*o, centre) for o in group] for group in (SIDES, CORNERS, FAR))

    blur = (4.0 * centre + 2.0 * sum(sides) + sum(corners)) / 16.0
    contrast = np.clip(0.266666681 + 0.9 * np.exp2(blur.sum(axis=0) * (-7.4 / 3.0)), 0.0, 1.0)
    spread = lambda group: sum(np.abs(blur - p) for p in group)
    detail = (
        EDGE_CENTRE * np.abs(blur - centre) + EDGE_SIDE * spread(sides)
        + EDGE_CORNER * spread(corners) + EDGE_FAR * spread(far)
    )
    edge = np.sqrt((detail * detail).sum(axis=0)) * contrast

    grey = lambda p: LUMA[0] * p[0] + LUMA[1] * p[1] + LUMA[2] * p[2]
    y = grey(centre)
    ring = [grey(p) for p in sides + corners]
    others = ring + [grey(p) for p in far] + [grey(at(*o, centre)) for o in OUTER]
    ranked = np.partition(np.stack([y, *others]), (0, 1, -2, -1), axis=0)
    top = (3.0 * np.maximum(ranked[-2], y) + ranked[-1]) / 4.0
    bottom = (3.0 * np.minimum(ranked[1], y) + ranked[0]) / 4.0

    height = CURVE_HEIGHT * strength
    change = (y - sum(ring) / 8.0) * height / (height * CURVE_SLOPE * edge ** 3.5 + 0.625)
    reach = np.minimum(np.abs(top - y), np.abs(y - bottom)) + OVERSHOOT
    limit = np.minimum(reach, SCALE_LIMIT * (1.0 - SCALE_STEEPNESS) + reach * SCALE_STEEPNESS)
    soft = _soft_limit(change, limit)
    brighter = 0.0 if anime else light * np.abs(change) + (1.0 - light) * soft
    darker = -(dark * np.abs(change) + (1.0 - dark) * soft)
    change = np.where(change > 0.0, brighter, darker)

    bounded = np.clip(y + change, 0.0, 1.0) - y
    saturation = (y + np.maximum(0.9 * bounded, bounded) * 1.03 + 0.03) / (y + 0.03)
    return np.clip(y + (3.0 * bounded + change) / 4.0 + (centre - y) * saturation, 0.0, 1.0)


def _mirror(index: np.ndarray, size: int) -> np.ndarray:
    if size == 1:
        return np.zeros_like(index)
    folded = index % (2 * (size - 1))
    return np.where(folded < size, folded, 2 * (size - 1) - folded)


def _placed(group: pa.RecordBatch, top: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group's channels, their rows from picture row `top` on as [channels, size, width], and which of them are there."""
    channels, ys, rows = group.column("c").to_numpy(), group.column("y").to_numpy(), matrix(group.column("v"))
    names, first = np.unique(channels, return_index=True)
    if len(ys) == len(names) * size and (ys.reshape(len(names), size) == np.arange(top, top + size)).all():
        return names, rows.reshape(len(names), size, -1), np.ones((len(names), size), bool)
    values, there = np.zeros((len(names), size, rows.shape[1])), np.zeros((len(names), size), bool)
    for k, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(ys)])):
        step = np.arange(b - a)
        at = np.maximum.accumulate(ys[a:b] - top - step) + step
        fits = at < size
        values[k, at[fits]], there[k, at[fits]] = rows[a:b][fits], True
    return names, values, there


def _band_function(kernel: Callable[[At], np.ndarray], radius: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Applies `kernel` to one band; rows beyond the picture are mirrored."""

    def run(group: pa.RecordBatch) -> pa.RecordBatch:
        height, band, rows = (int(group.column(k)[0].as_py()) for k in ("h", "band", "rows"))
        core = np.arange(band * rows, min((band + 1) * rows, height))
        top, end = max(0, band * rows - radius), min(height, (band + 1) * rows + radius)
        if group.column("v").null_count:
            group = group.filter(group.column("v").is_valid())
        colour = group.column("c").to_numpy() < 3
        alpha = group if not colour.any() else group.filter(pa.array(~colour))  # only the band's own rows of alpha are sent
        out = [(alpha.column("c").to_numpy(), alpha.column("y").to_numpy(), matrix(alpha.column("v")))] if alpha.num_rows else []
        if colour.any():
            names, values, there = _placed(group if colour.all() else group.filter(pa.array(colour)), top, end - top)
            width = values.shape[2]
            own = there[:, core - top]
            if len(names) == 2:  # the third counts as one without rows
                values, there = (np.insert(a, 3 - names.sum(), 0, axis=0) for a in (values, there))
            whole = there.all()

            def at(dy: int, dx: int, missing: float | np.ndarray) -> np.ndarray:
                here = _mirror(core + dy, height) - top
                seen = values[:, here][:, :, _mirror(np.arange(width) + dx, width)]
                return seen if whole else np.where(there[:, here][:, :, None], seen, missing)

            # A grey picture counts as three equal channels.
            if len(names) == 1:
                sharp = kernel(lambda dy, dx, missing: np.repeat(at(dy, dx, missing[:1] if np.ndim(missing) else missing), 3, axis=0))[:1]
            else:
                sharp = kernel(at)[names]
            which, row = np.nonzero(own)
            out.insert(0, (names[which], core[row], sharp[own]))
        if not out:
            out = [(np.zeros(0), np.zeros(0), np.zeros((0, 0)))]
        channels, ys, cells = zip(*out)
        one = pa.array(np.zeros(sum(map(len, ys)), np.int32))
        return pa.RecordBatch.from_arrays(
            [group.column("image_id").take(one), pa.array(np.concatenate(channels).astype(np.int32)), pa.array(np.concatenate(ys).astype(np.int32)), group.column("h").take(one), lists(np.concatenate(cells))],
            ["image_id", "c", "y", "h", "v"],
        )

    return run


def _by_band(
    rasters: DataFrame, radius: int, kernel: Callable[[At], np.ndarray], split_channels: bool
) -> DataFrame:
    width = F.greatest(F.size("v"), F.lit(1))
    rows = F.greatest(F.lit(BAND_LEAST), F.least(F.lit(BAND), F.floor(F.lit(BAND_CELLS) / width))).cast("int")
    cut = rasters.select(
        "image_id", F.col("c").cast("int"), F.col("y").cast("int"), F.col("h").cast("int"), F.col("v").cast("array<double>"), rows.alias("rows"),
        F.when(F.col("c") < 3, radius).otherwise(0).alias("reach"),
    )
    # A row near a picture edge is also its own mirror image, which is in the same band.
    bands = F.sequence(
        F.greatest(F.lit(0), F.floor((F.col("y") - F.col("reach")) / F.col("rows"))).cast("int"),
        F.least(F.floor((F.col("h") - 1) / F.col("rows")), F.floor((F.col("y") + F.col("reach")) / F.col("rows"))).cast("int"),
    )
    keys = ["image_id", "band"] + (["c"] if split_channels else [])
    spread = met(cut.withColumn("band", F.explode(bands)).drop("reach"), keys, ["y"] if split_channels else ["c", "y"])
    apply = _band_function(kernel, radius)
    return spread.mapInArrow(
        lambda batches: joined(map(apply, groups(batches, keys))),
        f"image_id {dict(rasters.dtypes)['image_id']}, c int, y int, h int, v array<double>",
    )


def cas_sharpen(rasters: DataFrame, amount: float = 0.5, diagonals: bool = True) -> DataFrame:
    """Contrast-adaptive sharpening (3x3). An amount of 0 or less changes nothing."""
    if amount <= 0:
        return rasters
    return _by_band(rasters, 1, lambda at: _cas(at, amount, diagonals), split_channels=True)


def adaptive_sharpen(
    rasters: DataFrame, strength: float = 1.0, overshoot: bool = False, anime: bool = False
) -> DataFrame:
    """Edge-adaptive sharpening (25 neighbours, 7x7 reach) of RGB pictures.

    `anime` only darkens. A strength of 0 or less changes nothing.
    """
    if strength <= 0:
        return rasters
    return _by_band(rasters, 3, lambda at: _adaptive(at, strength, overshoot, anime), split_channels=False)
