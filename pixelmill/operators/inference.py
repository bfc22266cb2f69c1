"""Runs a user's model over tiles as a batch function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# A model maps float32 [N, 3, H, W] in [0, 1] to [N, 3, H * scale, W * scale].
Model = Callable[[np.ndarray], np.ndarray]

_OUT = "c int, w int, h int, tile_no int, x0 int, y0 int, tw int, th int, ty int, v array<double>"
_SMALL = ("tile_no", "grp", "w", "h", "x0", "y0", "tw", "th", "planes")


def _whole_tiles(tiles: DataFrame) -> DataFrame:
    """One record per (picture, tile, plane group); a tile's size bounds the record.

    Group 0 holds the three colour channels, group 1 the alpha channel.
    """
    return (
        tiles.withColumn("grp", F.when(F.col("c") < 3, 0).otherwise(1))
        # What a model takes; half the bytes for the shuffle.
        .withColumn("v", F.col("v").cast("array<float>"))
        .groupBy("image_id", "tile_no", "grp", "w", "h", "x0", "y0", "tw", "th")
        .agg(F.array_sort(F.collect_list(F.struct("c", "ty", "v"))).alias("rows"))
        .withColumn("planes", (F.size("rows") / F.col("th")).cast("int"))
        .withColumn("data", F.flatten(F.transform("rows", lambda r: r["v"])))
        .drop("rows")
    )


def infer_tiles(
    tiles: DataFrame, load_model: Callable[[], Model], scale: int, pad_to: int = 64, batch: int = 8
) -> DataFrame:
    """Tile rows in, enlarged tile rows out.

    `load_model` runs once per Python task and returns the model. Tiles of equal
    size go to it together, at most `batch` at a time. Sides are mirrored up to a
    multiple of `pad_to` before the call and cut back after it. A single plane (grey
    or alpha) is given as three equal channels and the first of the result is kept.
    Results are clipped to [0, 1].
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for record in batches:
            # Only the few numbers of a tile become Python objects; its pixels stay in their buffer.
            table = {name: record.column(name).to_pylist() for name in _SMALL}
            shapes: dict[tuple[int, int, int], list[int]] = {}
            for i, shape in enumerate(zip(table["planes"], table["th"], table["tw"])):
                shapes.setdefault(shape, []).append(i)
            data = record.column("data")
            for (planes, th, tw), members in shapes.items():
                for start in range(0, len(members), batch):
                    part = members[start:start + batch]
                    stack = np.stack([
                        data[i].values.to_numpy(zero_copy_only=False).reshape(planes, th, tw) for i in part
                    ])
                    if planes == 1:
                        stack = np.repeat(stack, 3, axis=1)
                    pad_h, pad_w = -th % pad_to, -tw % pad_to
                    stack = np.pad(stack, ((0, 0), (0, 0), (0, pad_h), (0, pad_w)), mode="reflect")
                    result = np.asarray(model(stack), dtype=np.float64)
                    result = np.clip(result[:, :planes, :th * scale, :tw * scale], 0.0, 1.0)
                    yield _as_rows(table, record.column("image_id"), part, result, scale)

    return _whole_tiles(tiles).mapInArrow(run, f"image_id {dict(tiles.dtypes)['image_id']}, {_OUT}")


def _as_rows(table: dict, ids: pa.Array, part: list[int], result: np.ndarray, scale: int) -> pa.RecordBatch:
    n, planes, height, width = result.shape
    per_tile = planes * height
    repeat = lambda name, k: np.repeat(np.array([table[name][i] for i in part]) * k, per_tile)
    first = np.repeat(np.array([3 * table["grp"][i] for i in part]), per_tile)
    columns = {
        "image_id": ids.take(pa.array(np.repeat(part, per_tile))),
        "c": pa.array(first + np.tile(np.repeat(np.arange(planes), height), n), pa.int32()),
    }
    for name in ("w", "h"):
        columns[name] = pa.array(repeat(name, scale), pa.int32())
    columns["tile_no"] = pa.array(repeat("tile_no", 1), pa.int32())
    for name in ("x0", "y0", "tw", "th"):
        columns[name] = pa.array(repeat(name, scale), pa.int32())
    columns["ty"] = pa.array(np.tile(np.arange(height), n * planes), pa.int32())
    offsets = pa.array(np.arange(n * per_tile + 1) * width, pa.int32())
    columns["v"] = pa.ListArray.from_arrays(offsets, pa.array(result.reshape(-1)))
    return pa.RecordBatch.from_pydict(columns)


def map_rasters(rasters: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's own step in a chain, as a DataFrame function."""
    return rasters.transform(process)
