"""Animation frames: runs of equal frames, merging, statistics, raw video parts.

`frames`: anim_id LONG, frame_no LONG (0-based, dense per animation), duration_ms,
sig (equal for equal pictures), and any other columns. A frame is compared with the
one before it only, so A-B-A keeps all three.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pixelmill.functions.pixels import LUMA, YUV_U, YUV_V, luma, to_uint8
from .resize import resize
from .skew import ordered, rank_within

DEFAULT_DURATION_MS = 100  # fixed value
MARKER = "FRAME\n"  # fixed value
THUMBNAIL = 16  # fixed value: side of the signature picture


def frame_islands(frames: DataFrame) -> DataFrame:
    """Adds `island`, the 1-based number of the run of equal frames."""
    return ordered(frames, ["anim_id"], ["frame_no"], runs={"island": "sig"})


def merge_islands(frames: DataFrame) -> DataFrame:
    """First frame of every run, with the run's total duration and length, and `alpha`, where frames have that flag: whether any has it set."""
    alpha = [F.coalesce(F.bool_or("alpha"), F.lit(False)).alias("alpha")] if "alpha" in frames.columns else []
    return (
        frame_islands(frames)
        .groupBy("anim_id", "island")
        .agg(
            F.min("frame_no").alias("frame_no"),
            F.min_by("sig", "frame_no").alias("sig"),
            F.sum(F.coalesce(F.col("duration_ms"), F.lit(DEFAULT_DURATION_MS)).cast("bigint")).alias("duration_ms"),
            F.count(F.lit(1)).alias("n_frames"),
            *alpha,
        )
    )


def animation_stats(merged: DataFrame) -> DataFrame:
    """Per animation, from merged frames: kept frames, mean duration, rate, dropped frames, frames before merging, and any alpha where it is known."""
    mean = F.avg("duration_ms")
    alpha = [F.bool_or("alpha").alias("any_alpha")] if "alpha" in merged.columns else []
    return merged.groupBy("anim_id").agg(
        F.count(F.lit(1)).alias("n_kept"),
        mean.alias("avg_duration_ms"),
        F.when(mean > 0, 1000.0 / mean).otherwise(F.lit(10.0)).alias("fps"),
        F.sum(F.col("n_frames") - 1).alias("n_dropped"),
        F.sum("n_frames").alias("n_frames"),
        *alpha,
    )


def frame_count(frames: DataFrame) -> DataFrame:
    """Frames per animation and whether it is animated at all."""
    n = F.count(F.lit(1))
    return frames.groupBy("anim_id").agg(n.alias("n_frames"), (n > 1).alias("animated"))


def frame_signature(rasters: DataFrame, kernel: str = "lanczos_full") -> DataFrame:
    """Per picture: its 16x16 grey thumbnail as hexadecimal text (512 characters).

    The full bytes are kept: equal text means equal thumbnails, not just equal hashes.
    """
    colour = rasters.where(F.col("c") < 3)
    small = resize(colour, F.lit(THUMBNAIL), F.lit(THUMBNAIL), kernel)
    channel = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    rows = small.groupBy("image_id", "y").agg(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))
    grey = F.when(F.col("g").isNull() | F.col("b").isNull(), F.col("r")).otherwise(
        F.transform(F.arrays_zip("r", "g", "b"), lambda p: luma(p["r"], p["g"], p["b"]))
    )
    text = F.array_join(F.transform(grey, lambda a: F.lpad(F.hex(to_uint8(a).cast("bigint")), 2, "0")), "")
    line = rows.select("image_id", "y", text.alias("t"))
    lines = F.array_sort(F.collect_list(F.struct("y", "t")))
    return line.groupBy("image_id").agg(F.array_join(F.transform(lines, lambda s: s["t"]), "").alias("sig"))


_PLANE_ROWS = "frame_no long, plane long, y long, bytes binary"


def _planes(alpha: bool):
    """Rows of pixels as rows of bytes, one per plane; no bytes where a row has no colour or no alpha."""
    mixes = [(LUMA, 0.0), (YUV_U, 128.0), (YUV_V, 128.0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch, plane: int, data: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [batch.column("anim_id"), batch.column("frame_no"), pa.array(np.full(batch.num_rows, plane, np.int64)), batch.column("y"), data],
                ["anim_id", "frame_no", "plane", "y", "bytes"],
            )

        for batch in batches:
            for name, planes in (("r", range(len(mixes))), ("a", range(len(mixes), len(mixes) + alpha))):
                if not planes:
                    continue
                there, gone = batch, None
                if batch.column(name).null_count:
                    there, gone = batch.filter(batch.column(name).is_valid()), batch.filter(batch.column(name).is_null())
                if name == "r":
                    flat = [there.column(k).flatten().to_numpy().astype(float) for k in "rgb"]
                    made = [np.floor(np.clip(flat[0] * k[0] + flat[1] * k[1] + flat[2] * k[2] + shift, 0, 255)) for k, shift in mixes]
                else:
                    made = [there.column(name).flatten().to_numpy()]
                edges = there.column(name).offsets.to_numpy()
                edges = pa.py_buffer((edges - edges[0]).astype(np.int32))
                for plane, values in zip(planes, made):
                    data = pa.py_buffer(np.ascontiguousarray(values.astype(np.uint8)))
                    yield rows(there, plane, pa.Array.from_buffers(pa.binary(), there.num_rows, [None, edges, data]))
                    if gone is not None:
                        yield rows(gone, plane, pa.nulls(gone.num_rows, pa.binary()))

    return run


def y4m_parts(frames: DataFrame, rows: DataFrame, alpha: bool = False) -> DataFrame:
    """Uncompressed video as byte parts: anim_id, part, offset, bytes.

    `frames`: anim_id, frame_no, duration_ms. `rows`: anim_id, frame_no, y, r, g, b[, a]
    as 8-bit integer arrays. The parts are one header per animation, one marker per
    frame and one part per plane row; `offset` is where a part stands in its animation's file, from
    the number of frames before it and the sizes of what is in a frame. A channel that a row lacks
    (null) is 0, alpha is opaque, and a row without any colour is black, so each part fills its place. Nothing
    gathers an animation or a frame; `sinks.write_y4m` writes the parts in order.
    """
    channels = ["r", "g", "b", "a"] if alpha else ["r", "g", "b"]
    width = F.greatest(*[F.array_size(c) for c in channels])
    size = rows.groupBy("anim_id").agg(
        F.max(width).alias("w"), (F.max("y") + 1).alias("h")
    )
    mean = frames.groupBy("anim_id").agg(F.avg("duration_ms").alias("mean"))
    space = "C444alpha" if alpha else "C444"
    den = F.when(F.col("mean") > 0, F.floor("mean").cast("int")).otherwise(F.lit(DEFAULT_DURATION_MS))
    text = F.format_string(f"YUV4MPEG2 W%d H%d F1000:%d Ip A1:1 {space}\n", F.col("w").cast("long"), F.col("h").cast("long"), den.cast("long"))
    header = size.join(mean, "anim_id").select("anim_id", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), text.cast("binary").alias("bytes"))
    place = lambda *numbers: F.array(*numbers).cast("array<bigint>").alias("part")
    plane = F.col("w") * F.col("h")
    starts = (
        rank_within(frames.select("anim_id", "frame_no"), ["anim_id"], ["frame_no"], "nth")
        .join(header.select("anim_id", "w", "h", F.length("bytes").alias("head")), "anim_id")
        .withColumn("start", F.col("head") + F.col("nth") * (len(MARKER) + plane * (4 if alpha else 3)))
    )
    markers = starts.select("anim_id", place(F.col("frame_no"), F.lit(-1), F.lit(0)), F.col("start").alias("offset"), F.lit(MARKER).cast("binary").alias("bytes"))
    colour = F.greatest(*[F.array_size(c) for c in "rgb"])
    filled = [F.coalesce(F.col(c), F.when(colour.isNotNull(), F.array_repeat(F.lit(0), colour))).alias(c) for c in "rgb"]
    pixels = rows.select("anim_id", F.col("frame_no").cast("long").alias("frame_no"), F.col("y").cast("long").alias("y"), *filled, *channels[3:])
    made = pixels.mapInArrow(_planes(alpha), f"anim_id {pixels.schema['anim_id'].dataType.simpleString()}, {_PLANE_ROWS}")
    black = F.when(F.col("plane") == 0, "00").when(F.col("plane") < 3, "80").otherwise("FF")
    data = F.coalesce("bytes", F.unhex(F.repeat(black, F.col("w").cast("int")))).alias("bytes")
    body = made.join(starts.select("anim_id", F.col("frame_no").cast("long").alias("frame_no"), "start", "w", "h"), ["anim_id", "frame_no"]).select(
        "anim_id", place(F.col("frame_no"), F.col("plane"), F.col("y")), (F.col("start") + len(MARKER) + F.col("plane") * plane + F.col("y") * F.col("w")).alias("offset"), data
    )
    first = header.select("anim_id", place(F.lit(-1), F.lit(0), F.lit(0)), F.lit(0).cast("bigint").alias("offset"), "bytes")
    return first.unionByName(markers).unionByName(body)


def flat_rows(rasters: DataFrame) -> DataFrame:
    """Raster rows with the channels of a picture row side by side, as 8-bit integers.

    Output: image_id, y, r, g, b, a; grey repeats into g and b, no alpha gives null.
    """
    eight = F.transform("v", lambda a: to_uint8(a).cast("int"))
    channel = lambda c: F.max(F.when(F.col("c") == c, F.col("bytes")))
    return (
        rasters.withColumn("bytes", eight)
        .groupBy("image_id", "y")
        .agg(*[channel(c).alias(n) for c, n in enumerate("rgba")])
        .withColumn("g", F.coalesce("g", "r"))
        .withColumn("b", F.coalesce("b", "r"))
    )
