"""Image files: listing, header sizes, decoding to raster rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pixelmill.functions.paths import is_image_suffix, parent_dir, stem, suffix

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def local_path(path: Column) -> Column:
    """`file:/a/b` as `/a/b`; other schemes are kept."""
    return F.regexp_replace(path, r"^file:/+", "/")


def without_scheme(path: Column) -> Column:
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def scan_assets(spark: SparkSession, paths: Sequence[str], recursive: bool = True) -> DataFrame:
    """Image files below `paths` as assets; file contents are not read.

    Suffixes are compared without case, so the filter runs on the listing and not as
    a glob. Sort with `ordering.natural_sort` where the order matters.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(list(paths))
    )
    if not recursive:
        tops = [p.rstrip("/") for p in paths]
        here = F.lit(False)
        for top in tops:
            above, whole = without_scheme(parent_dir(F.col("path"))), without_scheme(F.col("path"))
            here = here | above.eqNullSafe(without_scheme(F.lit(top))) | whole.eqNullSafe(without_scheme(F.lit(top)))
        listed = listed.where(here)
    return (
        listed.select(local_path(F.col("path")).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
        .withColumn("ext", suffix(F.col("path")))
        .where(is_image_suffix(F.col("ext")))
        .select("path", parent_dir(F.col("path")).alias("dir"), stem(F.col("path")).alias("stem"), "ext", "size_bytes", "mtime")
    )


def _jpeg_size(raw: memoryview) -> tuple[int, int]:
    """From the first frame header; the segments before it are skipped by their length."""
    at = 2
    while True:
        marker = raw[at + 1]
        if raw[at] != 0xFF:
            raise ValueError("no marker")
        # FF fills, 01 and D0-D9 stand alone, C0-CF but C4, C8 and CC start a frame.
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD9:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", raw, at + 5)
            return width, height
        else:
            at += 2 + struct.unpack_from(">H", raw, at + 2)[0]


def _webp_size(raw: memoryview) -> tuple[int, int]:
    kind = bytes(raw[12:16])
    if kind == b"VP8 ":
        width, height = struct.unpack_from("<HH", raw, 26)
        return width & 0x3FFF, height & 0x3FFF
    if kind == b"VP8L":
        bits = struct.unpack_from("<I", raw, 21)[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X":
        return int.from_bytes(raw[24:27], "little") + 1, int.from_bytes(raw[27:30], "little") + 1
    raise ValueError("unknown chunk")


def _tiff_size(raw: memoryview) -> tuple[int, int]:
    """From the first directory, in either byte order, with values of 2 or 4 bytes."""
    order = "<" if raw[0] == 0x49 else ">"
    first = struct.unpack_from(order + "I", raw, 4)[0]
    found = {}
    for k in range(struct.unpack_from(order + "H", raw, first)[0]):
        tag, kind = struct.unpack_from(order + "HH", raw, first + 2 + 12 * k)
        if tag in (256, 257):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), raw, first + 10 + 12 * k)[0]
    return found[256], found[257]


def _header_size(raw: memoryview) -> tuple[int, int] | None:
    """Width and height, or null for other formats and damaged headers. File signatures."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack_from(">II", raw, 16)
        if raw[:4] == b"GIF8":
            return struct.unpack_from("<HH", raw, 6)
        if raw[:2] == b"BM":
            width, height = struct.unpack_from("<ii", raw, 18)
            return abs(width), abs(height)
        if raw[:3] == b"\xff\xd8\xff":
            return _jpeg_size(raw)
        if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            return _webp_size(raw)
        if raw[:4] in (b"II*\0", b"MM\0*"):
            return _tiff_size(raw)
    except (IndexError, KeyError, ValueError, struct.error):
        pass
    return None


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_header_size(memoryview(c.as_buffer()).cast("B")) if c.is_valid else None for c in batch.column(1)]
        width, height = ([f[k] if f else None for f in found] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(width, pa.int32()), pa.array(height, pa.int32())], ["path", "width", "height"])


def image_headers(files: DataFrame) -> DataFrame:
    """Width and height from the headers of PNG, GIF, BMP, JPEG, WebP and TIFF files; null otherwise.

    `content` may be cut after the header.
    """
    return files.select("path", "content").mapInArrow(_sizes, "path string, width int, height int")


_RASTER = "image_id string, c int, y int, h int, v array<double>"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes in blue-green-red order to rows of [0, 1]; grey repeats into three channels."""
    for record in batches:
        sizes = zip(*(record.column(n).to_pylist() for n in ("image_id", "height", "width", "n_channels")), strict=True)
        for data, (image, h, w, n) in zip(record.column("data"), sizes, strict=True):
            raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, n)
            order = [2, 1, 0] + ([3] if n == 4 else []) if n >= 3 else [0, 0, 0]
            planes = np.moveaxis(raw[:, :, order], 2, 0) / 255.0
            k = len(order)
            yield pa.RecordBatch.from_pydict({
                "image_id": pa.array([image] * (k * h), pa.string()),
                "c": pa.array(np.repeat(np.arange(k), h), pa.int32()),
                "y": pa.array(np.tile(np.arange(h), k), pa.int32()),
                "h": pa.array(np.full(k * h, h), pa.int32()),
                "v": pa.ListArray.from_arrays(
                    pa.array(np.arange(k * h + 1) * w, pa.int32()), pa.array(planes.reshape(-1))
                ),
            })


def load_rasters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decoded pictures as raster rows, and the (image_id, path, w, h, status, reason) table.

    The id is a 128-bit digest of the path, so both tables can be read apart and still
    agree, and no two pictures share one. A file that cannot be decoded has no raster
    rows; its row in the table has the status `failed` and null sizes.
    """
    images = (
        spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true")
        .load(path).select("image.*")
        .withColumn("image_id", F.md5("origin"))
        .withColumn("good", (F.col("height") > 0) & (F.col("width") > 0))
    )
    size = lambda name: F.when(F.col("good"), F.col(name))
    facts = images.select(
        "image_id", F.col("origin").alias("path"), size("width").alias("w"), size("height").alias("h"),
        F.when(F.col("good"), "done").otherwise("failed").alias("status"),
        F.when(~F.col("good"), "cannot be decoded").alias("reason"),
    )
    rows = images.where("good").select(
        "image_id", "height", "width", F.col("nChannels").alias("n_channels"), "data"
    ).mapInArrow(_decode, _RASTER)
    return rows, facts
