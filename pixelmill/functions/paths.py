"""File names, natural ordering keys, output paths, model names, durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Suffixes that count as images.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "tiff", "tif", "gif")

# Upscale factors looked for in a model name, in this order.
MODEL_SCALES = (8, 4, 2, 1)
DEFAULT_MODEL_SCALE = 4


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot starts no suffix."""
    name = base_name(path)
    cut = F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    return F.when(cut != "", cut).otherwise(name)


def suffix(path: Column) -> Column:
    """Last suffix without the dot, or the empty string."""
    return F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1)


def is_image_suffix(ext: Column) -> Column:
    return F.lower(ext).isin(*IMAGE_SUFFIXES)


def natural_key(text: Column) -> Column:
    """Sortable key that puts `file2` before `file10`, without case.

    The text is cut into runs `letters+digits`; each becomes a struct that Spark
    orders natively. Digits compare by length first once leading zeros are gone,
    so no number is too long to compare.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\D*\d+|\D+"), F.lit(0))

    def piece(run: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(run, r"\d+$", 0), r"^0+(?=\d)", "")
        return F.struct(
            F.regexp_replace(run, r"\d+$", "").alias("text"),
            F.length(digits).alias("n_digits"),
            digits.alias("digits"),
        )

    return F.transform(runs, piece)


def format_hms(seconds: Column) -> Column:
    """Seconds, rounded half up and never negative, as HH:MM:SS (hours unbounded)."""
    whole = F.greatest(F.lit(0), F.floor(seconds + F.lit(0.5))).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(whole / 3600).cast("bigint"),
        F.floor((whole % 3600) / 60).cast("bigint"),
        whole % 60,
    )


def model_scale(path: Column) -> Column:
    """Upscale factor named in a model file; plain substring test, so `x2048` is 2."""
    name = F.lower(base_name(path))
    found = F.lit(DEFAULT_MODEL_SCALE)
    for n in reversed(MODEL_SCALES):
        marks = (f"{n}x_", f"_{n}x", f"x{n}", f"-{n}x", f"{n}x.")
        hit = F.lit(False)
        for mark in marks:
            hit = hit | name.contains(mark)
        found = F.when(hit, F.lit(n)).otherwise(found)
    return found


def artifact_key(
    model_path: Column,
    max_w: Column | int,
    max_h: Column | int,
    fp16: bool = False,
    bf16: bool = True,
    level: int = 5,
    graphs: bool = False,
) -> Column:
    """Deterministic name of the compiled form of a model under given settings."""
    precision = "fp16" if fp16 else "bf16" if bf16 else "fp32"
    as_text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    root = F.regexp_replace(model_path, r"(?<=[^/.])\.[^./]*$", "")
    return F.concat(
        root, F.lit(f"_{precision}_"), as_text(max_w), F.lit("x"), as_text(max_h),
        F.lit(f"_opt{level}" + ("_cg" if graphs else "") + ".trt"),
    )


def output_path(
    path: Column,
    mode: str = "output_dir",
    tag: str = "_upscaled",
    output_dir: str = "",
    root: Column | None = None,
    model: Column | str | None = None,
    fmt: str = "png",
) -> Column:
    """Where the result of `path` goes.

    `beside`: next to the input, tag in the file name. `folder`: the tree below
    `root` is mirrored below `root + tag`, names keep no tag. `output_dir`: one
    given folder, or `upscaled` below the input's folder when none is given.
    """
    if mode not in ("beside", "folder", "output_dir"):
        raise ValueError(f"unknown output mode: {mode}")
    folder, name = parent_dir(path), stem(path)
    ext = F.lit(fmt) if fmt else suffix(path)
    model_part = F.lit("")
    if isinstance(model, Column):
        model_part = F.when(F.coalesce(model, F.lit("")) != "", F.concat(F.lit("_"), model)).otherwise(F.lit(""))
    elif model:
        model_part = F.lit(f"_{model}")
    dot_ext = F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit(""))

    if mode == "folder" and root is not None:
        below = F.when(
            folder.startswith(F.concat(root, F.lit("/"))),
            F.substring(folder, F.length(root) + 1, F.length(folder)),
        ).otherwise(F.lit(""))
        return F.concat(root, F.lit(tag), below, F.lit("/"), name, model_part, dot_ext)
    if mode == "beside":
        target = folder
    elif output_dir.strip():
        target = F.lit(output_dir.rstrip("/") or "/")
    else:
        target = F.concat(folder, F.lit("/upscaled"))
    return F.concat(target, F.lit("/"), name, F.lit(tag), model_part, dot_ext)


def secondary_path(path: Column) -> Column:
    """Name of the second, smaller copy of an output."""
    return F.concat(parent_dir(path), F.lit("/"), stem(path), F.lit("_secondary.png"))
