"""Image metadata maps, presets and short JSON lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# EXIF tags that describe resolution (main map) and pixel size
# (sub map); both are wrong after a resize.
RESOLUTION_TAGS = (282, 283, 296)
PIXEL_SIZE_TAGS = (40962, 40963)

# PNG text keys that are not free text.
RESERVED_TEXT_KEYS = ("icc_profile", "exif", "transparency", "dpi", "aspect")


def strip_exif(exif: Column, tags: tuple[int, ...] = RESOLUTION_TAGS + PIXEL_SIZE_TAGS) -> Column:
    """EXIF map<int,string> without resolution and pixel-size tags.

    For separate maps call it once with RESOLUTION_TAGS on the main map and once
    with PIXEL_SIZE_TAGS on the sub map.
    """
    return F.map_filter(exif, lambda tag, _: ~tag.isin(*tags))


def keep_png_text(text: Column) -> Column:
    return F.map_filter(text, lambda key, _: ~key.isin(*RESERVED_TEXT_KEYS))


def read_model_list(json: Column) -> Column:
    """JSON list of paths as array<string>; empty when it is not one."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def read_presets(json: Column) -> Column:
    """JSON object name -> fields; empty when it is not one."""
    return F.coalesce(
        F.from_json(json, "map<string,map<string,string>>"),
        F.create_map().cast("map<string,map<string,string>>"),
    )


def apply_preset(config: Column, preset: Column) -> Column:
    """Config map with the preset's values for the fields the config knows."""
    known = F.map_filter(preset, lambda key, _: F.map_contains_key(config, key))
    kept = F.map_filter(config, lambda key, _: ~F.map_contains_key(known, key))
    return F.map_concat(kept, known)


def save_preset(presets: Column, name: Column, fields: Column) -> Column:
    others = F.map_filter(presets, lambda key, _: key != name)
    return F.map_concat(others, F.create_map(name, fields))


def delete_preset(presets: Column, name: Column) -> Column:
    return F.map_filter(presets, lambda key, _: key != name)
