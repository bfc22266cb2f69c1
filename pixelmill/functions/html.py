"""What the attributes of page elements say: addresses, sizes, texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import bind

# Attributes that hold the real address of a lazily loaded image,
# in the order they are tried.
LAZY_ATTRIBUTES = (
    "data-src", "data-lazy-src", "data-original", "data-url", "data-image", "data-full",
    "data-highres", "data-srcset", "data-lazy", "data-echo", "data-lazyload", "data-source",
)

# Size given to an image whose size is unknown.
UNKNOWN_SIZE = 1000
ALT_LENGTH = 100

# A `url(...)` in a style text: the address bare or in either quotes, with blanks inside quotes.
_BACKGROUND = r"""background(?:-image)?\s*:[^;]*?url\(\s*(?:"([^"]*)"|'([^']*)'|([^'"\s)]+))\s*\)"""


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute in a map of them, or null."""
    return attrs[name]


def _stripped(text: Column) -> Column:
    """Without white space (line breaks too) at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _first_usable(urls: list[Column]) -> Column:
    """First address that is neither empty nor inline, or null."""
    usable = lambda u: (u != "") & ~u.startswith("data:") & ~u.startswith("blob:")
    return F.get(F.filter(F.array(*urls), usable), 0)


def best_srcset(srcset: Column) -> Column:
    """Address of the largest entry of a `srcset`; the first of equals.

    `640w` counts 640, `2x` counts 2000, no or another descriptor counts 1. One
    malformed number makes the whole result null.
    """
    entries = F.filter(F.transform(F.split(srcset, ","), _stripped), lambda e: e != "")

    def sized(entry: Column, pos: Column) -> Column:
        words = F.split(entry, r"\s+")
        hint = F.lower(F.get(words, 1))
        body = F.regexp_replace(hint, r".$", "")
        size = (
            F.when(hint.isNull(), F.lit(1).cast("bigint"))
            .when(hint.endswith("w"), F.when(body.rlike(r"^[+-]?\d+$"), body.try_cast("bigint")))
            .when(
                hint.endswith("x"),
                F.when(
                    body.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"),
                    (body.try_cast("double") * 1000).try_cast("bigint"),
                ),
            )
            .otherwise(F.lit(1).cast("bigint"))
        )
        return F.struct(size.alias("size"), (-pos).alias("rank"), F.get(words, 0).alias("url"))

    def choose(scored: Column) -> Column:
        return F.when(~F.exists(scored, lambda s: s["size"].isNull()), F.array_max(scored)["url"])

    return bind(F.transform(entries, sized), choose)


def lazy_source(attrs: Column, strict: bool = False) -> Column:
    """Address of an `<img>`: lazy attributes first, then `src`; null if none is usable.

    `strict` takes `data-srcset` as it stands, list and all; otherwise its best
    entry is taken.
    """
    picks = []
    for name in LAZY_ATTRIBUTES:
        value = attribute(attrs, name)
        if name == "data-srcset" and not strict:
            value = bind(value, lambda listed: F.coalesce(best_srcset(listed), listed))
        picks.append(value)
    return _first_usable([*picks, attribute(attrs, "src")])


def source_element_url(attrs: Column) -> Column:
    """Address of a `<source>`: best of `srcset` or `src`, else its first word."""
    def pick(raw: Column) -> Column:
        first = F.get(F.split(_stripped(F.get(F.split(raw, ","), 0)), r"\s+"), 0)
        return F.coalesce(F.nullif(best_srcset(raw), F.lit("")), first)

    raw = F.coalesce(F.nullif(attribute(attrs, "srcset"), F.lit("")), attribute(attrs, "src"))
    return _first_usable([bind(raw, pick)])


def background_url(style: Column) -> Column:
    return _first_usable([F.regexp_extract(style, _BACKGROUND, k) for k in (1, 2, 3)])


def image_size(attrs: Column) -> tuple[Column, Column]:
    """Width and height from attributes.

    Both missing gives the placeholder size; one missing stays 0. A width that is
    no number hides the height as well.
    """
    def number(name: str) -> Column:
        raw = F.coalesce(attribute(attrs, name), F.lit(""))
        return F.when(raw == "", F.lit(0)).when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).try_cast("int"))

    width = F.coalesce(number("width"), F.lit(0))
    height = F.when(number("width").isNull(), F.lit(0)).otherwise(F.coalesce(number("height"), F.lit(0)))
    unknown = (width == 0) & (height == 0)
    return (
        F.when(unknown, F.lit(UNKNOWN_SIZE)).otherwise(width),
        F.when(unknown, F.lit(UNKNOWN_SIZE)).otherwise(height),
    )


def truncate_alt(alt: Column) -> Column:
    return F.substring(F.coalesce(alt, F.lit("")), 1, ALT_LENGTH)
