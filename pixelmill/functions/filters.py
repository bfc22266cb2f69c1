"""Predicates and the skip reason of a work item."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class SkipRules:
    """Which items to leave out. A limit of zero or less is off."""

    skip_existing: bool = False
    size_limits: bool = False
    min_width: int = 0
    min_height: int = 0
    max_width: int = 0
    max_height: int = 0
    aspect: bool = False
    aspect_mode: str = "any"
    aspect_min: float = 0.0
    aspect_max: float = 0.0


def two_decimals(value: Column) -> Column:
    """`value >= 0` with two decimals, rounded on the exact binary value, ties to even.

    The product with 100 is split into its rounded value and its rounding error,
    so a number that only looks like a tie in decimal is rounded the right way.
    """
    product = value * 100.0
    high = value * 134217729.0 - (value * 134217729.0 - value)
    error = (high * 100.0 - product) + (value - high) * 100.0
    whole = F.floor(product)
    part = (product - whole) + error
    up = (part > 0.5) | ((part == 0.5) & (whole % 2 == 1))
    cents = whole.cast("bigint") + F.when(up, 1).otherwise(0)
    return F.concat(
        F.floor(cents / 100).cast("bigint").cast("string"), F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(F.lit(1.0))


def skip_reason(
    rules: SkipRules, width: Column, height: Column, exists: Column | None = None
) -> Column:
    """First rule that drops the item, as text; null keeps it.

    An item of unknown size passes every size rule: the comparisons are null.
    """
    branches: list[tuple[Column, Column]] = []
    if rules.skip_existing and exists is not None:
        branches.append((exists, F.lit("output exists")))
    if rules.size_limits:
        for name, value, sign, word, limit in (
            ("width", width, "<", "min", rules.min_width),
            ("height", height, "<", "min", rules.min_height),
            ("width", width, ">", "max", rules.max_width),
            ("height", height, ">", "max", rules.max_height),
        ):
            if limit > 0:
                hit = value < limit if sign == "<" else value > limit
                text = F.concat(
                    F.lit(f"{name} "), value.cast("string"), F.lit(f" {sign} {word} {limit}")
                )
                branches.append((hit, text))
    if rules.aspect:
        ratio = aspect_ratio(width, height)
        known = width.isNotNull() & height.isNotNull()
        if rules.aspect_mode == "landscape":
            branches.append((known & (ratio <= 1.0), F.lit("not landscape")))
        elif rules.aspect_mode == "portrait":
            branches.append((known & (ratio >= 1.0), F.lit("not portrait")))
        elif rules.aspect_mode == "square":
            branches.append((known & ~ratio.between(0.95, 1.05), F.lit("not square")))
        elif rules.aspect_mode == "custom":
            shown = F.concat(F.lit("aspect "), two_decimals(ratio))
            if rules.aspect_min > 0:
                branches.append((known & (ratio < rules.aspect_min),
                                 F.concat(shown, F.lit(f" < min {rules.aspect_min}"))))
            if rules.aspect_max > 0:
                branches.append((known & (ratio > rules.aspect_max),
                                 F.concat(shown, F.lit(f" > max {rules.aspect_max}"))))
    if not branches:
        return F.lit(None).cast("string")
    chain = F.when(*branches[0])
    for condition, text in branches[1:]:
        chain = chain.when(condition, text)
    return chain


def has_inline_scheme(url: Column) -> Column:
    """True for `data:` and `blob:` addresses, which no one can fetch."""
    return url.startswith("data:") | url.startswith("blob:")
