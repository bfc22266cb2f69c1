"""Unique output names when overwriting is off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import ordered

_NUMBERED = r"^(.*)_(\d{3,})(\.[^.]*)?$"
_ENDING = r"_\d{3,}(\.[^.]*)?$"
_PLAIN, _NUMBER, _REQUEST = 0, 1, 2
#: Requests of one name that meet its taken numbers in one group; wider beyond WIDE.
BLOCK, WIDE = 1 << 20, 1 << 32


def _three_digits(n: Column) -> Column:
    return F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))


def _event(kind: int, name: Column, number: Column | None = None) -> Column:
    return F.struct(name.alias("__name"), F.lit(kind).alias("__kind"), (F.lit(None) if number is None else number).cast("bigint").alias("__number"))


def _events(kind: int, name: Column) -> Column:
    """The event of a name, and what a name `<base>_<n><ext>`, as this rule would write it, takes from `<base><ext>`."""
    part = lambda i: F.regexp_extract(name, _NUMBERED, i)
    number = part(2).try_cast("bigint")
    fits = (part(1) != "") & (number >= 2) & (_three_digits(number) == part(2))
    own = _event(kind, name)
    # Most names have no number; one short look tells.
    return F.when(name.rlike(_ENDING) & fits, F.array(own, _event(_NUMBER, F.concat(part(1), part(3)), number))).otherwise(F.array(own))


def _block(at: Column) -> Column:
    """The group of a place in a name's order: BLOCK places, and from WIDE on the places with equally many bits."""
    bits = F.length(F.bin(F.lit(WIDE)))
    return F.when(at < WIDE, F.floor(at / BLOCK)).otherwise(WIDE // BLOCK + F.length(F.bin(at)) - bits).cast("bigint")


def unique_names(planned: DataFrame, existing: DataFrame, order: Sequence[str]) -> DataFrame:
    """Gives every planned output (dir, base, ext) a free `name`, in `order`.

    The k-th request for a name takes the k-th free one of: the plain name, then
    `_002`, `_003`, ... `existing` lists files (dir, name). A number is free when no
    file has it and no other request asks for it as its plain name.

    Files with the plain name, taken numbers and requests are events of one plain name, in this order and from
    one reading of each table. An ordered scan counts taken numbers and requests. With the taken
    numbers t1 < t2 < ... the free numbers below tj are tj - 1 - j, so the i-th free number is i + 1
    plus the count of j with tj - 1 - j < i. For that, requests and numbers meet in blocks of i: the first number
    in a block also says how many came before it, there and in the blocks without numbers ahead of it;
    beyond the last number it is all of them, which each request knows. No list of numbers is ever
    gathered, and a name's requests are in as many groups as it has blocks.
    """
    plain = F.concat("base", "ext")
    # A row travels once: its name with the length of its base, the columns that order it, and the rest.
    rest = [c for c in planned.columns if c not in ("dir", "base", "ext", *order)]
    asked = planned.select(
        F.struct(
            F.length("base").alias("cut"), F.when(plain.isNull(), F.struct("base", "ext")).alias("odd"), F.struct(F.lit(True).alias("is"), *rest).alias("rest")
        ).alias("__item"),
        F.col("dir").alias("__dir"), *[F.col(c).alias(f"__by{k}") for k, c in enumerate(order)],
        F.explode(_events(_REQUEST, plain)).alias("__event"),
    )
    there = existing.select(
        F.col("dir").alias("__dir"), F.explode(_events(_PLAIN, F.col("name"))).alias("__event")
    )
    events = asked.unionByName(there, allowMissingColumns=True).select("*", "__event.*").drop("__event")
    events = events.withColumn("__item", F.when(F.col("__kind") == _REQUEST, F.col("__item")))
    # Names are next to each other by their hash, which sorts as a number where names of one folder begin alike.
    events = events.withColumn("__hash", F.xxhash64("__dir", "__name"))
    key, by = ["__hash", "__dir", "__name"], [f"__by{k}" for k in range(len(order))]
    of = lambda kind: (F.col("__kind") == kind).cast("bigint")
    counted = ordered(
        events, key, ["__kind", "__number", *by], sums={"__plain": of(_PLAIN), "__asked": of(_REQUEST)},
        previous={"__before": "__number"}, runs={"__j": "__number"},
    )
    request, new_number = F.col("__kind") == _REQUEST, (F.col("__kind") == _NUMBER) & ~F.col("__before").eqNullSafe(F.col("__number"))
    # Numbers up to here: files with the plain name before them are one run, and so are requests, if numbers come between.
    runs = F.col("__j") - 1 - F.when(F.col("__plain") > 0, 1).otherwise(0)
    all_taken = F.greatest(runs, F.lit(0))
    # 0 is the plain name, i >= 1 the i-th free number.
    asked_at = F.col("__asked") - F.when(F.col("__plain") > 0, 0).otherwise(1)
    taken_at = F.col("__number") - 2 - runs
    last = F.when(runs > 0, _block(F.col("__before") - 1 - runs)).otherwise(F.lit(-1).cast("bigint"))
    at = F.when(request, asked_at).otherwise(taken_at)
    own = F.lit(-1).cast("bigint")  # the row itself, beside the blocks it tells
    ahead = new_number & (last < _block(taken_at))
    steps = (
        counted.where(request | new_number)
        .select(*key, *by, "__item", "__kind", all_taken.alias("__all"), runs.alias("__runs"), at.alias("__at"), F.explode(
            F.when(ahead, F.concat(F.array(own), F.sequence(last + 1, _block(taken_at)))).otherwise(F.array(own))
        ).alias("__ahead"))
        .withColumn("__taken", F.when(~request, F.col("__runs") + F.when(F.col("__ahead") == own, 1).otherwise(0)))
        .withColumn("__block", F.when(F.col("__ahead") == own, _block(F.col("__at"))).otherwise(F.col("__ahead")))
        .withColumn("__at", F.when(F.col("__ahead") == own, F.col("__at")).otherwise(own))
        .drop("__ahead", "__runs")
    )
    # A number at a request's own place does not come before it.
    met = Window.partitionBy(*key, "__block").orderBy("__at", F.desc("__kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = steps.withColumn("__taken", F.max("__taken").over(met)).where(request)
    number = F.col("__at") + 1 + F.coalesce("__taken", "__all")
    base = F.when(F.col("__name").isNull(), F.col("__item.odd.base")).otherwise(F.substring("__name", F.lit(1), F.col("__item.cut")))
    ext = F.when(F.col("__name").isNull(), F.col("__item.odd.ext")).otherwise(F.substring("__name", F.col("__item.cut") + 1, F.length("__name")))
    name = F.when(F.col("__at") == 0, F.col("__name")).otherwise(F.concat(base, F.lit("_"), _three_digits(number), ext))
    given = {"dir": F.col("__dir"), "base": base, "ext": ext, **{c: F.col(by[k]) for k, c in enumerate(order) if c not in ("dir", "base", "ext")}}
    return placed.select(*[given.get(c, F.col(f"__item.rest.{c}")).alias(c) for c in planned.columns], name.alias("name"))
