"""Ordered computations per key that survive one dominant key: a prefix scan in two phases.

A plain window puts a whole key into one task. Here rows are range-partitioned by key and order
together, so a long key lies in several parts, one after the other. Each part passes its rows on and adds
one small row that sums up what it holds of its last key, once for every part behind it.
A window inside (part, key) then starts from those rows. The input is read once, there is no join, and the
caller need not say where to cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

PART, FROM = "__part", "__from"

#: What is kept of a run of rows: (value so far or None, new values) -> value.
Summary = Callable[[object, pa.Array], object]


def _total(kept: object, new: pa.Array) -> object:
    found = pc.sum(new).as_py()
    return found if kept is None else kept if found is None else kept + found


def _first(kept: object, new: pa.Array) -> object:
    return kept if kept is not None else (new[0].as_py(),)


def _last(kept: object, new: pa.Array) -> object:
    return (new[-1].as_py(),)


def _changes(kept: object, new: pa.Array) -> object:
    """(last value, how often a value differs from the one before it; null equals null)."""
    last, n = kept if kept is not None else (new[0].as_py(), 0)
    n += int(last != new[0].as_py())
    a, b = new.slice(1), new.slice(0, len(new) - 1)
    return new[-1].as_py(), n + (pc.sum(pc.fill_null(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null()))).as_py() or 0)


def _equal(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)  # NaN is a key like others


def _last_run(columns: list[pa.Array]) -> int:
    """Where the rows begin whose keys are all those of the last row; rows of one key are neighbours."""
    last = [c[-1].as_py() for c in columns]
    lo, hi = 0, len(columns[0]) - 1
    while lo < hi:
        at = (lo + hi) // 2
        lo, hi = (lo, at) if all(_equal(c[at].as_py(), x) for c, x in zip(columns, last)) else (at + 1, hi)
    return lo


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], kept: Mapping[str, tuple[str, Summary, Callable]]) -> DataFrame:
    """The rows with `__part`, and before each part's own rows one row per earlier part with what that part has of its last key.

    `kept`: name -> (column of that name's type to sum up, summary, what the carried row gets of it).
    Carried rows hold their keys, the `kept` columns, and null elsewhere; `__from` is the part they come
    from, and equals `__part` in own rows. Within a key `(__from, *order)` is the order of all rows.
    """
    keys, parts = list(keys), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, n_keys = df.columns, len(keys)
    places = [names.index(k) for k in keys]
    plan = [(names.index(name), names.index(source), add, show) for name, (source, add, show) in kept.items()]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), T.StructField(PART, T.IntegerType()), T.StructField(FROM, T.IntegerType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, state, form = TaskContext.get().partitionId(), None, {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.array(np.full(batch.num_rows, part, np.int32))
            form = pa.schema([*batch.schema, pa.field(PART, pa.int32()), pa.field(FROM, pa.int32())])
            yield pa.RecordBatch.from_arrays([*batch.columns, here, here], schema=form)
            own = [batch.column(p) for p in places]
            start = _last_run(own) if n_keys else 0
            now = [c[-1].as_py() for c in own]
            if start > 0 or last is None or not all(map(_equal, now, last)):
                last, state = now, {}
            for at, source, add, _ in plan:
                state[at] = add(state.get(at), batch.column(source).slice(start))
        behind = parts - part - 1
        if last is None or behind <= 0:
            return
        one: list[object] = [None] * len(names)
        for p, value in zip(places, last):
            one[p] = value
        for at, _, _, show in plan:
            one[at] = show(state[at])
        # One row as arrays, as often as there are parts behind.
        take = pa.array(np.zeros(behind, np.int64))
        columns = [pa.array([v], form.field(k).type).take(take) for k, v in enumerate(one)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.arange(part + 1, parts, dtype=np.int32)), pa.array(np.full(behind, part, np.int32))], schema=form
        )

    ranged = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    return ranged.mapInArrow(rows, schema)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    previous: Mapping[str, str] | None = None,
    runs: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running sums, previous values and numbers of runs per key over `order`, all in one pass.

    `order` must be total within a key (or its ties be interchangeable); nulls come first. Rows with
    null keys are one key.
    `sums`: name -> column, running total including the row itself.
    `previous`: name -> column name, its value on the row before; null on the first.
    `runs`: name -> column name; the 1-based number of the run of equal neighbours a row is in.
    """
    sums, previous, runs = dict(sums or {}), dict(previous or {}), dict(runs or {})
    given, kept, spare = df, {}, []

    def add(name: str, value: Column, source: str, summary: Summary, show: Callable) -> None:
        nonlocal given
        given = given.withColumn(name, value)
        kept[name] = (source, summary, show)
        spare.append(name)

    for name, value in sums.items():
        if df.select(value).dtypes[0][1] in ("tinyint", "smallint", "int"):
            value = value.cast("bigint")
        add(f"__sum_{name}", value, f"__sum_{name}", _total, lambda s: s)
    for name, source in previous.items():
        add(f"__last_{name}", F.col(source), f"__last_{name}", _last, lambda s: s[0])
    for name, source in runs.items():
        add(f"__head_{name}", F.col(source), f"__head_{name}", _first, lambda s: s[0])
        add(f"__tail_{name}", F.col(source), f"__tail_{name}", _last, lambda s: s[0])
        add(f"__more_{name}", F.lit(0).cast("bigint"), f"__head_{name}", _changes, lambda s: s[1])
    inner = Window.partitionBy(PART, *keys).orderBy(FROM, *order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = carried(given, keys, order, kept)
    for name in sums:
        out = out.withColumn(name, F.sum(f"__sum_{name}").over(upto))
    for name in previous:
        out = out.withColumn(name, F.lag(f"__last_{name}").over(inner))
    for name in runs:
        opens = F.coalesce(~F.lag(F.struct(f"__tail_{name}")).over(inner).eqNullSafe(F.struct(f"__head_{name}")), F.lit(True))
        out = out.withColumn(f"__new_{name}", opens.cast("bigint") + F.col(f"__more_{name}"))
        out = out.withColumn(name, F.sum(f"__new_{name}").over(upto))
        spare.append(f"__new_{name}")
    return out.where(F.col(PART) == F.col(FROM)).drop(*spare, PART, FROM)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """0-based position of every row inside its key."""
    counted = ordered(df, keys, order, sums={name: F.lit(1).cast("bigint")})
    return counted.withColumn(name, F.col(name) - 1)
