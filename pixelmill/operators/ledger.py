"""The run ledger: resuming, summaries, progress, smoothed durations, log text.

`ledger`: run_id, input_path, output_path, model, status (done / skipped / failed),
reason, elapsed_s, ts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pixelmill.functions.filters import two_decimals
from pixelmill.functions.paths import base_name, format_hms
from .batches import changed
from .skew import FROM, PART, carried, ordered

SMOOTHING = 0.3  # fixed value: weight of the newest duration


def resume(assets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Work items (path, model) not yet done."""
    done = ledger.where(F.col("status") == "done").select(
        F.col("input_path").alias("path"), "model"
    )
    return assets.join(done, ["path", "model"], "left_anti")


def batch_summary(ledger: DataFrame) -> DataFrame:
    """Per run: totals, the closing message, mean seconds per processed item."""
    skipped = F.sum(F.when(F.col("status") == "skipped", 1).otherwise(0))
    done = F.sum(F.when(F.col("status") == "done", 1).otherwise(0))
    seconds = F.sum(F.when(F.col("status") == "done", F.col("elapsed_s")).otherwise(0.0))
    counts = ledger.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), skipped.alias("skipped"), done.alias("done"),
        seconds.alias("seconds"),
    )
    processed = F.col("total") - F.col("skipped")
    text = F.concat(F.lit("Completed "), processed.cast("string"), F.lit(" files"))
    return counts.select(
        "run_id", "total", "skipped", "done",
        processed.alias("processed"),
        F.when(F.col("skipped") > 0, F.concat(text, F.lit(" ("), F.col("skipped").cast("string"), F.lit(" skipped)")))
        .otherwise(text).alias("message"),
        F.when(F.col("done") > 0, F.col("seconds") / F.col("done")).alias("avg_s"),
    )


def running_progress(ledger: DataFrame, totals: DataFrame) -> DataFrame:
    """At every finished item: items done so far, seconds, average, remaining time.

    `totals`: run_id, total.
    """
    counted = ordered(
        ledger.where(F.col("status") == "done"), ["run_id"], ["ts", "input_path"],
        sums={"completed": F.lit(1).cast("bigint"), "elapsed": F.col("elapsed_s")},
    )
    average = F.col("elapsed") / F.col("completed")
    return (
        counted.join(totals, "run_id")
        .withColumn("avg_s", average)
        .withColumn("eta_s", (F.col("total") - F.col("completed")) * average)
        .withColumn("eta_text", format_hms(F.col("eta_s")))
    )


def linear_scan(x: np.ndarray, keep: float) -> np.ndarray:
    """y[r] = keep * y[r - 1] + x[r], from 0, for values that are not negative.

    An element is the map e -> keep * e + x, and maps compose, so blocks are scanned side by side and then
    joined. Inside a block the sum of x[i] / keep^i is taken, which grows by 1e13 at most, so every
    digit of the sums of positive values stands; two blocks before, a weight is below any digit.
    """
    size = min(max(1, int(30 / -np.log(keep))), max(1, len(x)))
    blocks = np.zeros((-(-len(x) // size), size))
    blocks.ravel()[: len(x)] = x
    weight = keep ** np.arange(1, size + 1)
    blocks = np.cumsum(blocks / weight, 1) * weight
    before = np.zeros(len(blocks))
    before[1:] = blocks[:-1, -1]
    before[2:] += weight[-1] * blocks[:-2, -1]
    return (blocks + before[:, None] * weight).ravel()[: len(x)]


_SHORT = 64


def segment_scan(x: np.ndarray, starts: np.ndarray, keep: float) -> np.ndarray:
    """linear_scan() of each segment; short ones are worked on together, place by place."""
    size = np.diff(np.append(starts, len(x)))
    out = x.astype(float)
    for a, n in zip(starts[size > _SHORT].tolist(), size[size > _SHORT].tolist()):
        out[a : a + n] = linear_scan(x[a : a + n], keep)
    short, size = starts[size <= _SHORT], size[size <= _SHORT]
    for r in range(1, int(size.max(initial=1))):
        at = short[size > r] + r
        out[at] += keep * out[at - 1]
    return out


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = SMOOTHING, name: str = "ema") -> DataFrame:
    """Exponential moving average over positive values, starting at the first one.

    Values that are null or not positive are left out; null keys are one key. Over a run of rows the
    recursion is one linear step, so a part's rows of a key are known by three numbers (first value, average
    from 0, count), which the parts behind start from; see `skew.carried`. The same result for every
    `alpha` between 0 and 1, both excluded.
    """
    keep = 1.0 - alpha
    given = df.where(F.col(value) > 0).withColumns({"__x": F.col(value).cast("double"), "__n": F.lit(1).cast("bigint"), "__end": F.col(value).cast("double")})

    def end(kept: object, new: pa.Array) -> object:
        e, n = kept if kept is not None else (0.0, 0)
        return linear_scan(alpha * new.to_numpy(), keep)[-1] + keep ** len(new) * e, n + len(new)

    kept = {
        "__x": ("__x", lambda s, new: s if s is not None else new[0].as_py(), lambda s: s),
        "__end": ("__x", end, lambda s: float(s[0])), "__n": ("__x", lambda s, new: (s or 0) + len(new), lambda s: s),
    }
    met = carried(given, keys, order, kept)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, PART, *keys).sortWithinPartitions(PART, *keys, FROM, *order)
    names = df.columns
    out = [met.schema.names.index(c) for c in names]

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, carry = None, None  # the group that the last batch ended in, and its average there
        for batch in batches:
            if not batch.num_rows:
                continue
            part, frm = batch.column(PART).to_numpy(), batch.column(FROM).to_numpy()
            x, n, ends = (batch.column(c).to_numpy() for c in ("__x", "__n", "__end"))
            columns = [batch.column(PART), *(batch.column(k) for k in keys)]
            starts = np.flatnonzero(changed(columns))
            group = [c[0].as_py() for c in columns]
            own, size = part == frm, np.diff(np.append(starts, batch.num_rows))
            first = np.full(len(starts), np.nan)  # what each group goes on from: nothing, or an average
            if group == open_:
                first[0] = carry
            # Rows of earlier parts, at most one a part, fold in one after the other.
            passed = np.zeros(len(starts), np.int64)
            for k in np.unique(np.searchsorted(starts, np.flatnonzero(~own), "right") - 1).tolist():
                for i in range(starts[k], starts[k] + size[k]):
                    if own[i]:
                        break
                    first[k] = keep ** n[i] * (x[i] if np.isnan(first[k]) else first[k]) + ends[i]
                    passed[k] += 1
            there = passed < size
            begin = (starts + passed)[there]
            base = np.where(np.isnan(first[there]), x[begin], first[there])
            mine = np.flatnonzero(own)
            where = np.searchsorted(mine, begin)
            local = segment_scan(alpha * x[mine], where, keep)
            length = np.diff(np.append(where, len(mine)))
            step = np.arange(len(mine)) - np.repeat(where, length) + 1
            result = local + keep**step * np.repeat(base, length)
            open_ = [c[-1].as_py() for c in columns]
            carry = float(result[-1]) if own[-1] else float(first[-1])
            take = pa.array(mine)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in out), pa.array(result)], [*names, name])

    return met.mapInArrow(average, T.StructType([*(met.schema[c] for c in df.columns), T.StructField(name, T.DoubleType())]))


def csv_lines(entries: DataFrame) -> DataFrame:
    """Adds `line`: the entry as one quoted CSV field, quotes doubled."""
    doubled = F.replace(F.col("entry"), F.lit('"'), F.lit('""'))
    return entries.withColumn("line", F.concat(F.lit('"'), doubled, F.lit('"')))


def ledger_text(ledger: DataFrame) -> DataFrame:
    """One line of text per finished or skipped item."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    name = base_name(F.col("input_path"))
    finished = F.concat(
        F.lit("["), stamp, F.lit("] "), name, F.lit(" -> "), base_name(F.col("output_path")),
        F.lit(" ("), two_decimals(F.col("elapsed_s")), F.lit("s)"),
    )
    skipped = F.concat(
        F.lit("["), stamp, F.lit("] SKIPPED: "), name, F.lit(" ("), F.coalesce("reason", F.lit("")), F.lit(")")
    )
    return ledger.where(F.col("status").isin("done", "skipped")).withColumn(
        "entry", F.when(F.col("status") == "skipped", skipped).otherwise(finished)
    )
