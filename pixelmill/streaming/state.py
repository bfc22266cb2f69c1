"""Keyed state: file readiness, frame runs and smoothed durations as rows arrive, in any order.

A row waits in its key's list until the watermark has passed it; an event-time timer then takes all rows
that are due, in order, whatever micro-batch they came with. What a key knows of its past is one
small value. It is forgotten once the watermark is `keep` seconds past the key's last row, so state
ends with the files, animations and runs it is about. Rows later than the watermark are dropped by
Spark. Results come as late as the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pixelmill.operators.ledger import SMOOTHING

#: From rows in order, what is known of the key (None at first) and the key: results, and what is known then.
Fold = Callable[[pd.DataFrame, tuple | None, tuple], tuple[pd.DataFrame, tuple]]

DELAY, KEEP_S = "10 minutes", 86_400


class _InOrder(StatefulProcessor):
    """Gives `fold` a key's rows in order of time and `order`."""

    def __init__(self, columns: list[tuple[str, str]], order: list[str], known: str, fold: Fold, keep_ms: int):
        self.columns, self.order, self.known_schema, self.fold, self.keep_ms = columns, order, known, fold, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{name} {kind}" for name, kind in self.columns))
        self.known = handle.getValueState("known", f"last_ms long, {self.known_schema}")

    def handleInputRows(self, key, rows, timerValues):
        latest = None
        for data in rows:
            data = data[[name for name, _ in self.columns]].astype(object)
            data = data.where(data.notna(), None)
            self.waiting.appendList(list(data.itertuples(index=False, name=None)))
            latest = max(int(data["us"].max()), latest or 0)
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] // 1000 < now], [r for r in rows if r[0] // 1000 >= now]
        known = self.known.get() if self.known.exists() else None
        if due:
            data = pd.DataFrame(due, columns=[name for name, _ in self.columns]).sort_values(["us", *self.order], kind="stable")
            out, value = self.fold(data, None if known is None else tuple(known[1:]), key)
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            last = max(int(data["us"].iloc[-1]) // 1000, known[0] if known is not None else 0)
            self.known.update((last, *value))
            self.handle.registerTimer(last + self.keep_ms + 1)
            yield out
        elif known is not None and not rest and now > known[0] + self.keep_ms:
            self.known.clear()
            yield pd.DataFrame()
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def _before(values: pd.Series, known: tuple | None) -> pd.Series:
    """The value of the row before; null at the very first."""
    before = values.astype(object).shift(1)
    before.iloc[0] = known[0] if known is not None else None
    return before.where(before.notna(), None)


def _ready(data: pd.DataFrame, known: tuple | None, key: tuple) -> tuple[pd.DataFrame, tuple]:
    size = data["size_bytes"]
    kept = data[(size.astype(float) > 0) & (_before(size, known) == size)].assign(path=key[0])
    last = size.iloc[-1]
    return kept[["path", "size_bytes", "look_id"]], (None if pd.isna(last) else int(last),)


def _changes(data: pd.DataFrame, known: tuple | None, key: tuple) -> tuple[pd.DataFrame, tuple]:
    sig = data["sig"].astype(object).where(data["sig"].notna(), None)
    before = _before(sig, known)
    # Null equals null, as in the batch form; the first frame is always new.
    new = ~((before == sig) | (before.isna() & sig.isna()))
    if known is None:
        new.iloc[0] = True
    return data[new].assign(anim_id=key[0])[["anim_id", "frame_no", "sig"]], (sig.iloc[-1],)


def _metrics(data: pd.DataFrame, known: tuple | None, key: tuple) -> tuple[pd.DataFrame, tuple]:
    e, n, total = known if known is not None else (0.0, 0, 0.0)
    out = []
    for path, x in zip(data["input_path"], data["elapsed_s"]):
        if x > 0:
            e = x if e <= 0 else (1.0 - SMOOTHING) * e + SMOOTHING * x
        n, total = n + 1, total + x
        out.append((key[0], path, n, e, total / n))
    return pd.DataFrame(out, columns=["run_id", "input_path", "completed", "ema", "avg_s"]), (float(e), int(n), float(total))


def _stateful(df: DataFrame, key: str, at: str, columns: list[tuple[str, str]], known: str, fold: Fold, schema: str, delay: str, keep_s: int) -> DataFrame:
    order = [name for name, _ in columns]
    timed = df.withWatermark(at, delay).select(key, at, F.unix_micros(at).alias("us"), *[name for name in order if name != key])
    processor = _InOrder([("us", "long"), *columns], order, known, fold, keep_s * 1000)
    return timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def ready(looks: DataFrame, delay: str = DELAY, keep_s: int = KEEP_S) -> DataFrame:
    """Stream form of `catalog.ready_files` (path, size_bytes, seen_at, look_id)."""
    return _stateful(
        looks, "path", "seen_at", [("look_id", "long"), ("size_bytes", "long")], "size long", _ready,
        "path string, size_bytes long, look_id long", delay, keep_s,
    )


def stream_frame_dedupe(frames: DataFrame, delay: str = DELAY, keep_s: int = KEEP_S) -> DataFrame:
    """First frame of every run, as frames arrive (anim_id, frame_no, sig, at): `at` is a frame's time and grows with its number."""
    return _stateful(
        frames, "anim_id", "at", [("frame_no", "long"), ("sig", "string")], "sig string", _changes,
        "anim_id long, frame_no long, sig string", delay, keep_s,
    )


def stream_metrics(finished: DataFrame, delay: str = DELAY, keep_s: int = KEEP_S) -> DataFrame:
    """At every finished item: count, smoothed duration, average (run_id, input_path, elapsed_s, ts)."""
    return _stateful(
        finished, "run_id", "ts", [("input_path", "string"), ("elapsed_s", "double")], "e double, n long, total double", _metrics,
        "run_id long, input_path string, completed long, ema double, avg_s double", delay, keep_s,
    )
