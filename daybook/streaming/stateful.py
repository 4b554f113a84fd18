"""Folds with a state that ends: the same in batch and over a stream.

A ``Fold`` is a kernel of ``folds`` with what a stream needs beside it: the
columns of its state, a deadline at which a state acts without another row,
and a time-to-live after which the state of a silent key is forgotten.
``advance`` applies all three in order of event time and is all that batch
(``over_history``) and stream (``over_stream``) share.

Over a stream, rows wait in state until the watermark has passed them, and are
then taken in order of (time, id) whatever batch they came in. So rows that
are late, but within the watermark's delay, give the results of the batch;
later ones are dropped. Event-time timers wake a key for its waiting rows, its
deadline, or its end; an old wake-up is removed when a new one is set, so a
key has at most two. State is columns in the state store, not an opaque text.
A task holds the waiting rows of one key at a time.

Defined results: a null time is not seen by a stream and comes first in a
history. Rows of equal time are taken by id. A row at the very moment of a
deadline or an end comes after it. Times are seconds since 1970, in UTC.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from daybook.streaming import folds

HOUR, DAY = 3600.0, 86400.0
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Fold:
    """``kernel`` takes (state, rows of ``columns``) and gives (outputs, state);
    ``seconds`` among the columns is the time. ``state`` and ``out`` name the
    fields of the state and of an output. ``deadline`` takes (state, time of
    the last row) and gives a time or None, ``expire`` takes (state, that time)."""

    kernel: Callable
    columns: tuple[str, ...]
    state: str
    out: str
    ttl: float | None = None
    deadline: Callable | None = None
    expire: Callable | None = None


def advance(fold: Fold, held: tuple | None, rows: list[tuple], now: float) -> tuple[list, tuple | None]:
    """Rows in order of time, and what is due until ``now``. ``held`` is (state, time of the last row), or None."""
    state, last = held or (None, None)
    at, out = fold.columns.index("seconds"), []

    def settle(until: float) -> None:
        nonlocal state, last
        while last is not None:
            due, end = wakes(fold, (state, last))
            if due <= until and due <= end:
                made, state = fold.expire(state, due)
                out.extend(made)
                continue
            if end <= until:
                state = last = None
            break

    for row in rows:
        if row[at] is not None:
            settle(row[at])
        made, state = fold.kernel(state, [row])
        out.extend(made)
        last = row[at] if row[at] is not None else last
    settle(now)
    return out, None if last is None and state is None else (state, last)


def wakes(fold: Fold, held: tuple) -> tuple[float, float]:
    """The deadline and the end of a state; infinite where there is none."""
    state, last = held
    due = fold.deadline(state, last) if fold.deadline and state is not None else None
    return math.inf if due is None else due, math.inf if fold.ttl is None else last + fold.ttl


# ---------------------------------------------------------------- the folds


def _meeting_deadline(state: tuple, last: float, away: float = 300) -> float | None:
    """An open meeting ends ``away`` seconds after it was left, or after the last probe."""
    start, _, _, left = state
    return None if start is None else (last if left is None else left) + away


def _meeting_end(state: tuple, at: float) -> tuple[list, None]:
    return [(state[0], at)], None


DEDUP = Fold(folds.dedup_kernel, ("id", "seconds", "h", "monitor", "bookmarked", "paused"), "last long, monitor string", "id long", DAY)
TIERS = Fold(folds.title_tiers, ("id", "seconds", "h", "bookmarked", "app_name"), "h long, at double", "id long, tier string", HOUR)
ALERTS = Fold(folds.alert_kernel, ("id", "seconds", "app_name", "category"), "last_app string, since map<string,double>, work double, told map<string,double>", "id long, kind string, minutes int", DAY)
MEETINGS = Fold(folds.meeting_kernel, ("seconds", "voice", "in_front", "alive"), "start double, probe double, quiet int, left double", "start double, end double", DAY, _meeting_deadline, _meeting_end)
LOOKS = Fold(folds.look_kernel, ("seconds", "changed"), "saved double, skips int", "seconds double, saved boolean", DAY)


# -------------------------------------------------------------------- batch


def over_history(rows: DataFrame, fold: Fold, key: str | list[str], until: float = math.inf) -> DataFrame:
    """A fold over each key's whole history; what is due until ``until`` is done at its end."""
    keys = [key] if isinstance(key, str) else key
    shown = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return folds.per_key(rows, lambda held, some: advance(fold, held, some, -math.inf), keys, list(fold.columns), f"{shown}, {fold.out}", finish=lambda held: advance(fold, held, [], until)[0])


# ------------------------------------------------------------------- stream


class FoldProcessor(StatefulProcessor):
    """Spark's side of a fold: waiting rows, state columns and timers of a key."""

    def __init__(self, fold: Fold, keys: list[str], waiting: str, names: list[str]) -> None:
        self.fold, self.keys = fold, keys
        # types are read here, on the driver: workers have no session to do so
        self.waiting_type = T.StructType.fromDDL(waiting)
        own = [T.StructField(f"s{i}", f.dataType) for i, f in enumerate(T.StructType.fromDDL(fold.state))]
        self.held_type = T.StructType([*T.StructType.fromDDL("last double, wake long, known boolean"), *own])
        self.size = len(own)
        self.made = Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_type)
        self.held = handle.getValueState("held", self.held_type)

    def _load(self) -> tuple[tuple | None, int | None]:
        if not self.held.exists():
            return None, None
        last, wake, known, *state = self.held.get()
        return (tuple(state) if known else None, last), wake

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        skipped = len(self.keys) + 1  # the key and the event time don't wait
        found = [tuple(r)[skipped:] for r in rows if r[skipped] is not None]
        if found:
            self.waiting.appendList(found)
            self.handle.registerTimer(max(-(-r[0] // 1000) for r in found))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        there = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in there if r[0] <= now * 1000), key=lambda r: r[:2])
        held, wake = self._load()
        values = [tuple(r[0] / 1e6 if c == "seconds" else r[2 + i] for i, c in enumerate(self.fold.columns)) for r in ready]
        out, held = advance(self.fold, held, values, now / 1000)
        if ready:
            rest = [r for r in there if r[0] > now * 1000]
            self.waiting.put(rest) if rest else self.waiting.clear()
        self._save(held, wake)
        return iter([self.made(*key, *(x if isinstance(x, tuple) else (x,))) for x in out])

    def _save(self, held: tuple | None, before: int | None) -> None:
        soon = min(wakes(self.fold, held)) if held else math.inf
        wake = None if soon == math.inf else math.ceil(soon * 1000)
        if wake != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if wake is not None:
                self.handle.registerTimer(wake)
        if held is None:
            self.held.clear()
        else:
            state, last = held
            self.held.update((last, wake, state is not None, *(state if state is not None else (None,) * self.size)))

    def close(self) -> None:
        pass


def over_stream(stream: DataFrame, fold: Fold, key: str | list[str]) -> DataFrame:
    """A fold over a stream that has a watermark on ``timestamp``; a key's
    results appear when the watermark has passed the rows they come from."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keys = [key] if isinstance(key, str) else key
    given = {f.name: f.dataType.simpleString() for f in stream.schema}
    values = [(c, F.col(c) if c != "seconds" else F.lit(None).cast("double"), given.get(c, "double")) for c in fold.columns]
    rows = stream.select(*(F.col(k).alias(f"key{i}") for i, k in enumerate(keys)), "timestamp", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"), F.col("id").alias("place"), *(c.alias(f"v{i}") for i, (_, c, _) in enumerate(values)))
    waiting = ", ".join(["micros long", f"place {given['id']}", *(f"v{i} {kind}" for i, (_, _, kind) in enumerate(values))])
    out = ", ".join([*(f"{k} {given[k]}" for k in keys), fold.out])
    processor = FoldProcessor(fold, keys, waiting, T.StructType.fromDDL(out).names)
    return rows.groupBy(*(f"key{i}" for i in range(len(keys)))).transformWithState(processor, out, "Append", "EventTime")
