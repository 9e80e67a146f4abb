"""Keyed state with event-time timers: silence, spans of activity, last-wins deduplication.

Each operator is one processor per key with a single timer, run by ``transformWithState``; its state
is bounded by the watermark's delay and the operator's own span, and lives in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.monitoring import STALL_MS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession, stream: DataFrame) -> Iterator[None]:
    """``stream``, started inside the block, keeps its state in RocksDB if it has processors, which need it."""
    before = spark.conf.get(_PROVIDER)
    if "TransformWithState" in stream._jdf.queryExecution().analyzed().toString():
        spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Times(StatefulProcessor):
    """A processor of event times (milliseconds) whose state is a short list of numbers."""

    def __init__(self, by: Sequence[str], ts: str):
        self.by, self.ts = list(by), ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", T.StructType([T.StructField("numbers", T.ArrayType(T.LongType()))]))

    def load(self) -> list[int]:
        return list(self.held.get()[0]) if self.held.exists() else []

    def save(self, numbers: list[int], wake: int | None) -> None:
        if numbers:
            self.held.update(([int(x) for x in numbers],))
        else:
            self.held.clear()
        _arm(self.handle, wake)

    def rows(self, key: tuple, **columns: Sequence) -> Iterator[pd.DataFrame]:
        n = len(next(iter(columns.values())))
        if n:
            yield pd.DataFrame({**{name: [k] * n for name, k in zip(self.by, key)}, **columns})

    def arrived(self, frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for frame in frames:
            yield frame[self.ts].to_numpy(np.int64)

    def close(self) -> None:
        pass


def _move_timer(handle: StatefulProcessorHandle, armed: int | None, wake: int | None) -> None:
    """The key's one timer, known from its state, so that it need not be asked for."""
    if armed != wake:
        if armed is not None:
            handle.deleteTimer(armed)
        if wake is not None:
            handle.registerTimer(int(wake))


def _arm(handle: StatefulProcessorHandle, wake: int | None) -> None:
    armed = list(handle.listTimers())
    for t in armed:
        if t != wake:
            handle.deleteTimer(t)
    if wake is not None and wake not in armed:
        handle.registerTimer(int(wake))


class _Silence(_Times):
    """Emits the last message before a silence of more than ``limit``, once the watermark shows that none came.

    Messages that are still open to a late one are kept as the first and last of each slot, which is shorter than the limit.
    """

    def __init__(self, by: Sequence[str], ts: str, limit: int):
        super().__init__(by, ts)
        self.limit, self.slot = limit, max(1, limit // 15)

    def handleInputRows(self, key, rows, timerValues):
        edges: dict[int, tuple[int, int]] = {}

        def widen(slots: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            for s, a, b in zip(slots.tolist(), low.tolist(), high.tolist()):
                old = edges.get(s, (a, b))
                edges[s] = (min(a, old[0]), max(b, old[1]))

        kept = np.array(self.load(), np.int64)
        widen(kept // self.slot, kept, kept)
        for ts in self.arrived(rows):
            ts.sort()
            slots, first = np.unique(ts // self.slot, return_index=True)
            widen(slots, ts[first], ts[np.append(first[1:], len(ts)) - 1])
        times = sorted({t for pair in edges.values() for t in pair})
        self.save(times, times[0] + self.limit + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        times, now, silent, k = self.load(), timerValues.getCurrentWatermarkInMs(), [], 0
        while k < len(times) and times[k] + self.limit < now:
            if k + 1 == len(times) or times[k + 1] - times[k] > self.limit:
                silent.append(times[k])
            k += 1
        left = times[k:]
        self.save(left, left[0] + self.limit + 1 if left else None)
        yield from self.rows(key, stalled_from_ms=silent, overdue_ms=[t + self.limit for t in silent])


class _Spans(_Times):
    """Emits each span of activity whenever it grows, and with no messages where it was merged into an earlier one."""

    def __init__(self, by: Sequence[str], ts: str, gap: int):
        super().__init__(by, ts)
        self.gap = gap

    def handleInputRows(self, key, rows, timerValues):
        numbers = self.load()
        old = [tuple(numbers[k:k + 3]) for k in range(0, len(numbers), 3)]
        parts = list(old)
        for ts in self.arrived(rows):
            ts.sort()
            first = np.append(0, np.flatnonzero(np.diff(ts) > self.gap) + 1)
            last = np.append(first[1:], len(ts)) - 1
            parts += list(zip(ts[first].tolist(), ts[last].tolist(), (last - first + 1).tolist()))
        merged: list[list[int]] = []
        for start, end, n in sorted(parts):
            if merged and start - merged[-1][1] <= self.gap:
                merged[-1][1], merged[-1][2] = max(end, merged[-1][1]), merged[-1][2] + n
            else:
                merged.append([start, end, n])
        changed = [m for m in merged if tuple(m) not in old]
        gone = [s for s, _, _ in old if s not in {m[0] for m in merged}]
        open_ = [m for m in merged if m[1] + self.gap >= timerValues.getCurrentWatermarkInMs()]
        self.save([x for m in open_ for x in m], max(m[1] for m in open_) + self.gap + 1 if open_ else None)
        yield from self.rows(key, start_ms=[m[0] for m in changed] + gone, end_ms=[m[1] + self.gap for m in changed] + gone,
                             messages=[m[2] for m in changed] + [0] * len(gone))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.save([], None)
        return iter([])


class _LastWins(StatefulProcessor):
    """Holds the last arrival of each opening of a key and emits it when its bound has passed."""

    def __init__(self, schema: T.StructType, ts: str, order: Sequence[str], bound: int):
        self.schema, self.ts, self.order, self.bound = schema, ts, list(order), bound

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value a key, since every row of a list state is sent and converted on its own
        row = T.StructType([T.StructField("opened_", T.LongType()), *self.schema.fields])
        self.held = handle.getValueState("held", T.StructType([T.StructField("rows", T.ArrayType(row))]))

    def _load(self) -> list[tuple]:
        value = self.held.get()
        return [tuple(h) for h in value[0]] if value is not None else []

    def _wake(self, held: list[tuple]) -> int | None:
        return min(h[0] for h in held) + self.bound + 1 if held else None

    def _save(self, held: list[tuple], armed: int | None) -> None:
        if held:
            self.held.update((held,))
        else:
            self.held.clear()
        _move_timer(self.handle, armed, self._wake(held))

    def handleInputRows(self, key, rows, timerValues):
        names, held = self.schema.names, self._load()
        armed, at = self._wake(held), {n: k for k, n in enumerate(names)}
        place = lambda row: tuple((row[at[c]] is not None, row[at[c]]) for c in self.order)
        arrived = [tuple(r[n] for n in names) for r in rows]
        for row in sorted(arrived, key=lambda r: (r[at[self.ts]], place(r))):
            mine = next((k for k, h in enumerate(held) if abs(row[at[self.ts]] - h[0]) <= self.bound), None)
            if mine is None:
                held.append((row[at[self.ts]], *row))
            elif place(row) >= place(held[mine][1:]):
                held[mine] = (held[mine][0], *row)
        self._save(held, armed)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, held, row = timerValues.getCurrentWatermarkInMs(), self._load(), Row(*self.schema.names)
        # Spark takes the expired timer away itself
        self._save([h for h in held if h[0] + self.bound >= now], None)
        for h in held:
            if h[0] + self.bound < now:
                yield row(*h[1:])

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, by: Sequence[str], ts: str, event_time: str) -> DataFrame:
    return stream.where(F.col(ts).isNotNull()).select(*by, F.col(ts).cast("long").alias(ts), event_time)


def _keyed(by: Sequence[str], stream: DataFrame, *more: str) -> T.StructType:
    return T.StructType([*[stream.schema[c] for c in by], *[T.StructField(c, T.LongType()) for c in more]])


def stall_alerts(stream: DataFrame, by: Sequence[str], limit_ms: int = STALL_MS, ts: str = "ts_ms",
                 event_time: str = "event_time") -> DataFrame:
    """One row for each silence of more than ``limit_ms`` of a key, as soon as the watermark has passed its limit.

    The silence may still last: stalled_from_ms is the last message, overdue_ms when the limit was reached.  Append mode.
    """
    rows = _timed(stream, by, ts, event_time)
    return rows.groupBy(*by).transformWithStateInPandas(
        _Silence(by, ts, limit_ms), _keyed(by, stream, "stalled_from_ms", "overdue_ms"), "append", "eventTime")


def activity_spans(stream: DataFrame, by: Sequence[str], gap_ms: int = STALL_MS, ts: str = "ts_ms",
                   event_time: str = "event_time") -> DataFrame:
    """Spans of activity of a key at any time: messages at most ``gap_ms`` apart.  Update mode; start_ms names a span.

    A span whose start moved or that was merged into another is emitted once more without messages.
    """
    rows = _timed(stream, by, ts, event_time)
    return rows.groupBy(*by).transformWithStateInPandas(
        _Spans(by, ts, gap_ms), _keyed(by, stream, "start_ms", "end_ms", "messages"), "update", "eventTime")


def last_within(stream: DataFrame, keys: Sequence[str], order: Sequence[str], bound_ms: int, ts: str = "ts_ms",
                event_time: str = "event_time") -> DataFrame:
    """One row per key and opening, the last by ``order``: a row opens its key for ``bound_ms`` of event time.

    Rows that arrive within the bound replace it, later ones open the key anew; it is emitted when the
    watermark has passed the bound.  Append mode.
    """
    kept = T.StructType([f for f in stream.schema.fields if f.name != event_time])
    return stream.where(F.col(ts).isNotNull()).groupBy(*keys).transformWithState(
        _LastWins(kept, ts, order, bound_ms), kept, "append", "eventTime")
