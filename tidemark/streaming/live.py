"""Features and labels over live streams.

Windows that are not over time do not run on streams, so a stream keeps its own state per key:
rows wait until the watermark has passed them, are then taken in point order, and come out with
the state of their key before and after them. With a label, a row is held until the watermark
has passed the label's time, and then read with the state of that time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.duration import Duration, as_duration

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(df: DataFrame, ts_ms: str, delay: Duration | str) -> DataFrame:
    """df with the time column `event_time` and a watermark that waits `delay` for late rows."""
    return df.withColumn("event_time", F.timestamp_millis(F.col(ts_ms))).withWatermark("event_time", f"{as_duration(delay).ms} milliseconds")


class _Running(StatefulProcessor):
    """Buffer to the watermark, fold in order, emit with the state before and after.

    A key has one timer, for its earliest row that waits: when it goes off everything up to the
    watermark is taken at once, so that what waits is read and written once a batch. Spark drops
    rows behind the watermark before they come here, and counts them (see `dropped`)."""

    def __init__(self, keys: list[str], ts: str, order: str, value: str, zero: float, combine: Callable[[Any, Any], Any], ahead: int | None):
        self.keys, self.ts, self.order, self.value = keys, ts, order, value
        self.zero, self.combine, self.ahead = zero, combine, ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = T.StructType([T.StructField("at", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("v", T.DoubleType())])
        self.waiting = handle.getListState("waiting", row)
        self.probes = handle.getListState("probes", row)
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("at", T.LongType())]))
        self.state = handle.getValueState("state", T.StructType([T.StructField("s", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            for at, order, v in zip(pdf[self.ts], pdf[self.order], pdf[self.value], strict=True):
                row = (int(at), int(order), float(v))
                self.waiting.appendValue(row)
                if self.ahead is not None:
                    self.probes.appendValue(row)
                first = row[0] if first is None else min(first, row[0])
        if first is not None:
            self._wake(first + 1)
        yield pd.DataFrame()

    def _wake(self, at: int) -> None:
        """Sets the timer of the key, unless an earlier one is set."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is not None and old <= at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        done = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - 1
        held = sorted(tuple(r) for r in self.waiting.get())
        asked = sorted(tuple(r) for r in self.probes.get()) if self.ahead is not None else []
        ready = [r for r in held if r[0] <= done]
        due = [r for r in asked if r[0] + self.ahead <= done]
        state = self.state.get()[0] if self.state.exists() else self.zero
        out, i = [], 0
        for at, order, v in ready if self.ahead is None else ():
            before, state = state, self.combine(state, v)
            out.append((*key, at, order, before, state))
        for at, order, _ in due:  # each with the state of its own later time
            while i < len(ready) and ready[i][0] <= at + self.ahead:
                state = self.combine(state, ready[i][2])
                i += 1
            out.append((*key, at, order, self.zero, float(state)))
        for _, _, v in ready[i:] if self.ahead is not None else ():
            state = self.combine(state, v)
        if ready:
            self.state.update((float(state),))
            self._keep(self.waiting, held[len(ready) :])
        if due:
            self._keep(self.probes, asked[len(due) :])
        times = [r[0] for r in held[len(ready) : len(ready) + 1]] + [r[0] + self.ahead for r in asked[len(due) : len(due) + 1]]
        if times:
            self._wake(min(times) + 1)
        yield pd.DataFrame(out, columns=[*self.keys, "ts_ms", "ord", "before", "after"]) if out else pd.DataFrame()

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def close(self) -> None:
        pass


def running(
    stream: DataFrame,
    keys: list[str],
    ts_ms: str,
    order: str,
    value: str,
    zero: float,
    combine: Callable[[Any, Any], Any],
    delay: Duration | str = "10s",
    look_forward: Duration | str | None = None,
) -> DataFrame:
    """(keys, ts_ms, ord, before, after) of a stream: the fold of `value` per key before and after each row.

    With look_forward, `after` is the state at that much later, and a row comes out once the
    watermark has passed that time. Rows later than `delay` are dropped and counted
    (`dropped`), rows with a null key, time,
    order or value are left out. Needs the RocksDB state store (see ROCKS).
    """
    rows = stream.dropna(subset=[*keys, ts_ms, order, value])
    kinds = dict(stream.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "ts_ms long, ord long, before double, after double"])
    timed = with_event_time(rows.select(*keys, ts_ms, order, value), ts_ms, delay)
    ahead = None if look_forward is None else as_duration(look_forward).ms
    processor = _Running(keys, ts_ms, order, value, zero, combine, ahead)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def dropped(query) -> int:
    """How many rows of a query came behind the watermark, by the progress that Spark still holds."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def candles(stream: DataFrame, key: str, ts_ms: str, order: str, price: str, volume: str, width: Duration | str, delay: Duration | str = "10s") -> DataFrame:
    """Tumbling candles of a stream; each one comes out when the watermark has passed its end."""
    rows = with_event_time(stream.dropna(subset=[key, ts_ms, price]), ts_ms, delay)
    point = F.struct(ts_ms, order)
    out = rows.groupBy(key, F.window("event_time", f"{as_duration(width).ms} milliseconds").alias("w")).agg(
        F.min_by(price, point).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, point).alias("close"),
        F.sum(F.coalesce(F.col(volume), F.lit(0))).alias("volume"),
        F.count("*").alias("ticks"),
    )
    return out.select(key, F.unix_millis("w.start").alias("start_ms"), "open", "high", "low", "close", "volume", "ticks")


def sessions(stream: DataFrame, key: str, ts_ms: str, gap: Duration | str, delay: Duration | str = "10s") -> DataFrame:
    """Sessions of a key: runs of rows with less than `gap` between them."""
    rows = with_event_time(stream, ts_ms, delay)
    out = rows.groupBy(key, F.session_window("event_time", f"{as_duration(gap).ms} milliseconds").alias("w")).agg(F.count("*").alias("rows"))
    return out.select(key, F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "rows")


def write_once(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """A sink that writes each micro-batch once: a batch that is run again replaces its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
