"""Streaming forms of epochs and event detection, for recordings that arrive while they are made."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brinewave.config import DEFAULT


def stream_epochs(samples: DataFrame, expected: int, *, width: str = "2 seconds", late: str = "10 seconds", time: str = "ts", value: str = "x") -> DataFrame:
    """(record_id, channel, start, n, mean, std): tumbling epochs with all their samples; later rows than the watermark are lost."""
    w = samples.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "record_id", "channel")
    out = w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.where(F.col("n") == expected).select("record_id", "channel", F.col("w.start").alias("start"), "n", "mean", "std")


def stream_stacks(samples: DataFrame, expected: int, *, width: str = "6 seconds", step: str = "4 seconds", late: str = "10 seconds", time: str = "ts") -> DataFrame:
    """(record_id, start, n): sliding stacks that are complete."""
    w = samples.withWatermark(time, late).groupBy(F.window(time, width, step).alias("w"), "record_id").agg(F.count("*").alias("n"))
    return w.where(F.col("n") == expected).select("record_id", F.col("w.start").alias("start"), "n")


def stream_events(predictions: DataFrame, refractory: float = DEFAULT.refractory_sec) -> DataFrame:
    """(record_id, event_sec) from a stream of (record_id, t_sec, y_pred).

    The state of a recording is its last event and its last prediction. Rows of one batch are sorted by time; over
    batches they count in the order of arrival. The gap counts from the last event, so this is no session window.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before = state.get if state.exists else (float("-inf"), 0)
        rows = pd.concat(list(batches)).sort_values("t_sec", kind="stable")
        found = []
        for t, p in zip(rows["t_sec"], rows["y_pred"], strict=True):
            if p == 1 and before == 0 and t - last > refractory:
                found.append(float(t))
                last = float(t)
            before = int(p)
        state.update((last, before))
        yield pd.DataFrame({"record_id": [key[0]] * len(found), "event_sec": found})

    keyed = predictions.select("record_id", "t_sec", "y_pred").groupBy("record_id")
    return keyed.applyInPandasWithState(step, "record_id long, event_sec double", "last double, before int", "append", GroupStateTimeout.NoTimeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedEvents(StatefulProcessor):
    """Events of one recording in order of event time; see stream_ordered_events."""

    def __init__(self, refractory: float, idle_ms: int) -> None:
        self.refractory, self.idle_ms = refractory, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_sec double, before int, seen_ms long")
        self.waiting = handle.getMapState("waiting", "ms long, place long", "t_sec double, y_pred int")

    def _timer(self, ms: int) -> None:
        if ms not in {t for t, *_ in ([x] if isinstance(x, int) else x for x in self.handle.listTimers())}:
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
            for t, p, at, place in zip(pdf["t_sec"], pdf["y_pred"], ms, pdf["place"], strict=True):
                if at > mark:  # what is older than the watermark may come behind events that are out already
                    self.waiting.updateValue((int(at), int(place)), (float(t), int(p)))
                    self._timer(int(at))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        last, before, seen = self.last.get() if self.last.exists() else (None, 0, 0)
        due = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= mark)
        found = []
        for (ms, place), (t, p) in due:
            if p == 1 and before == 0 and (last is None or t - last > self.refractory):
                found.append(t)
                last = t
            before, seen = p, ms
            self.waiting.removeKey((ms, place))
        if due:
            self.last.update((last, before, seen))
            self._timer(seen + self.idle_ms)
        elif self.last.exists() and mark >= seen + self.idle_ms and not any(True for _ in self.waiting.keys()):
            self.last.clear()
        yield pd.DataFrame({"record_id": [key[0]] * len(found), "event_sec": pd.Series(found, dtype="float64")})

    def close(self) -> None:
        pass


def stream_ordered_events(predictions: DataFrame, refractory: float = DEFAULT.refractory_sec, *, late: str = "10 seconds", idle_sec: float = 86_400.0, time: str = "ts") -> DataFrame:
    """(record_id, event_sec) from a stream of (record_id, ts, t_sec, y_pred, place): the batch operator's events, whatever the order of arrival.

    Rows wait in the state until the watermark has passed them, and are then taken in order of time and place (which
    tells rows of one time apart); a timer of event time at each row wakes the recording. Rows behind the watermark are
    dropped. A recording that has no rows for idle_sec of event time is forgotten, so state doesn't grow with recordings
    that have ended. The state store must be RocksDB (`use_rocksdb`).
    """
    x = predictions.withWatermark(time, late).select("record_id", F.col(time).cast("timestamp").alias("ts"), F.col("t_sec").cast("double"), F.col("y_pred").cast("int"), F.col("place").cast("long"))
    return x.groupBy("record_id").transformWithStateInPandas(OrderedEvents(float(refractory), int(idle_sec * 1000)), "record_id long, event_sec double", "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def with_intervals(events: DataFrame, intervals: DataFrame, tol: float = DEFAULT.tolerance_sec) -> DataFrame:
    """Streamed events joined to a static table of intervals: which interval, if any, each event hits."""
    i = intervals.withColumnRenamed("record_id", "__r")
    near = (F.col("record_id") == F.col("__r")) & (F.col("event_sec") >= F.col("s0") - tol) & (F.col("event_sec") <= F.col("s1") + tol)
    return events.join(i, near, "left").drop("__r")
