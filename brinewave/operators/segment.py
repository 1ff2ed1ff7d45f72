"""Epochs, stacks of epochs, and labels of windows from annotated intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.config import DEFAULT, Config
from brinewave.operators.asof import as_of


def epochs(samples: DataFrame, n: int, *, by: Sequence[str] = ("record_id",), index: str = "i", time: str = "t_sec") -> DataFrame:
    """Tumbling epochs of n samples: (by, epoch_id, n, start_sec); incomplete ones are dropped."""
    e = samples.withColumn("epoch_id", F.floor(F.col(index) / n))
    e = e.groupBy(*by, "epoch_id").agg(F.count("*").alias("n"), F.min(time).alias("start_sec"), F.max(time).alias("last_sec"))
    return e.where(F.col("n") == n)


def stacks(epochs_: DataFrame, config: Config = DEFAULT, *, by: Sequence[str] = ("record_id",)) -> DataFrame:
    """Hopping stacks of whole epochs: (by, window_id, first_epoch, last_epoch).

    Only the number of epochs of a recording is needed, so nothing but one row per recording is shuffled.
    """
    size, step = config.stack, config.step
    n = epochs_.groupBy(*by).agg((F.max("epoch_id") + 1).alias("n"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - size, F.lit(step).cast("long")))
    out = n.where(F.col("n") >= size).select(*by, first.alias("first_epoch"))
    return out.select(*by, F.floor(F.col("first_epoch") / step).alias("window_id"), "first_epoch", (F.col("first_epoch") + size - 1).alias("last_epoch"))


def stack_map(windows: DataFrame, config: Config = DEFAULT, *, by: Sequence[str] = ("record_id",)) -> DataFrame:
    """(by, window_id, w, epoch_id): which epochs a window has; samples are never copied."""
    w = F.posexplode(F.sequence("first_epoch", "last_epoch"))
    return windows.select(*by, "window_id", w.alias("w", "epoch_id"))


def hops(samples: DataFrame, width: float, step: float, *, by: Sequence[str] = ("record_id",), time: str = "t_sec") -> DataFrame:
    """(by, window_id, t0, t1): windows on a recording's own time that end before its last sample does."""
    last = samples.groupBy(*by).agg(F.max(time).alias("__last"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__last") - width) / step)))
    out = last.where(F.col("__last") >= width).select(*by, k.alias("window_id"))
    return out.withColumns({"t0": F.col("window_id") * F.lit(float(step)), "t1": F.col("window_id") * F.lit(float(step)) + F.lit(float(width))})


def complete_time_windows(samples: DataFrame, width: str, step: str, *, by: Sequence[str] = ("record_id",), time: str = "ts") -> DataFrame:
    """(by, w_start, w_end, n): sliding windows on the clock that lie between a recording's first and last sample."""
    ends = samples.groupBy(*by).agg(F.min(time).alias("__first"), F.max(time).alias("__last"))
    w = samples.groupBy(*by, F.window(time, width, step).alias("w")).agg(F.count("*").alias("n"))
    w = w.join(ends, list(by)).where((F.col("w.start") >= F.col("__first")) & (F.col("w.end") <= F.col("__last")))
    return w.select(*by, F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n")


def interval_overlap(windows: DataFrame, intervals: DataFrame, *, by: Sequence[str] = ("record_id",)) -> DataFrame:
    """windows with max_overlap (of one interval) and min_gap (seconds to the nearest interval, infinite without any).

    Recordings have few intervals, so the equi-join on the recording is the plan and the rest a row expression; the
    missing side of the left join is guarded, since least and greatest skip nulls.
    """
    j = windows.join(intervals.select(*by, "s0", "s1"), list(by), "left")
    none = F.col("s0").isNull()
    overlap = F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least("t1", "s1") - F.greatest("t0", "s0")))
    gap = F.when(none, F.lit(float("inf"))).when(F.col("t1") <= F.col("s0"), F.col("s0") - F.col("t1")).when(F.col("t0") >= F.col("s1"), F.col("t0") - F.col("s1")).otherwise(F.lit(float("inf")))
    keys = [*by, "window_id", "t0", "t1"]
    return j.groupBy(*keys).agg(F.max(overlap).alias("max_overlap"), F.min(gap).alias("min_gap"))


def interval_overlap_many(windows: DataFrame, intervals: DataFrame, *, by: Sequence[str] = ("record_id",), bin_sec: float = 3_600.0) -> DataFrame:
    """What interval_overlap gives, for recordings with many intervals: no window meets all intervals of its recording.

    Windows and intervals are cut into bins of time and meet within a bin; a pair that shares several bins counts in the
    first. The gap is to the last end before and the first start after a window, two as-of joins. Ends of intervals are
    not before their starts.
    """
    keys = [*by, "window_id", "t0", "t1"]
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_sec), F.floor(F.col(b) / bin_sec))).alias("__bin")
    w = windows.select(*keys, bins("t0", "t1"))
    i = intervals.where("s0 < s1").select(*by, "s0", "s1", bins("s0", "s1"))
    met = w.join(i, [*by, "__bin"]).where(F.col("__bin") == F.floor(F.greatest("t0", "s0") / bin_sec))
    most = met.groupBy(*keys).agg(F.max(F.least("t1", "s1") - F.greatest("t0", "s0")).alias("__most"))
    near = as_of(windows.select(*keys), intervals.select(*by, F.col("s1").alias("__end")), by=by, left_time="t0", right_time="__end", values=["__end"])
    near = as_of(near, intervals.select(*by, F.col("s0").alias("__start")), by=by, left_time="t1", right_time="__start", values=["__start"], forward=True)
    inf = F.lit(float("inf"))
    gap = F.least(F.coalesce(F.col("t0") - F.col("__end"), inf), F.coalesce(F.col("__start") - F.col("t1"), inf))
    out = near.join(most, keys, "left")
    return out.select(*keys, F.greatest(F.coalesce("__most", F.lit(0.0)), F.lit(0.0)).alias("max_overlap"), gap.alias("min_gap"))


def label(config: Config = DEFAULT, *, margin: float | None = None) -> Column:
    """1 if one interval covers enough of the window, 0 if none touches it and none is nearer than the margin, else -1."""
    margin = config.margin_sec if margin is None else margin
    share = F.col("max_overlap") / (F.col("t1") - F.col("t0"))
    return F.when(share >= config.ictal_overlap, 1).when((F.col("max_overlap") == 0) & (F.col("min_gap") >= margin), 0).otherwise(-1)


def label_windows(windows: DataFrame, intervals: DataFrame, config: Config = DEFAULT, *, margin: float | None = None, by: Sequence[str] = ("record_id",)) -> DataFrame:
    return interval_overlap(windows, intervals, by=by).withColumn("label", label(config, margin=margin))


def known(labelled: DataFrame) -> DataFrame:
    """Windows with a label; one row holds all of a window, so nothing has to be kept aligned."""
    return labelled.where("label <> -1")
