"""Filtering and normalising of long channels that stay cut into stretches.

A row is a stretch of a channel: record_id, channel, start_sample, samples. No channel is ever gathered into one row: a
filter takes what it needs of the neighbouring stretches, statistics are sums over stretches that Spark adds up.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from brinewave.config import DEFAULT, Config
from brinewave.operators.signal import band_pass_taps
from brinewave.operators.tables import short_batches

CHANNEL = ["record_id", "channel"]
BATCH_TILES = 1_000  # that a Python worker holds at once


def extents(stretches: DataFrame, rate: str = "rate") -> DataFrame:
    """(record_id, channel, total, rate, whole, one_rate) of every channel: its samples, whether its stretches follow each other from 0 without gap and overlap, and whether they have one rate.

    Only starts and lengths of stretches are gathered, as many as a channel has stretches.
    """
    part = F.struct(F.col("start_sample").alias("at"), F.size("samples").cast("long").alias("n"))
    c = stretches.groupBy(*CHANNEL).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min(rate).alias("rate"), F.max(rate).alias("__most"))
    end = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: F.when((s >= 0) & (s == p["at"]), s + p["n"]).otherwise(F.lit(-1).cast("long")))
    return c.select(*CHANNEL, "rate", end.alias("total"), (end >= 0).alias("whole"), F.coalesce(F.col("rate") == F.col("__most"), F.lit(False)).alias("one_rate"))


def tiles(stretches: DataFrame, size: Column, halo: Column, *, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(record_id, channel, tile, keep, total, first, samples): stretches cut anew into tiles of size samples, each with up to halo samples of what lies before and behind.

    stretches has total, the channel's number of samples. first is where samples begin, before the tile by the halo that
    there is. A stretch goes only to the tiles that need some of it.
    """
    n = F.size("samples").cast("long")
    s = stretches.withColumns({"__size": size.cast("long"), "__halo": halo.cast("long")}).where(n > 0)
    low, high = F.floor((F.col("start_sample") - F.col("__halo")) / F.col("__size")), F.floor((F.col("start_sample") + n - 1 + F.col("__halo")) / F.col("__size"))
    last = F.floor((F.col("total") - 1) / F.col("__size"))
    s = s.withColumn("tile", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, last))))
    a = F.greatest(F.col("start_sample"), F.col("tile") * F.col("__size") - F.col("__halo"))
    b = F.least(F.col("start_sample") + n, (F.col("tile") + 1) * F.col("__size") + F.col("__halo"))
    piece = F.struct(a.alias("at"), F.slice("samples", (a - F.col("start_sample") + 1).cast("int"), (b - a).cast("int")).alias("x"))
    g = s.groupBy(*CHANNEL, "tile", "total", "__size", *keep).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return g.select(*CHANNEL, "tile", *keep, "total", (F.col("tile") * F.col("__size")).alias("start_sample"), F.least("__size", F.col("total") - F.col("tile") * F.col("__size")).cast("int").alias("n"), F.col("p")[0]["at"].alias("first"), F.flatten("p.x").alias("samples"))


@lru_cache(maxsize=32)
def _taps(rate: float, low: float, high: float, cap: float) -> np.ndarray:
    return np.array(band_pass_taps(rate, low, high, cap))


def filtered_tile(x: np.ndarray, first: int, total: int, start: int, n: int, taps: np.ndarray) -> np.ndarray:
    """Samples start to start + n of a channel of total samples, filtered forward and backward; x are its samples from first on, with len(taps) of them on both sides if there are so many.

    Beyond the channel's ends it is mirrored as a whole channel is, and 0 beyond that.
    """
    m = len(taps)
    pad = min(m, max(total - 1, 0))
    at = np.arange(start - m, start + n + m)
    inner = np.clip(at, 0, total - 1)
    mirror = np.where(at < 0, -at, np.where(at >= total, 2 * (total - 1) - at, at))
    beyond = (at < -pad) | (at >= total + pad)
    take = np.clip(np.where(beyond, inner, mirror) - first, 0, len(x) - 1)
    ext = x[take]
    edge = np.where(at < 0, x[0], x[-1])  # only used where the channel's end is within reach, and x then reaches it
    ext = np.where(beyond, 0.0, np.where((at < 0) | (at >= total), 2 * edge - ext, ext))
    width = 1 << (len(ext) + 2 * m).bit_length()
    gain = np.abs(np.fft.rfft(taps, width)) ** 2
    return np.fft.irfft(np.fft.rfft(ext, width) * gain, width)[m : m + n]


def band_pass(stretches: DataFrame, config: Config = DEFAULT, *, tile: Column | None = None, taps: list[float] | None = None) -> DataFrame:
    """(record_id, channel, rate, total, start_sample, samples): the zero-phase band-pass of whole channels, by tiles with a halo of the filter's length.

    stretches has rate and total; a tile has a minute of samples unless said otherwise. Equal to the filter of a whole channel but for rounding. taps: instead of the band-pass's.
    """
    short_batches(stretches.sparkSession, BATCH_TILES)
    low, high, cap = config.low_hz, config.high_hz, config.high_cap
    given = None if taps is None else np.array(taps)

    @pandas_udf("int")
    def length(rates: pd.Series) -> pd.Series:
        return rates.map(lambda r: len(_taps(r, low, high, cap)))

    halo = F.lit(len(given)) if given is not None else F.col("__m")
    rates = stretches if given is not None else stretches.join(stretches.select("rate").distinct().withColumn("__m", length("rate")), "rate")
    t = tiles(rates, F.greatest(F.lit(1), F.floor(F.col("rate") * 60)) if tile is None else tile, halo, keep=["rate"])

    @pandas_udf("array<double>")
    def of(x: pd.Series, rate: pd.Series, first: pd.Series, total: pd.Series, start: pd.Series, n: pd.Series) -> pd.Series:
        own = lambda r: given if given is not None else _taps(r, low, high, cap)
        return pd.Series([filtered_tile(np.asarray(v, float), f, c, s, k, own(r)) for v, r, f, c, s, k in zip(x, rate, first, total, start, n, strict=True)])

    return t.select(*CHANNEL, "rate", "total", "start_sample", of("samples", "rate", "first", "total", "start_sample", "n").alias("samples"))


def moments(samples: Column) -> Column:
    """struct<n, mean, m2> of an array: its number, mean and sum of squared deviations."""

    @pandas_udf("n long, mean double, m2 double")
    def of(rows: pd.Series) -> pd.DataFrame:
        x = [np.asarray(v, float) for v in rows]
        mean = [v.mean() if len(v) else 0.0 for v in x]
        return pd.DataFrame({"n": [len(v) for v in x], "mean": mean, "m2": [((v - m) ** 2).sum() for v, m in zip(x, mean, strict=True)]})

    return of(samples)


def channel_moments(stretches: DataFrame) -> DataFrame:
    """(record_id, channel, mean, std): of whole channels, the population deviation; sums of what each stretch has."""
    m = stretches.select(*CHANNEL, moments(F.col("samples")).alias("m")).where("m.n > 0")
    g = m.groupBy(*CHANNEL).agg(F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("m.mean")).alias("s"), F.sum("m.m2").alias("within"), F.sum(F.col("m.n") * F.col("m.mean") * F.col("m.mean")).alias("q"))
    mean = F.col("s") / F.col("n")
    between = F.greatest(F.lit(0.0), F.col("q") - F.col("n") * mean * mean)
    return g.select(*CHANNEL, mean.alias("mean"), F.sqrt((F.col("within") + between) / F.col("n")).alias("std"))


def standardise(stretches: DataFrame, eps: float = DEFAULT.zscore_eps) -> DataFrame:
    """stretches with samples less their channel's mean, over its deviation (eps at least), and with mean and std."""

    @pandas_udf("array<double>")
    def of(rows: pd.Series, mean: pd.Series, std: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(x, float) - m) / max(s, eps) for x, m, s in zip(rows, mean, std, strict=True)])

    j = stretches.join(channel_moments(stretches), CHANNEL)
    return j.withColumn("samples", of("samples", "mean", "std"))


def whole(stretches: DataFrame, *, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(record_id, channel, keep, samples): channels gathered into one row each, for what can't be done by stretches."""
    parts = F.array_sort(F.collect_list(F.struct("start_sample", "samples")))
    return stretches.groupBy(*CHANNEL, *keep).agg(parts.alias("p")).select(*CHANNEL, *keep, F.flatten("p.samples").alias("samples"))
