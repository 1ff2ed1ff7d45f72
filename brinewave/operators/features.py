"""Features of epochs in long form: (key, [channel,] name or band, value).

Every feature is computed per epoch, once; overlapping windows share epochs through the window map. The layouts of flat
vectors differ by set: spectral features run epoch, band, channel; the others epoch, channel, statistic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from brinewave.config import DEFAULT
from brinewave.functions import arrays as A

STATS = ("mean", "std", "skew", "kurtosis", "rms", "ptp")


def band_edges(bands: int = DEFAULT.bands, low: float = DEFAULT.band_low, high: float = DEFAULT.band_high) -> list[float]:
    return np.linspace(low, high, bands + 1).tolist()


def band_bins(n: int, rate: float, edges: Sequence[float]) -> list[list[int]]:
    """Bins of an n-point transform in each band, closed below and open above; a band may have none."""
    f = np.fft.rfftfreq(n, 1 / rate)
    return [[int(k) for k in np.flatnonzero((f >= a) & (f < b))] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def band_energy(epochs: DataFrame, n: int, rate: float, edges: Sequence[float], *, keys: Sequence[str], samples: str = "samples") -> DataFrame:
    """(keys, band, energy) by expressions alone: the plan is a projection and an explode, without shuffle."""
    x = F.col(samples)
    sums = []
    for bins in band_bins(n, rate, edges):
        e = F.lit(0.0)
        for k in bins:
            e = e + A.dft_energy(x, k, n)
        sums.append(e)
    return epochs.select(*keys, F.posexplode(F.array(*sums)).alias("band", "energy"))


def band_energy_fft(samples: Column, rate: float, edges: Sequence[float]) -> Column:
    """The same energies as an array, by one FFT for all epochs of a batch that have the same length."""
    edges = np.asarray(edges)

    @pandas_udf("array<double>")
    def of(rows: pd.Series) -> pd.Series:
        out: list = [None] * len(rows)
        sizes: dict[int, list[int]] = {}
        for i, x in enumerate(rows):
            if x is not None and len(x):
                sizes.setdefault(len(x), []).append(i)
        for n, at in sizes.items():
            power = np.abs(np.fft.rfft(np.stack([np.asarray(rows.iloc[i], float) for i in at]), axis=1)) ** 2
            slot = np.digitize(np.fft.rfftfreq(n, 1 / rate), edges) - 1
            energy = np.stack([power[:, slot == b].sum(axis=1) for b in range(len(edges) - 1)], axis=1)
            for i, e in zip(at, energy, strict=True):
                out[i] = e
        return pd.Series(out)

    return of(samples)


def basic_stats(epochs: DataFrame, *, keys: Sequence[str], samples: str = "samples") -> DataFrame:
    """(keys and six statistics): mean, population deviation, biased skewness, excess kurtosis, rms, peak to peak.

    Skewness and kurtosis of constant samples are null.
    """
    x = F.col(samples)
    m2 = A.moment(x, 2)
    return epochs.select(
        *keys,
        A.mean(x).alias("mean"),
        F.sqrt(m2).alias("std"),
        F.when(m2 > 0, A.moment(x, 3) / F.pow(m2, F.lit(1.5))).alias("skew"),
        F.when(m2 > 0, A.moment(x, 4) / (m2 * m2) - 3).alias("kurtosis"),
        F.sqrt(A.total(x, lambda v: v * v) / F.size(x)).alias("rms"),
        (F.array_max(x) - F.array_min(x)).alias("ptp"),
    )


def hjorth(epochs: DataFrame, *, keys: Sequence[str], samples: str = "samples") -> DataFrame:
    """(keys, mobility, complexity): sqrt(var d1 / var x) and sqrt(var d2 / var d1); 0 where the divisor is 0."""
    d = epochs.withColumn("__d1", A.differences(F.col(samples)))
    d = d.withColumn("__d2", A.differences(F.col("__d1")))
    v0, v1, v2 = (A.moment(F.col(c), 2) for c in (samples, "__d1", "__d2"))
    root = lambda a, b: F.when(b > 0, F.sqrt(a / b)).otherwise(F.lit(0.0))
    return d.select(*keys, root(v1, v0).alias("mobility"), root(v2, v1).alias("complexity"))


def long_form(wide: DataFrame, keys: Sequence[str], names: Sequence[str], kind: str) -> DataFrame:
    """(keys, feature_set, name, value) of a wide table."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names]))
    return wide.select(*keys, F.lit(kind).alias("feature_set"), pairs.alias("p")).select(*keys, "feature_set", "p.name", "p.value")


def registry(n: int, rate: float, edges: Sequence[float], keys: Sequence[str]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Feature sets by name, each from epochs to long form."""
    spectral = lambda e: band_energy(e, n, rate, edges, keys=keys).select(*keys, F.lit("spectral").alias("feature_set"), F.concat(F.lit("band"), F.col("band")).alias("name"), F.col("energy").alias("value"))
    return {
        "spectral": spectral,
        "stats": lambda e: long_form(basic_stats(e, keys=keys), keys, STATS, "stats"),
        "hjorth": lambda e: long_form(hjorth(e, keys=keys), keys, ("mobility", "complexity"), "hjorth"),
    }


def extract(epochs: DataFrame, sets: Sequence[str], *, n: int, rate: float, edges: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """The chosen feature sets, one below the other."""
    known = registry(n, rate, edges, keys)
    out = known[sets[0]](epochs)
    for s in sets[1:]:
        out = out.unionByName(known[s](epochs))
    return out


def vectors(features: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One array per key with the values in the given order of columns; what is gathered is as long as the feature set."""
    row = F.array_sort(F.collect_list(F.struct(*order, "value")))
    return features.groupBy(*keys).agg(row.alias("__rows")).select(*keys, F.col("__rows.value").alias("features"))


def majority_width(records: DataFrame, *, by: Sequence[str] = ("patient",), width: str = "width", record: str = "record_id") -> DataFrame:
    """(by, width, n): the most frequent width, of equal ones that of the first record."""
    n = records.groupBy(*by, width).agg(F.count("*").alias("n"), F.min(record).alias("__first"))
    best = F.min_by(F.struct(width, "n"), F.struct((-F.col("n")).alias("k"), "__first"))
    return n.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.width").alias(width), F.col("b.n").alias("n"))


def drop_minority(records: DataFrame, *, by: Sequence[str] = ("patient",), width: str = "width", record: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(records of the majority width, the others)."""
    best = majority_width(records, by=by, width=width, record=record).drop("n")
    return records.join(best, [*by, width], "left_semi"), records.join(best, [*by, width], "left_anti")
