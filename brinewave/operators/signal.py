"""Normalisation, filtering, resampling and artefact removal of signals.

Signals come in two forms: a row for each sample (key columns, an index, a value), and a row for each channel of a
bounded stretch with its samples as an array. Sample rows stay in built-in expressions; array kernels are numpy on
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from brinewave.config import DEFAULT


def channel_stats(samples: DataFrame, *, by: Sequence[str] = ("record_id", "channel"), value: str = "x") -> DataFrame:
    """Mean and population deviation per channel; partial sums before the shuffle."""
    return samples.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def zscore(samples: DataFrame, *, by: Sequence[str] = ("record_id", "channel"), value: str = "x", eps: float = DEFAULT.zscore_eps) -> DataFrame:
    """samples with z = (value - mean) / std; a deviation under eps counts as eps.

    The statistics are one row per channel and are joined back, so no channel has to fit into one task.
    """
    stats = channel_stats(samples, by=by, value=value).drop("n")
    joined = samples.join(stats, list(by))
    sd = F.when(F.col("std") < eps, F.lit(eps)).otherwise(F.col("std"))
    return joined.withColumn("z", (F.col(value) - F.col("mean")) / sd).drop("mean", "std")


def standardise(samples: Column, eps: float = DEFAULT.zscore_eps) -> Column:
    """Arrays of samples less their mean, over their population deviation; a deviation under eps counts as eps.

    A kernel on Arrow batches, because an expression of the whole array would be put back into the lambda that divides
    each sample by it, and be evaluated for each.
    """

    @pandas_udf("array<double>")
    def of(rows: pd.Series) -> pd.Series:
        arrays = [None if x is None else np.asarray(x, float) for x in rows]
        return pd.Series([x if x is None or not len(x) else (x - x.mean()) / max(float(x.std()), eps) for x in arrays])

    return of(samples)


def windowed_sinc(n: int, low: float, high: float, rate: float) -> list[float]:
    """Taps of a band-pass of odd length n with a Hamming window, scaled to gain 1 in the middle of the band."""
    k = np.arange(n) - (n - 1) / 2
    ideal = 2 * high / rate * np.sinc(2 * high / rate * k) - 2 * low / rate * np.sinc(2 * low / rate * k)
    taps = ideal * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    gain = (taps * np.cos(2 * np.pi * (low + high) / 2 / rate * k)).sum()
    return (taps / gain).tolist()


def fir(samples: DataFrame, taps: Sequence[float], *, by: Sequence[str] = ("record_id",), order: Sequence[str] = ("i",), value: str = "x") -> DataFrame:
    """samples with y, the centred convolution; beyond the ends the signal is 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    half = (len(taps) - 1) // 2
    out = F.lit(0.0)
    for k, tap in enumerate(taps):
        shift = half - k
        x = F.lag(value, shift).over(w) if shift > 0 else F.lead(value, -shift).over(w) if shift < 0 else F.col(value)
        out = out + F.lit(tap) * F.coalesce(x, F.lit(0.0))
    return samples.withColumn("y", out)


def band_pass_taps(rate: float, low: float = DEFAULT.low_hz, high: float = DEFAULT.high_hz, cap: float = DEFAULT.high_cap) -> list[float]:
    """Full-length taps. The transitions are a quarter of the band's edges, 2 Hz at least, as far as there is room; the
    cut-offs lie in their middles, so the edges themselves pass. The narrower one gives the length."""
    high = min(high, cap * rate / 2)
    below, above = min(max(low * 0.25, 2.0), low), min(max(high * 0.25, 2.0), rate / 2 - high)
    n = int(np.ceil(3.3 * rate / min(below, above))) | 1
    return windowed_sinc(n, low - below / 2, high + above / 2, rate)


def filtered(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Forward and backward pass by FFT, edges mirrored; zero phase."""
    n, m = len(x), len(taps)
    pad = min(m, max(n - 1, 0))
    ext = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]]) if pad else x
    size = 1 << (len(ext) + 2 * m).bit_length()
    gain = np.abs(np.fft.rfft(taps, size)) ** 2
    return np.fft.irfft(np.fft.rfft(ext, size) * gain, size)[pad : pad + n]


def band_pass(samples: Column, rate: float, **edges: float) -> Column:
    """Zero-phase band-pass of arrays of samples; each array is filtered by itself."""
    taps = np.array(band_pass_taps(rate, **edges))

    @pandas_udf("array<double>")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series([filtered(np.asarray(x, float), taps) if x is not None and len(x) else x for x in rows])

    return of(samples)


def resampled(x: np.ndarray, rate: float, target: float) -> np.ndarray:
    """Fourier resampling to another rate."""
    n = len(x)
    m = int(round(n * target / rate))
    if n == 0 or m == 0:
        return np.empty(0)
    spectrum = np.fft.rfft(x)
    keep = min(n, m) // 2 + 1
    out = np.zeros(m // 2 + 1, complex)
    out[:keep] = spectrum[:keep]
    if min(n, m) % 2 == 0:  # the bin at the smaller Nyquist rate is shared by both halves
        if m < n:
            out[keep - 1] *= 2
        elif m > n:
            out[keep - 1] *= 0.5
        out[keep - 1] = out[keep - 1].real if m < n else out[keep - 1]
    return np.fft.irfft(out, m) * (m / n)


def resample(samples: Column, rate: Column, target: float = DEFAULT.target_hz, tolerance: float = DEFAULT.rate_tolerance) -> Column:
    """Arrays of samples at the target rate; what is within the tolerance of it stays as it is."""

    @pandas_udf("array<double>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows, rates in batches:
            yield pd.Series([x if x is None or abs(r - target) < tolerance else resampled(np.asarray(x, float), r, target) for x, r in zip(rows, rates, strict=True)])

    return of(samples, rate)


def whiten(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whitened sources n x samples, whitening matrix, mean) of channels x samples."""
    mean = x.mean(axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(np.cov(x - mean))
    top = np.argsort(values)[::-1][:n]
    scale = 1 / np.sqrt(np.maximum(values[top], 1e-12))
    matrix = scale[:, None] * vectors[:, top].T
    return matrix @ (x - mean), matrix, mean


def fixed_point(z: np.ndarray, *, iterations: int = DEFAULT.ica_iterations, seed: int = 42, tolerance: float = 1e-6) -> np.ndarray:
    """Weights n x n of the independent sources of whitened samples n x samples, by symmetric steps with tanh."""
    n = len(z)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]
    for _ in range(iterations):
        g = np.tanh(w @ z)
        new = g @ z.T / z.shape[1] - (1 - g**2).mean(axis=1)[:, None] * w
        u, _, v = np.linalg.svd(new, full_matrices=False)
        new = u @ v
        moved = np.abs(np.abs((new * w).sum(axis=1)) - 1).max()
        w = new
        if moved < tolerance:
            break
    return w


def in_order(unmixing: np.ndarray) -> np.ndarray:
    """The same sources, the one that brings most to the channels first, and each with the sign that its largest weight in them is positive."""
    mixing = np.linalg.pinv(unmixing)
    at = np.argsort(-(mixing**2).sum(axis=0), kind="stable")
    largest = np.abs(mixing).argmax(axis=0)
    return (unmixing * np.sign(mixing[largest, range(len(unmixing))])[:, None])[at]


def fast_ica(x: np.ndarray, n: int, **options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sources n x samples of unit variance, unmixing n x channels, mean) of one array of channels x samples."""
    z, white, mean = whiten(x, n)
    unmixing = in_order(fixed_point(z, **options) @ white)
    return unmixing @ (x - mean), unmixing, mean


def _odd(scores: np.ndarray, threshold: float) -> set[int]:
    """Indices whose z-score passes the threshold, found again without those found before."""
    out: set[int] = set()
    while len(out) < len(scores):
        rest = [k for k in range(len(scores)) if k not in out]
        sd = scores[rest].std()
        new = {k for k in rest if sd > 0 and abs(scores[k] - scores[rest].mean()) / sd >= threshold}
        if not new:
            break
        out |= new
    return out


def mean_spectrum(sources: np.ndarray, rate: float, seconds: float) -> np.ndarray:
    """Power of whole segments of that length, averaged; of all samples where they are fewer."""
    n = min(int(seconds * rate), sources.shape[1])
    k = sources.shape[1] // n
    return (np.abs(np.fft.rfft(sources[:, : k * n].reshape(len(sources), k, n), axis=2)) ** 2).mean(axis=1)


def log_slopes(power: np.ndarray, rate: float) -> np.ndarray | None:
    """How steeply each source's power rises from 7 to 45 Hz, both in logarithms; None with too few frequencies."""
    f = np.linspace(0, rate / 2, power.shape[1])
    band = (f >= 7) & (f <= min(45.0, rate / 2))
    return np.polyfit(np.log(f[band]), np.log(power[:, band].T + 1e-30), 1)[0] if band.sum() > 2 else None


def artefact_numbers(corr: np.ndarray, channels: Sequence[str], slopes: np.ndarray | None, eye: float, muscle: float) -> list[int]:
    """Sources to remove, by their correlations with the channels (sources x channels) and their slopes; at most half, the first by number."""
    bad: set[int] = set()
    for k, name in enumerate(channels):
        if name.upper().startswith(("FP1", "FP2")):
            bad |= _odd(corr[:, k], eye)
    if slopes is not None:
        bad |= set(np.flatnonzero(1 / (1 + np.exp(-slopes)) >= muscle).tolist())
    return sorted(bad)[: len(corr) // 2]


def remove_artefacts(x: np.ndarray, channels: Sequence[str], rate: float, *, components: int = DEFAULT.ica_components, eye: float = DEFAULT.eye_threshold, muscle: float = DEFAULT.muscle_threshold, seconds: float = 4.0) -> tuple[np.ndarray, dict]:
    """(cleaned channels x samples, what was done) of one array. Eye components follow FP1 or FP2; muscle components rise with frequency.

    `components.clean` does the same for recordings in stretches. With fewer than two components, or if the fit fails,
    the signal comes back as it was, with the reason.
    """
    n = min(components, len(channels) - 1)
    if n < 2:
        return x, {"status": "skipped", "reason": "fewer than two components", "removed": []}
    try:
        sources, unmixing, _ = fast_ica(x, n)
    except np.linalg.LinAlgError as e:
        return x, {"status": "skipped", "reason": str(e), "removed": []}
    corr = np.nan_to_num(np.corrcoef(sources, x)[:n, n:])
    removed = artefact_numbers(corr, channels, log_slopes(mean_spectrum(sources, rate, seconds), rate), eye, muscle)
    return x - np.linalg.pinv(unmixing)[:, removed] @ sources[removed], {"status": "ok", "reason": "", "removed": removed}
