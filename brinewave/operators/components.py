"""Independent components of recordings that stay cut into frames.

A frame is what all channels of a recording have in one tile: record_id, start_sample, rate, channels, samples (an array
for each channel, in the channels' order). Means, covariances, the steps of the fixed point and spectra are sums over
frames that Spark adds up; what is kept of a recording is of the size of its channels squared. No group holds a recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.config import DEFAULT
from brinewave.operators.signal import artefact_numbers, fixed_point, in_order, log_slopes
from brinewave.operators.tables import cut_lineage

WARM_UP_FRAMES = 8  # frames of a recording from which the first guess of its components comes, at most
WARM_UP_SAMPLES = 20_000  # samples of each of these, at most
SPECTRUM_SEC = 4.0  # of a segment whose spectrum is averaged
FULL_STEPS = 20  # steps over all frames after the first guess, at most
TOLERANCE = 1e-6


def frames(stretches: DataFrame) -> DataFrame:
    """(record_id, start_sample, rate, channels, samples) of stretches that begin at the same sample; stretches has rate."""
    g = stretches.groupBy("record_id", "start_sample").agg(F.array_sort(F.collect_list(F.struct("channel", "samples"))).alias("c"), F.min("rate").alias("rate"))
    return g.select("record_id", "start_sample", "rate", F.col("c.channel").alias("channels"), F.col("c.samples").alias("samples"))


def unlike(frames_: DataFrame) -> DataFrame:
    """(record_id, reason) of recordings whose frames don't have the same channels with as many samples each."""
    n = F.array_distinct(F.transform("samples", F.size))
    g = frames_.groupBy("record_id").agg(F.min(F.array_join("channels", "\n")).alias("a"), F.max(F.array_join("channels", "\n")).alias("b"), F.max(F.size(n)).alias("n"))
    return g.where("a <> b or n > 1").select("record_id", F.lit("channels of unequal lengths").alias("reason"))


def _stacked(samples) -> np.ndarray:
    return np.stack([np.asarray(s, float) for s in samples])


def summed(frames_: DataFrame, per_frame: Callable[[pd.Series], np.ndarray], *, state: DataFrame | None = None) -> DataFrame:
    """(record_id, sums): an array of numbers of every frame, added up for each recording.

    A task adds what it has of a recording before Spark does. state (record_id and more) is joined to the frames.
    """
    key = frames_.schema["record_id"].dataType.simpleString()
    joined = frames_ if state is None else frames_.join(state, "record_id")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for _, row in pdf.iterrows():
                x = per_frame(row)
                r = row["record_id"]
                total[r] = total[r] + x if r in total else x
            if len(total) > 1_000:
                yield pd.DataFrame({"record_id": list(total), "sums": [x.tolist() for x in total.values()]})
                total = {}
        if total:
            yield pd.DataFrame({"record_id": list(total), "sums": [x.tolist() for x in total.values()]})

    parts = joined.mapInPandas(of, f"record_id {key}, sums array<double>")
    each = parts.select("record_id", F.posexplode("sums").alias("k", "v")).groupBy("record_id", "k").agg(F.sum("v").alias("v"))
    return each.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s")).select("record_id", F.col("s.v").alias("sums"))


def moments(frames_: DataFrame) -> DataFrame:
    """(record_id, n, mean, cov): of the channels of whole recordings, cov row by row with divisor n - 1; about the first guess of the mean 0 for band-passed signals."""

    def of(row: pd.Series) -> np.ndarray:
        x = _stacked(row["samples"])
        return np.concatenate([[x.shape[1]], x.sum(axis=1), (x @ x.T).ravel()])

    m = summed(frames_.select("record_id", "samples"), of)
    key = frames_.schema["record_id"].dataType.simpleString()

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r, s in zip(pdf["record_id"], pdf["sums"], strict=True):
                s = np.asarray(s, float)
                c = int((np.sqrt(4 * len(s) - 3) - 1) / 2 + 0.5)  # c * c + c + 1 numbers
                n, mean = int(s[0]), s[1 : 1 + c] / s[0]
                cov = (s[1 + c :].reshape(c, c) - n * np.outer(mean, mean)) / max(n - 1, 1)
                out.append((r, n, mean.tolist(), cov.ravel().tolist()))
            yield pd.DataFrame(out, columns=["record_id", "n", "mean", "cov"])

    return m.mapInPandas(finish, f"record_id {key}, n long, mean array<double>, cov array<double>")


def whitening(cov: np.ndarray, n: int) -> np.ndarray:
    """The matrix that makes the n largest directions of a covariance uncorrelated with unit variance."""
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:n]
    return vectors[:, top].T / np.sqrt(np.maximum(values[top], 1e-12))[:, None]


def symmetric(w: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(w, full_matrices=False)
    return u @ v


def fixed_point_sums(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a frame of whitened samples adds to a step of the fixed point, and its number of samples."""
    g = np.tanh(w @ z)
    return np.concatenate([[z.shape[1]], (1 - g**2).sum(axis=1), (g @ z.T).ravel()])


def fixed_point_step(s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """(the next weights, how far they moved) from the sums of all frames."""
    n = len(w)
    new = symmetric(s[1 + n :].reshape(n, n) / s[0] - (s[1 : 1 + n] / s[0])[:, None] * w)
    return new, float(np.abs(np.abs((new * w).sum(axis=1)) - 1).max())


STATE = "mean array<double>, white array<double>, w array<double>, moved double"


def unmixing(frames_: DataFrame, components: int = DEFAULT.ica_components, *, iterations: int = DEFAULT.ica_iterations, seed: int = 42, warm_up: int = WARM_UP_FRAMES) -> DataFrame:
    """(record_id, mean, cov, unmixing, steps): sources of unit variance by symmetric fixed-point steps with tanh over all frames.

    The first guess comes from the kernel on about warm_up frames of a recording, drawn by their starts; a recording that
    has no more than these is done with it. For the others steps over all frames follow until their weights rest; weights
    that still move after FULL_STEPS (of sources that are all but Gaussian) are taken as they are. Recordings with fewer
    than two components are left out. frames_ should be a written table: every step reads it.
    """
    key = frames_.schema["record_id"].dataType.simpleString()
    m = cut_lineage(moments(frames_), "moments")
    m = m.where(F.least(F.lit(components), F.size("mean") - 1) >= 2)

    few = frames_.join(m.select("record_id", "mean", "cov"), "record_id", "inner")
    drawn = few.groupBy("record_id").agg(F.count("*").alias("of")).join(few, "record_id").where(F.pmod(F.xxhash64("start_sample", F.lit(seed)), F.ceil(F.col("of") / warm_up)) == 0)

    def guess(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_sample")
        mean, c = np.asarray(pdf["mean"].iloc[0], float), len(pdf["mean"].iloc[0])
        white = whitening(np.asarray(pdf["cov"].iloc[0], float).reshape(c, c), min(components, c - 1))
        z = white @ (np.concatenate([_stacked(s) for s in pdf["samples"]], axis=1) - mean[:, None])
        w = fixed_point(z, iterations=iterations, seed=seed, tolerance=TOLERANCE)
        whole = len(pdf) == pdf["of"].iloc[0] and all(len(s[0]) < WARM_UP_SAMPLES for s in pdf["samples"])
        return pd.DataFrame({"record_id": [pdf["record_id"].iloc[0]], "mean": [mean.tolist()], "white": [white.ravel().tolist()], "w": [w.ravel().tolist()], "moved": [0.0 if whole else 1.0]})

    # A recording without a frame in the draw starts from the identity.
    first = drawn.select("record_id", "start_sample", "of", F.transform("samples", lambda s: F.slice(s, 1, WARM_UP_SAMPLES)).alias("samples"), "mean", "cov").groupBy("record_id").applyInPandas(guess, f"record_id {key}, {STATE}")

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r, mean, cov in zip(pdf["record_id"], pdf["mean"], pdf["cov"], strict=True):
                n = min(components, len(mean) - 1)
                rows.append((r, list(mean), whitening(np.asarray(cov, float).reshape(len(mean), -1), n).ravel().tolist(), np.eye(n).ravel().tolist(), 1.0))
            yield pd.DataFrame(rows, columns=["record_id", "mean", "white", "w", "moved"])

    others = m.join(first.select("record_id"), "record_id", "left_anti").select("record_id", "mean", "cov").mapInPandas(plain, f"record_id {key}, {STATE}")
    state = cut_lineage(first.unionByName(others), "components")

    def one(row: pd.Series) -> np.ndarray:
        mean = np.asarray(row["mean"], float)
        white = np.asarray(row["white"], float).reshape(-1, len(mean))
        n = len(white)
        return fixed_point_sums(white @ (_stacked(row["samples"]) - mean[:, None]), np.asarray(row["w"], float).reshape(n, n))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r, s, mean, white, w in zip(*(pdf[c] for c in ("record_id", "sums", "mean", "white", "w")), strict=True):
                n = int(round(np.sqrt(len(w))))
                new, moved = fixed_point_step(np.asarray(s, float), np.asarray(w, float).reshape(n, n))
                rows.append((r, list(mean), list(white), new.ravel().tolist(), moved))
            yield pd.DataFrame(rows, columns=["record_id", "mean", "white", "w", "moved"])

    for _ in range(FULL_STEPS):
        going = state.where(F.col("moved") >= TOLERANCE)
        if going.isEmpty():
            break
        sums = summed(frames_.select("record_id", "samples"), one, state=going.drop("moved"))
        moved = sums.join(going.drop("moved"), "record_id").mapInPandas(step, f"record_id {key}, {STATE}")
        state = cut_lineage(moved.unionByName(state.where(F.col("moved") < TOLERANCE)), "components")

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r, mean, white, w in zip(pdf["record_id"], pdf["mean"], pdf["white"], pdf["w"], strict=True):
                n = int(round(np.sqrt(len(w))))
                out.append((r, list(mean), in_order(np.asarray(w, float).reshape(n, n) @ np.asarray(white, float).reshape(n, -1)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["record_id", "mean", "unmixing"])

    return state.mapInPandas(product, f"record_id {key}, mean array<double>, unmixing array<double>").join(m.select("record_id", "cov"), "record_id")


def variance_profile(frames_: DataFrame, components: int = DEFAULT.ica_components) -> DataFrame:
    """(record_id, component, share, channel_share): the share of each source's variance in all sources', and that of what it
    brings to the channels, by which they are numbered, largest first; from covariances and weights alone."""
    u = unmixing(frames_, components)
    key = frames_.schema["record_id"].dataType.simpleString()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, cov, w in zip(pdf["record_id"], pdf["cov"], pdf["unmixing"], strict=True):
                c = int(round(np.sqrt(len(cov))))
                cov, w = np.asarray(cov, float).reshape(c, c), np.asarray(w, float).reshape(-1, c)
                variance = np.diag(w @ cov @ w.T)
                brought = (np.linalg.pinv(w) ** 2).sum(axis=0) * variance
                order = np.argsort(-brought, kind="stable")
                yield pd.DataFrame({"record_id": r, "component": range(len(w)), "share": (variance / variance.sum())[order], "channel_share": (brought / brought.sum())[order]})

    return u.mapInPandas(of, f"record_id {key}, component int, share double, channel_share double")


def _spectrum(x: np.ndarray, rate: float) -> np.ndarray:
    """Summed power of whole segments of SPECTRUM_SEC of each source, and how many there are; x is sources x samples."""
    n = int(SPECTRUM_SEC * rate)
    k = x.shape[1] // n
    if not k:
        return np.zeros(1 + len(x) * (n // 2 + 1))
    power = (np.abs(np.fft.rfft(x[:, : k * n].reshape(len(x), k, n), axis=2)) ** 2).sum(axis=1)
    return np.concatenate([[k], power.ravel()])


def clean(stretches: DataFrame, *, components: int = DEFAULT.ica_components, eye: float = DEFAULT.eye_threshold, muscle: float = DEFAULT.muscle_threshold) -> DataFrame:
    """stretches with artefacts removed, and with status, reason and removed of their recording.

    Eye components follow a channel whose name begins with FP1 or FP2, muscle components rise with frequency; at most
    half of the components go. Correlations come from the covariance, slopes from spectra of segments averaged over all
    frames. A recording with fewer than two components, or whose channels are of unequal lengths, comes back as it was,
    with the status skipped or failed and the reason. stretches: record_id, channel, rate, start_sample, samples, cut
    alike in all channels of a recording.
    """
    f = cut_lineage(frames(stretches), "frames")
    odd = cut_lineage(unlike(f), "unlike")
    good = f.join(odd.select("record_id"), "record_id", "left_anti")
    u = cut_lineage(unmixing(good, components), "unmixing")
    key = f.schema["record_id"].dataType.simpleString()

    def spectra(row: pd.Series) -> np.ndarray:
        mean = np.asarray(row["mean"], float)
        w = np.asarray(row["unmixing"], float).reshape(-1, len(mean))
        return _spectrum(w @ (_stacked(row["samples"]) - mean[:, None]), float(row["rate"]))

    power = summed(good.select("record_id", "rate", "samples"), spectra, state=u.select("record_id", "mean", "unmixing"))
    names = good.groupBy("record_id").agg(F.min("channels").alias("channels"), F.min("rate").alias("rate"))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                c = len(r["mean"])
                w, cov, s = np.asarray(r["unmixing"], float).reshape(-1, c), np.asarray(r["cov"], float).reshape(c, c), np.asarray(r["sums"], float)
                with np.errstate(all="ignore"):
                    corr = np.nan_to_num(w @ cov / np.sqrt(np.outer(np.diag(w @ cov @ w.T), np.diag(cov))))
                slopes = log_slopes(s[1:].reshape(len(w), -1) / s[0], float(r["rate"])) if s[0] else None
                removed = artefact_numbers(corr, list(r["channels"]), slopes, eye, muscle)
                out.append((r["record_id"], removed, (np.linalg.pinv(w)[:, removed] @ w[removed]).ravel().tolist(), list(r["mean"])))
            yield pd.DataFrame(out, columns=["record_id", "removed", "part", "mean"])

    plans = u.join(power, "record_id").join(names, "record_id").mapInPandas(plan, f"record_id {key}, removed array<int>, part array<double>, mean array<double>")
    plans = cut_lineage(plans, "plans")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                samples, removed = row["samples"], []
                if row["mean"] is not None and row["reason"] is None:
                    x, mean = _stacked(samples), np.asarray(row["mean"], float)
                    samples, removed = list(x - np.asarray(row["part"], float).reshape(len(mean), -1) @ (x - mean[:, None])), list(row["removed"])
                status = "failed" if row["reason"] is not None else "skipped" if row["mean"] is None else "ok"
                reason = row["reason"] or ("fewer than two components" if status == "skipped" else "")
                yield pd.DataFrame({"record_id": row["record_id"], "channel": row["channels"], "rate": row["rate"], "start_sample": row["start_sample"], "samples": list(samples), "status": status, "reason": reason, "removed": [removed] * len(row["channels"])})

    whole = f.join(plans, "record_id", "left").join(odd, "record_id", "left")
    return whole.mapInPandas(apply, f"record_id {key}, channel string, rate double, start_sample long, samples array<double>, status string, reason string, removed array<int>")
