"""Covariance, eigenvalues, principal components, silhouettes and class shifts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.operators.pairs import Products, half_pairs, squares, vectors
from brinewave.operators.tables import cut_lineage


def aligned(samples: DataFrame, *, by: Sequence[str] = ("record_id",), index: str = "k", channel: str = "channel", value: str = "x") -> DataFrame:
    """(by, k, channel_a, channel_b, a, b): values of each pair of channels at the same index; channels bound the pairs."""
    keys = [*by, index]
    side = lambda s: samples.select(*keys, F.col(channel).alias(f"channel_{s}"), F.col(value).alias(s))
    return side("a").join(side("b"), keys).where("channel_a <= channel_b")


def time_slice(samples: DataFrame, rate: float, t0: float, t1: float, *, index: str = "k") -> DataFrame:
    """Samples from t0 up to, but not with, t1 seconds, by whole indices from 0; fractions are cut off."""
    return samples.where((F.col(index) >= int(t0 * rate)) & (F.col(index) < int(t1 * rate)))


def channel_covariance(samples: DataFrame, *, over: Sequence[str] = (), by: Sequence[str] = ("record_id",), span: tuple[float, float, float] | None = None, **names: str) -> DataFrame:
    """(over, channel_a, channel_b, cov, n): sample covariance (divisor n - 1) of aligned channels; span: rate, t0 and t1 of a slice."""
    if span:
        samples = time_slice(samples, *span, index=names.get("index", "k"))
    pairs = aligned(samples, by=by, **names)
    return pairs.groupBy(*over, "channel_a", "channel_b").agg(F.covar_samp("a", "b").alias("cov"), F.count("*").alias("n"))


def covariance_eigen(cov: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(channels, eigenvalues falling, eigenvectors as columns) of a covariance table; only a channels x channels matrix comes to the driver."""
    rows = cov.select("channel_a", "channel_b", "cov").toPandas()
    names = sorted(set(rows["channel_a"]) | set(rows["channel_b"]))
    at = {c: k for k, c in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, v in rows.itertuples(index=False):
        m[at[a], at[b]] = m[at[b], at[a]] = v
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(values)[::-1]
    return names, values[order], vectors[:, order]


def pca(points: DataFrame, k: int = 2, *, features: str = "features") -> tuple[DataFrame, list[float]]:
    """(points with pc1 .. pck, explained shares). Features are centred first; each component's largest loading is positive."""
    d = points.select(F.size(features)).first()[0]
    mean = points.select([F.avg(F.get(features, F.lit(i))).alias(f"m{i}") for i in range(d)]).first()
    centred = points.withColumn("__c", array_to_vector(F.zip_with(F.col(features).cast("array<double>"), F.array(*[F.lit(float(v)) for v in mean]), lambda x, m: x - m)))
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred)
    loads = model.pc.toArray()
    sign = np.sign(loads[np.abs(loads).argmax(axis=0), range(k)])
    out = model.transform(centred).withColumn("__a", vector_to_array("__p"))
    cols = {f"pc{i + 1}": F.get("__a", F.lit(i)) * float(sign[i]) for i in range(k)}
    return out.withColumns(cols).drop("__c", "__p", "__a"), [float(v) for v in model.explainedVariance]


SUMS = "id long, label long, other long, total double, n long"


def silhouette(points: DataFrame, *, id: str = "id", label: str = "label", features: str = "features") -> DataFrame:
    """(id, label, silhouette): exact, Euclidean; unlabelled (-1) points are left out, points alone in their class get 0.

    Every two blocks meet once, and distances are summed by class for both, so what is shuffled on is a row for each
    point, block and class. Distances are by products of matrices, those of near points by differences.
    """
    p = points.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(features).cast("array<double>").alias("v")).where("label <> -1")
    p = cut_lineage(p, "points")

    def sums(x: pa.Table, y: pa.Table, one: bool) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({c.split()[0]: np.empty(0, np.float64 if "double" in c else np.int64) for c in SUMS.split(", ")})
        x, y = x.sort_by("label"), y.sort_by("label")
        u, v = vectors(x), vectors(y)
        a, b = x["label"].to_numpy(), y["label"].to_numpy()
        total = [np.zeros((len(a), len(np.unique(b)))), np.zeros((len(b), len(np.unique(a))))]
        code = [np.unique(z, return_inverse=True)[1] for z in (a, b)]
        p = Products(u, v)
        for rows, cols, d in p.tiles(tile=(256, 1_024)):
            i, j = np.nonzero(d <= 1e6 * p.slack[rows, None])  # the root would lose digits
            d[i, j] = squares(u[rows], v[cols], i, j)
            np.sqrt(d, out=d)
            starts = np.flatnonzero(np.diff(code[1][cols], prepend=-1))
            total[0][rows, code[1][cols][starts]] += np.add.reduceat(d, starts, axis=1)
            if not one:
                starts = np.flatnonzero(np.diff(code[0][rows], prepend=-1))
                total[1][cols, code[0][rows][starts]] += np.add.reduceat(d, starts, axis=0).T
        out = []
        for own, other, part in [(x, b, total[0])] + ([] if one else [(y, a, total[1])]):
            names, n = np.unique(other, return_counts=True)
            k = len(names)
            out.append(pa.table({"id": np.repeat(own["id"].to_numpy(), k), "label": np.repeat(own["label"].to_numpy(), k), "other": np.tile(names, len(own)), "total": part.ravel(), "n": np.tile(n, len(own))}))
        return pa.concat_tables(out)

    s = half_pairs(p, sums, SUMS).groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("label") == F.col("other")
    s = s.groupBy("id", "label").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b")
    )
    value = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return s.where("b is not null").select("id", "label", value.alias("silhouette"))


def silhouette_score(points: DataFrame, **names: str) -> DataFrame:
    """One row: mean silhouette and number of points; null with fewer than two classes."""
    return silhouette(points, **names).agg(F.avg("silhouette").alias("silhouette"), F.count("*").alias("n"))


def band_shift(vectors: DataFrame, bands: int, channels: int, *, label: str = "y", features: str = "features", layout: str = "correct") -> DataFrame:
    """(band, ictal_mean, interictal_mean, delta) of flat vectors; an absent class counts as 0.

    layout correct: the vectors run epoch, band, channel. layout reference: they are read as epoch, channel, band, which
    mixes bands and channels, as the published figures do.
    """
    i = F.col("__i")
    band = F.floor(i % (bands * channels) / channels) if layout == "correct" else i % bands
    x = vectors.select(label, F.posexplode(features).alias("__i", "__v")).withColumn("band", band.cast("int"))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col(label) == c, F.col("__v").cast("double"))), F.lit(0.0))
    out = x.groupBy("band").agg(mean(1).alias("ictal_mean"), mean(0).alias("interictal_mean"))
    return out.withColumn("delta", F.col("ictal_mean") - F.col("interictal_mean"))


def math_summary(points: DataFrame, bands: int, channels: int, *, label: str = "y", features: str = "features") -> DataFrame:
    """One row: numbers of windows by class, explained shares of two components, silhouette of the windows in their
    plane, and the shift of each band's mean between the classes."""
    placed, share = pca(points, 2, features=features)
    plane = placed.select("id", F.col(label).alias("label"), F.array("pc1", "pc2").alias("features"))
    n = points.agg(F.count("*").alias("n_windows"), F.count_if(F.col(label) == 1).alias("n_ictal"), F.count_if(F.col(label) == 0).alias("n_interictal"))
    shift = band_shift(points, bands, channels, label=label, features=features)
    shift = shift.agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "delta"))), lambda s: s["delta"]).alias("band_shift"))
    score = silhouette_score(plane).select(F.col("silhouette").alias("silhouette_pca2d"))
    return n.join(F.broadcast(score)).join(F.broadcast(shift)).withColumn("pca_explained_variance", F.array(*map(F.lit, share)))
