"""Leave-one-record-out folds and the models that run on them.

Statistics that add up (means, deviations, centroids) are taken for all folds at once as total less the held-out
record. Fitted models run fold by fold over a cached table, a few folds at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewave.config import DEFAULT
from brinewave.operators import forest
from brinewave.operators.cells import cells_of, meet, placed, visits
from brinewave.operators.pairs import k_nearest, matrix, vectors
from brinewave.operators.tables import cut_lineage

AT_ONCE = 4


def fold_guard(windows: DataFrame, *, group: str = "patient", record: str = "record_id", label: str = "y_true") -> DataFrame:
    """(group, record, n_train, n_train_positive, status): a fold without training rows or with one class is skipped."""
    own = windows.groupBy(group, record).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    whole = Window.partitionBy(group)
    out = own.withColumns({"n_train": F.sum("n").over(whole) - F.col("n"), "n_train_positive": F.sum("p").over(whole) - F.col("p")})
    good = (F.col("n_train") > 0) & (F.col("n_train_positive") > 0) & (F.col("n_train_positive") < F.col("n_train"))
    return out.select(group, record, "n_train", "n_train_positive", F.when(good, "kept").otherwise("skipped").alias("status"))


def fold_scaler(points: DataFrame, *, record: str = "record_id", features: str = "features") -> DataFrame:
    """(record, dim, mean, std): of all other records' features, population deviation, 1 where it is 0.

    One pass: sums per record and dimension, then total less own.
    """
    x = points.select(record, F.posexplode(features).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    own = x.groupBy(record, "dim").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    whole = Window.partitionBy("dim")
    n, s, q = (F.sum(c).over(whole) - F.col(c) for c in "nsq")
    out = own.select(record, "dim", n.alias("n"), s.alias("s"), q.alias("q")).where("n > 0")
    variance = F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2)), F.lit(0.0))
    return out.select(record, "dim", (F.col("s") / F.col("n")).alias("mean"), F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1.0)).alias("std"))


def nearest_centroid(points: DataFrame, *, id: str = "id", record: str = "record_id", label: str = "y", features: str = "features", leave_out: bool = True) -> DataFrame:
    """(id, record, label, pred): the class whose centroid is nearest; of the other records' rows, or of all.

    Centroids are sums per record, class and dimension; total less own gives every fold's.
    """
    x = points.select(F.col(record).alias("__r"), F.col(label).alias("__c"), F.posexplode(features).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    own = x.groupBy("__r", "__c", "dim").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    if leave_out:
        total = own.groupBy("__c", "dim").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
        folds = own.select("__r").distinct()
        each = total.withColumn("__k", F.lit(1)).join(folds.withColumn("__k", F.lit(1)), "__k").drop("__k")
        each = each.join(own, ["__r", "__c", "dim"], "left")
        each = each.select("__r", "__c", "dim", (F.col("ts") - F.coalesce("s", F.lit(0.0))).alias("s"), (F.col("tn") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    else:
        each = own.groupBy("__c", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    keys = ["__r", "__c"] if leave_out else ["__c"]
    c = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", (F.col("s") / F.col("n")).alias("m")))).alias("a")).select(*keys, F.col("a.m").alias("__m"))
    by = c.groupBy(*(["__r"] if leave_out else [])).agg(F.array_sort(F.collect_list(F.struct("__c", "__m"))).alias("__cs"))
    p = points.select(F.col(id).alias("id"), F.col(record).alias(record), F.col(label).alias(label), F.col(features).cast("array<double>").alias("__x"), F.col(record).alias("__r"))
    j = p.join(by, "__r") if leave_out else p.withColumn("__k", F.lit(1)).join(by.withColumn("__k", F.lit(1)), "__k")
    d = lambda m: F.aggregate(F.zip_with("__x", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("__cs", lambda e: F.struct(d(e["__m"]).alias("d"), e["__c"].alias("c"))))
    return j.select("id", record, label, best["c"].alias("pred"), best["d"].alias("distance2"))


TOP = "id long, record long, y long, other long, other_y long, d double"


def knn(points: DataFrame, k: int = DEFAULT.neighbours, *, id: str = "id", record: str = "record_id", label: str = "y", features: str = "features", rows: int | None = None) -> DataFrame:
    """(id, record, y, votes, y_pred, y_score): votes of the k nearest rows of other records, by distance and then id.

    A row first looks in its own chunk of a cell; the distance of its k-th neighbour there bounds the chunks that it then
    visits, and what it takes from each. Each group hands on k rows at most for each of its queries.
    """
    p = points.select(F.col(id).cast("long").alias("id"), F.col(record).cast("long").alias("record"), F.col(label).cast("long").alias("y"), F.col(features).cast("array<double>").alias("v"))
    p = cut_lineage(p, "points")
    cells = cells_of(p, rows=rows)

    def nearest(x: pa.Table, y: pa.Table) -> pa.Table:
        """Of each of x the nearest of y; of equal distances, the smaller id first."""
        y = y.sort_by("id")
        bound = x["radius"].to_numpy() if "radius" in x.column_names else None
        i, j, d = k_nearest(vectors(x), vectors(y), k, x["record"].to_numpy(), y["record"].to_numpy(), bound)
        found = {c: x[c].to_numpy()[i] for c in ("id", "record", "y")} | {"other": y["id"].to_numpy()[j], "other_y": y["y"].to_numpy()[j], "d": d}
        return pa.table(found)

    least = lambda near: near.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))).where(F.col("__n") <= k).drop("__n")
    searched = cut_lineage(placed(p, cells), "placed")
    own = cut_lineage(searched.groupBy("block").applyInArrow(lambda x: nearest(x, x), TOP), "near")
    bound = own.groupBy("id").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    asking = p.join(bound, "id", "left").withColumn("radius", F.when(F.col("n") == k, F.col("d")).otherwise(F.lit(float("inf")))).drop("n", "d")
    # What is asked travels; what is searched stays with its chunk.
    far = meet(visits(asking, cells).where("not own"), searched, nearest, TOP, parts=cells.parts())
    near = least(own.unionByName(far))
    votes = near.groupBy("id", "record", "y").agg(F.sum("other_y").alias("votes"), F.count("*").alias("n"))
    return votes.select("id", "record", "y", "votes", F.when(2 * F.col("votes") > F.col("n"), 1).otherwise(0).alias("y_pred"), (F.col("votes") / F.col("n")).alias("y_score"))


def balanced(train: DataFrame, label: str = "y") -> DataFrame:
    """train with weight n / (2 * n of the class)."""
    n = train.groupBy(label).agg(F.count("*").alias("__n")).collect()
    total = sum(r["__n"] for r in n)
    weight = F.lit(1.0)
    for r in n:
        weight = F.when(F.col(label) == r[label], F.lit(total / (2.0 * r["__n"]))).otherwise(weight)
    return train.withColumn("weight", weight)


def scaled(train: DataFrame, test: DataFrame, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Both with column x: features less the training mean, by the training population deviation."""
    d = train.select(F.size(features)).first()[0]
    at = [F.get(features, F.lit(i)).cast("double") for i in range(d)]
    row = train.select(*[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    mean, sd = [float(v) for v in row[:d]], [float(v) or 1.0 for v in row[d:]]
    pair = F.arrays_zip(F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, sd)).alias("s"))
    x = array_to_vector(F.zip_with(F.col(features).cast("array<double>"), pair, lambda v, p: (v - p["m"]) / p["s"]))
    return train.withColumn("x", x), test.withColumn("x", x)


def logistic(train: DataFrame, test: DataFrame) -> DataFrame:
    """L2 with weight 1 / n on standardised features, classes balanced, intercept free."""
    a, b = scaled(balanced(train), test)
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=1000, standardization=False, regParam=1.0 / train.count(), elasticNetParam=0.0, tol=1e-8).fit(a)
    return model.transform(b).select("id", "record_id", "y", F.col("prediction").cast("int").alias("y_pred"), F.get(vector_to_array("probability"), F.lit(1)).alias("y_score"))


def random_forest(train: DataFrame, test: DataFrame, *, trees: int = 100, depth: int = 12, seed: int = 42) -> DataFrame:
    """Class weights are those of each tree's own bootstrap; trees don't need scaled features."""
    return forest.predict(forest.fit(train, trees=trees, depth=depth, seed=seed), test)


def kernel_machine(train: DataFrame, test: DataFrame, *, gamma: float = 0.1, width: int = 200, seed: int = 42) -> DataFrame:
    """Linear machine on random Fourier features of the Gaussian kernel, fixed by the seed; the score is the signed margin."""
    a, b = scaled(balanced(train), test)
    d = a.select(F.size("features")).first()[0]
    rng = np.random.default_rng(seed)
    w, phase = rng.normal(0, np.sqrt(2 * gamma), (d, width)), rng.uniform(0, 2 * np.pi, width)

    def mapped(df: DataFrame) -> DataFrame:
        @F.pandas_udf("array<double>")
        def of(rows: pd.Series) -> pd.Series:
            return pd.Series(list(np.sqrt(2 / width) * np.cos(matrix(rows) @ w + phase)))

        return df.withColumn("z", array_to_vector(of(vector_to_array("x"))))

    model = LinearSVC(featuresCol="z", labelCol="y", weightCol="weight", maxIter=100, regParam=1.0 / train.count()).fit(mapped(a))
    out = model.transform(mapped(b))
    return out.select("id", "record_id", "y", F.col("prediction").cast("int").alias("y_pred"), F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("y_score"))


def leave_one_record_out(points: DataFrame, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], *, record: str = "record_id", label: str = "y") -> DataFrame:
    """Predictions of every fold that has training rows of both classes. The list of records comes to the driver, rows don't."""
    p = points.persist()
    n = {r[record]: (r["n"], r["p"]) for r in p.groupBy(record).agg(F.count("*").alias("n"), F.sum(label).alias("p")).collect()}
    total, positive = sum(v[0] for v in n.values()), sum(v[1] for v in n.values())
    kept = [r for r in sorted(n) if 0 < positive - n[r][1] < total - n[r][0]]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = list(pool.map(lambda r: fit_predict(p.where(F.col(record) != r), p.where(F.col(record) == r)), kept))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def forest_regression(points: DataFrame, *, label: str = "y", features: str = "features", trees: int = 30, depth: int = 8, seed: int = 42, top: int = 10) -> DataFrame:
    """(measure, value): error and fit on a fifth of the rows, and the largest feature importances."""
    x = points.select(F.col(label).cast("double").alias("t"), array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.pmod(F.xxhash64("id"), F.lit(5)).alias("part"))
    x = x.persist()
    model = RandomForestRegressor(featuresCol="x", labelCol="t", numTrees=trees, maxDepth=depth, seed=seed).fit(x.where("part > 0"))
    held = model.transform(x.where("part = 0"))
    measure = lambda m: float(RegressionEvaluator(labelCol="t", metricName=m).evaluate(held))
    rows = [("mae", measure("mae")), ("r2", measure("r2"))]
    weights = model.featureImportances.toArray()
    rows += [(f"importance_{i}", float(weights[i])) for i in np.argsort(-weights, kind="stable")[:top]]
    return points.sparkSession.createDataFrame(rows, "measure string, value double")


BUCKETS = 1_024


def exact_medians(values: DataFrame, *, by: str = "dim", value: str = "v") -> DataFrame:
    """(by, n, median) of long rows, by refinement: no task sorts or holds a group's values.

    A pass counts the values between a group's bounds in BUCKETS equal parts, with each part's least and greatest value;
    the part that has the wanted rank gives the next bounds, until they are one value. The bounds of two ranks for each
    group are what the driver holds, so groups are to be few (the dimensions of features). A median of an even number is
    the mean of the two in the middle. Nulls don't count; a group without values has no row.
    """
    spark = values.sparkSession
    x = values.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    kind = x.schema["g"].dataType.simpleString()
    ends = x.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    rows = {(r.g, k): [rank, r.lo, r.hi] for r in ends for k, rank in enumerate(((r.n - 1) // 2, r.n // 2))}
    while open_ := [(g, k, int(rank), float(lo), float(hi)) for (g, k), (rank, lo, hi) in rows.items() if lo < hi]:
        bounds = spark.createDataFrame(open_, f"g {kind}, k int, rank long, lo double, hi double")
        inside = x.join(bounds, "g").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS), F.lit(BUCKETS - 1))
        counted = inside.groupBy("g", "k", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        below = F.sum("n").over(Window.partitionBy("g", "k").orderBy("part")) - F.col("n")
        at = counted.withColumn("below", below).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        for r in at.collect():
            rows[r.g, r.k] = [r["rank"] - r.below, r.lo, r.hi]
    out = [(r.g, r.n, (rows[r.g, 0][1] + rows[r.g, 1][1]) / 2) for r in ends]
    return spark.createDataFrame(out, f"`{by}` {kind}, n long, median double")


def association_rules(points: DataFrame, *, label: str = "y", features: str = "features") -> DataFrame:
    """(dim, threshold, support, confidence, lift) of `feature >= its median -> label 1`, for every dimension."""
    x = points.select(label, F.posexplode(features).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    median = exact_medians(x).select("dim", F.col("median").alias("threshold"))
    j = x.join(median, "dim")
    high = F.col("v") >= F.col("threshold")
    g = j.groupBy("dim", "threshold").agg(F.count("*").alias("n"), F.sum(label).alias("p"), F.count_if(high).alias("h"), F.count_if(high & (F.col(label) == 1)).alias("hp"))
    confidence = F.col("hp") / F.col("h")
    return g.select("dim", "threshold", (F.col("hp") / F.col("n")).alias("support"), confidence.alias("confidence"), F.when(F.col("p") > 0, confidence / (F.col("p") / F.col("n"))).alias("lift"))
