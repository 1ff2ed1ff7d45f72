"""Events from window predictions, and what they are worth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewave.config import DEFAULT
from brinewave.operators.asof import as_of
from brinewave.operators.tables import cut_lineage

DAY = 86_400.0
SCORE_RANGES = 32


def rising_edges(predictions: DataFrame, *, by: Sequence[str] = ("record_id",), order: Sequence[str] = ("t_sec", "event_id"), pred: str = "y_pred") -> DataFrame:
    """Rows where the prediction turns 1; before the first kept row it counts as 0."""
    before = F.lag(pred, 1, 0).over(Window.partitionBy(*by).orderBy(*order))
    return predictions.withColumn("__before", before).where((F.col(pred) == 1) & (F.col("__before") == 0)).drop("__before")


def greedy(times: Column, refractory: float) -> Column:
    """Of sorted times those that lie more than the refractory after the last one taken.

    What lies nearer is lost, even if its run goes on beyond; this isn't a session window, whose gap counts from the last row.
    """
    start = F.array().cast("array<double>")
    take = lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) > F.lit(float(refractory))), F.array_append(a, t)).otherwise(a)
    return F.aggregate(times, start, take)


def detect_events(predictions: DataFrame, refractory: float = DEFAULT.refractory_sec, *, by: Sequence[str] = ("record_id",), time: str = "t_sec", order: Sequence[str] = ("t_sec", "event_id")) -> DataFrame:
    """(by, event_sec): rising edges outside the refractory.

    An edge more than the refractory after the edge before it is taken whatever came earlier, so the rule starts anew
    there: only the edges between two such gaps are gathered.
    """
    edges = rising_edges(predictions, by=by, order=order)
    in_time = Window.partitionBy(*by).orderBy(F.col(time).cast("double"), *order)
    gap = F.col(time).cast("double") - F.lag(F.col(time).cast("double")).over(in_time) > float(refractory)
    edges = edges.withColumn("__gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("__run", F.sum("__gap").over(in_time))
    kept = edges.groupBy(*by, "__run").agg(F.array_sort(F.collect_list(F.col(time).cast("double"))).alias("__t"))
    return kept.select(*by, F.explode(greedy(F.col("__t"), refractory)).alias("event_sec"))


def sensitivity(intervals: DataFrame, events: DataFrame, tol: float = DEFAULT.tolerance_sec, *, by: Sequence[str] = ("record_id",)) -> DataFrame:
    """(by, sensitivity) of recordings with intervals: 1 if any event lies in any interval, tolerance included, else 0."""
    j = intervals.join(events, list(by), "left")
    hit = (F.col("event_sec") >= F.col("s0") - tol) & (F.col("event_sec") <= F.col("s1") + tol)
    return j.groupBy(*by).agg(F.max(F.when(hit, 1.0).otherwise(0.0)).alias("sensitivity"))


def interval_hits(intervals: DataFrame, events: DataFrame, tol: float = DEFAULT.tolerance_sec, *, by: Sequence[str] = ("record_id",)) -> DataFrame:
    """Intervals with hit: whether any event lies in that one interval."""
    j = intervals.join(events, list(by), "left")
    hit = (F.col("event_sec") >= F.col("s0") - tol) & (F.col("event_sec") <= F.col("s1") + tol)
    return j.groupBy(*by, "s0", "s1").agg(F.max(F.when(hit, 1).otherwise(0)).alias("hit"))


def latency(intervals: DataFrame, events: DataFrame, tol: float = DEFAULT.tolerance_sec, *, by: Sequence[str] = ("record_id",)) -> DataFrame:
    """(by, latency_sec): from the earliest onset to the first event not before onset - tol, however late; 0 at least, null without such an event."""
    onset = intervals.groupBy(*by).agg(F.min("s0").alias("__onset"))
    j = onset.join(events, list(by), "left")
    first = F.min(F.when(F.col("event_sec") >= F.col("__onset") - tol, F.col("event_sec")))
    out = j.groupBy(*by, "__onset").agg(first.alias("__first"))
    return out.select(*by, F.when(F.col("__first").isNotNull(), F.greatest(F.lit(0.0), F.col("__first") - F.col("__onset"))).alias("latency_sec"))


def onset_latencies(intervals: DataFrame, events: DataFrame, tol: float = DEFAULT.tolerance_sec, *, by: Sequence[str] = ("record_id",)) -> DataFrame:
    """(by, s0, s1, latency_sec): of every interval, from its onset to the first event not before onset - tol; 0 at least, null without such an event."""
    at = intervals.select(*by, "s0", "s1", (F.col("s0") - tol).alias("__from"))
    found = as_of(at, events.select(*by, "event_sec"), by=by, left_time="__from", right_time="event_sec", values=["event_sec"], forward=True)
    return found.select(*by, "s0", "s1", F.when(F.col("event_sec").isNotNull(), F.greatest(F.lit(0.0), F.col("event_sec") - F.col("s0"))).alias("latency_sec"))


def false_detections(records: DataFrame, intervals: DataFrame, events: DataFrame, *, by: Sequence[str] = ("record_id",), duration: str = "duration_sec") -> DataFrame:
    """(by, n_events, fdr_per_24h) of recordings without intervals; every event counts, a duration of 0 gives 0."""
    quiet = records.join(intervals.select(*by).distinct(), list(by), "left_anti")
    n = events.groupBy(*by).agg(F.count("*").alias("__n"))
    out = quiet.join(n, list(by), "left").withColumn("n_events", F.coalesce("__n", F.lit(0)).cast("long"))
    fdr = F.when(F.col(duration) > 0, F.col("n_events") * DAY / F.col(duration)).otherwise(F.lit(0.0))
    return out.select(*by, "n_events", fdr.alias("fdr_per_24h"))


def confusion(predictions: DataFrame, *, by: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(by, actual, predicted, n): all four cells, also those without rows."""
    cell = lambda a, p: F.count_if((F.col(true) == a) & (F.col(pred) == p))
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), cell(a, p).alias("n")) for a in (0, 1) for p in (0, 1)]
    out = predictions.groupBy(*by).agg(F.array(*cells).alias("c")) if by else predictions.agg(F.array(*cells).alias("c"))
    return out.select(*by, F.explode("c").alias("c")).select(*by, "c.actual", "c.predicted", "c.n")


def recall_f1(predictions: DataFrame, *, by: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(by, recall, f1); 0 where the divisor is 0."""
    tp, fn, fp = (F.count_if((F.col(true) == a) & (F.col(pred) == p)) for a, p in ((1, 1), (1, 0), (0, 1)))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = [share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1")]
    return predictions.groupBy(*by).agg(*out) if by else predictions.agg(*out)


def average_precision(predictions: DataFrame, *, by: Sequence[str], true: str = "y_true", score: str = "y_score") -> DataFrame:
    """(by, pr_auc): sum of precision times the step in recall over distinct scores, falling; null with one class only.

    Rows are summed per score first, so the running sums go over distinct scores. A group's scores are cut into
    SCORE_RANGES at quantiles: the sums of the ranges above are added to the running sums within a range, so a group
    that holds all rows is still summed by many tasks. Where the cuts lie doesn't change the result.
    """
    keys = list(by)
    g = predictions.groupBy(*by, score).agg(F.sum(true).alias("tp"), F.count("*").alias("n"))
    cuts = predictions.groupBy(*by).agg(F.percentile_approx(score, [k / SCORE_RANGES for k in range(1, SCORE_RANGES)], 1000).alias("__cuts"))
    g = g.join(cuts, keys).withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c >= F.col(score))), F.lit(0))).drop("__cuts")
    g = g.withColumn("__range", F.when(F.col(score).isNull(), SCORE_RANGES).otherwise(F.col("__range")))  # without a score: last
    above = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    sums = g.groupBy(*by, "__range").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n")).select(*by, "__range", total("tp").alias("__tp"), total("n").alias("__n"))
    run = Window.partitionBy(*by, "__range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    g = g.join(sums, [*by, "__range"]).withColumns({"ctp": F.sum("tp").over(run) + F.col("__tp"), "cn": F.sum("n").over(run) + F.col("__n")})
    out = g.groupBy(*by).agg(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("s"), F.sum("tp").alias("p"), F.sum("n").alias("n"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("s") / F.col("p")).alias("pr_auc"))


def record_results(predictions: DataFrame, intervals: DataFrame, records: DataFrame, *, by: Sequence[str] = ("record_id",), refractory: float = DEFAULT.refractory_sec, tol: float = DEFAULT.tolerance_sec) -> DataFrame:
    """One row per recording: counts, window metrics, and either sensitivity and latency or false detections per day.

    Events and precisions are written first: all parts have the same keys, so one task would else hold the sorts of all at a time.
    """
    keys = list(by)
    events = cut_lineage(detect_events(predictions, refractory, by=by), "events")
    precision = cut_lineage(average_precision(predictions, by=by), "precision")
    base = predictions.groupBy(*by).agg(F.count("*").alias("n_windows"), F.sum("y_pred").alias("n_positive_windows"))
    n = events.groupBy(*by).agg(F.count("*").alias("n_events"))
    out = base.join(n, keys, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))
    out = out.join(recall_f1(predictions, by=by), keys).join(precision, keys)
    seen = intervals.join(predictions.select(*by).distinct(), keys, "left_semi")
    out = out.join(sensitivity(seen, events, tol, by=by), keys, "left").join(latency(seen, events, tol, by=by), keys, "left")
    return out.join(false_detections(records, intervals, events, by=by).select(*by, "fdr_per_24h"), keys, "left")


def run_summary(results: DataFrame, predictions: DataFrame, *, by: Sequence[str] = ("model", "patient")) -> DataFrame:
    """One row per run: means over recordings of event metrics, window metrics over all windows together."""
    keys = list(by)
    macro = results.groupBy(*by).agg(
        F.count("*").alias("n_records"),
        F.count_if(F.col("sensitivity").isNotNull()).alias("n_seizure_records"),
        F.count_if(F.col("fdr_per_24h").isNotNull()).alias("n_nonseizure_records"),
        F.avg("sensitivity").alias("sensitivity_mean"),
        F.avg("latency_sec").alias("latency_sec_mean"),
        F.avg("fdr_per_24h").alias("fdr_per_24h_mean"),
    )
    micro = recall_f1(predictions, by=by).withColumnsRenamed({"recall": "epoch_sensitivity", "f1": "f1_score"})
    return macro.join(micro, keys).join(average_precision(predictions, by=by), keys)


def ranking(runs: DataFrame, *, by: Sequence[str] = ("patient",), name: str = "model") -> DataFrame:
    """runs with rank: sensitivity falling (null last), false detections and latency rising (null last), then name.

    Means are compared to nine digits, since the order of a sum may change the last ones.
    """
    inf = F.lit(float("inf"))
    near = lambda c, none: F.coalesce(F.round(c, 9), none)
    keys = (near("sensitivity_mean", F.lit(-1.0)).desc(), near("fdr_per_24h_mean", inf), near("latency_sec_mean", inf), F.col(name))
    kept = runs.where("n_records > 0")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)).cast("long"))


def rollup(runs: DataFrame, *, name: str = "model") -> DataFrame:
    """Per model: runs with recordings and means of what is known."""
    return runs.where("n_records > 0").groupBy(name).agg(
        F.count("*").alias("patients_evaluated"), F.avg("sensitivity_mean").alias("mean_sensitivity"), F.avg("fdr_per_24h_mean").alias("mean_fdr_per_24h"), F.avg("latency_sec_mean").alias("mean_latency_sec")
    )


def missing_runs(patients: DataFrame, models: Sequence[str], done: DataFrame) -> DataFrame:
    """(patient, model) still to run: each patient with the given models, less what is done."""
    wanted = patients.select("patient").distinct().withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return wanted.join(done, ["patient", "model"], "left_anti")


def status_summary(steps: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    agg = [F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") != "success").alias("n_failed"), F.sum("runtime_sec").alias("total_runtime_sec")]
    return steps.groupBy(*by).agg(*agg) if by else steps.agg(*agg)
