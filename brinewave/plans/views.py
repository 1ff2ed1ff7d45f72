"""Recordings, windows and annotations as views over the given tables, in Spark and in SQL.

sig: one row per sample; a user is a recording, an event type a channel.
ep: fixed-rate epochs of 64 samples, from the vectors; ten recordings, label 0 is the rare class.
ann: annotated intervals of six hours. pred: predictions of windows. runs: one row for each model and patient.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinewave.operators import detect

INTERVAL = 21_600.0
ERROR_VALUE = 150.0
REFRACTORY = 43_200.0
TOLERANCE = 3_600.0
SPAN = 30 * 86_400.0
PATIENTS = 12


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    t = (micros - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6
    order = Window.partitionBy("record_id").orderBy("ts", "event_id")
    s = e.select(F.col("user_id").alias("record_id"), F.col("event_type").alias("channel"), "event_id", "ts", t.alias("t_sec"), F.col("value").alias("x"))
    return s.withColumn("i", (F.row_number().over(order) - 1).cast("long"))


def ep(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(
        F.col("vec_id").alias("epoch_id"), (F.col("vec_id") % 10).alias("record_id"), (F.floor(F.col("vec_id") / 10) * 4.0).alias("start_sec"),
        F.col("embedding").cast("array<double>").alias("samples"), F.when(F.col("label") == 0, 1).otherwise(0).alias("y"), F.col("label").cast("int").alias("label"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ep with the names that the learning operators take."""
    return ep(spark, sf_dir).select(F.col("epoch_id").alias("id"), "record_id", "y", "label", F.col("samples").alias("features"))


def ann_of(s: DataFrame) -> DataFrame:
    hit = s.where((F.col("channel") == "error") & (F.col("x") > ERROR_VALUE))
    return hit.select("record_id", F.col("t_sec").alias("s0"), (F.col("t_sec") + INTERVAL).alias("s1"))


def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_of(sig(spark, sf_dir))


def pred_of(s: DataFrame) -> DataFrame:
    flag = lambda c: F.when(c, 1).otherwise(0)
    return s.select("record_id", "channel", "event_id", "t_sec", flag(F.col("x") > 100).alias("y_pred"), flag(F.col("channel") == "error").alias("y_true"), F.col("x").alias("y_score"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred_of(sig(spark, sf_dir))


def records(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("record_id").agg(F.lit(SPAN).alias("duration_sec"))


RUN = ["model", "patient", "record_id"]


def run_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, intervals) of all runs: a channel is a model, a twelfth of the recordings a patient."""
    s = sig(spark, sf_dir)
    p = s.select(
        F.col("channel").alias("model"), (F.col("record_id") % PATIENTS).alias("patient"), "record_id", "event_id", "t_sec",
        F.when(F.col("x") > 60, 1).otherwise(0).alias("y_pred"), F.when(F.pmod(F.col("event_id"), F.lit(4)) == 0, 1).otherwise(0).alias("y_true"), F.col("x").alias("y_score"),
    )
    models = p.select("model").distinct()
    a = ann_of(s).withColumn("patient", F.col("record_id") % PATIENTS).withColumn("__k", F.lit(1)).join(models.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return p, a


def run_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(record results, predictions) of all runs."""
    p, a = run_predictions(spark, sf_dir)
    r = p.groupBy(*RUN).agg(F.lit(SPAN).alias("duration_sec"))
    return detect.record_results(p, a, r, by=RUN, refractory=REFRACTORY, tol=TOLERANCE), p


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, p = run_results(spark, sf_dir)
    return detect.run_summary(results, p)


# The same views in SQL, as parts of a WITH clause.
SIG = """sig as (
  select user_id as record_id, event_type as channel, event_id, ts, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t_sec,
         value as x, row_number() over (partition by user_id order by ts, event_id) - 1 as i
  from events)"""
EP = """ep as (
  select vec_id as epoch_id, vec_id % 10 as record_id, floor(vec_id / 10) * 4.0 as start_sec, embedding::double[] as samples,
         (label = 0)::int as y, label from embeddings)"""
ANN = f"""ann as (
  select record_id, t_sec as s0, t_sec + {INTERVAL} as s1 from sig where channel = 'error' and x > {ERROR_VALUE})"""
PRED = """pred as (
  select record_id, channel, event_id, t_sec, (x > 100)::int as y_pred, (channel = 'error')::int as y_true, x as y_score from sig)"""


def edges(source: str, by: str) -> str:
    return f"""edges as (
  select * from (select *, lag(y_pred, 1, 0) over (partition by {by} order by t_sec, event_id) as before from {source}) where y_pred = 1 and before = 0)"""


def events(by: str, refractory: float = REFRACTORY) -> str:
    return f"""ev as (
  select {by}, unnest(list_reduce(list_prepend(cast([] as double[]), list_transform(ts, lambda t: [t])),
                      lambda a, t: case when len(a) = 0 or t[1] - a[len(a)] > {refractory} then list_append(a, t[1]) else a end)) as event_sec
  from (select {by}, list_sort(list(t_sec)) as ts from edges group by {by}))"""


def precision(source: str, by: str) -> str:
    comma = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    group = f"group by {by}" if by else ""
    return f"""apg as (select {comma}y_score, sum(y_true) as tp, count(*) as n from {source} group by {comma}y_score),
apr as (select *, sum(tp) over ({part}order by y_score desc rows unbounded preceding) as ctp, sum(n) over ({part}order by y_score desc rows unbounded preceding) as cn from apg),
ap as (select {comma}case when sum(tp) > 0 and sum(tp) < sum(n) then sum(tp * ctp / cn) / sum(tp) end as pr_auc from apr {group})"""


RUNP = f"""runp as (
  select channel as model, record_id % {PATIENTS} as patient, record_id, event_id, t_sec, (x > 60)::int as y_pred, (event_id % 4 = 0)::int as y_true, x as y_score from sig),
runa as (select m.model, a.record_id % {PATIENTS} as patient, a.record_id, s0, s1 from ann a, (select distinct model from runp) m)"""

RESULTS = ",\n".join([
    SIG, ANN, RUNP, edges("runp", "model, patient, record_id"), events("model, patient, record_id"), precision("runp", "model, patient, record_id"),
    f"""base as (
  select model, patient, record_id, count(*) as n_windows, sum(y_pred)::bigint as n_positive_windows,
         sum((y_true = 1 and y_pred = 1)::int) as tp, sum((y_true = 1 and y_pred = 0)::int) as fn, sum((y_true = 0 and y_pred = 1)::int) as fp
  from runp group by all),
nev as (select model, patient, record_id, count(*) as n from ev group by all),
sens as (
  select a.model, a.patient, a.record_id, max(case when event_sec >= s0 - {TOLERANCE} and event_sec <= s1 + {TOLERANCE} then 1.0 else 0.0 end)::double as sensitivity
  from runa a left join ev using (model, patient, record_id) group by all),
onset as (select model, patient, record_id, min(s0) as onset from runa group by all),
lat as (
  select model, patient, record_id, greatest(0.0, min(event_sec) filter (where event_sec >= onset - {TOLERANCE}) - onset) as latency_sec,
         min(event_sec) filter (where event_sec >= onset - {TOLERANCE}) as first_sec
  from onset left join ev using (model, patient, record_id) group by model, patient, record_id, onset),
res as (
  select b.model, b.patient, b.record_id, n_windows, n_positive_windows, coalesce(nev.n, 0)::bigint as n_events,
         case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end as f1,
         ap.pr_auc, sens.sensitivity, case when first_sec is not null then latency_sec end as latency_sec,
         case when onset.onset is null then coalesce(nev.n, 0) * 86400.0 / {SPAN} end as fdr_per_24h
  from base b left join nev using (model, patient, record_id) left join ap using (model, patient, record_id)
  left join sens using (model, patient, record_id) left join lat using (model, patient, record_id) left join onset using (model, patient, record_id))""",
])

RUNS = RESULTS + ",\n" + precision("runp", "model, patient").replace("apg", "bpg").replace("apr ", "bpr ").replace("apr)", "bpr)").replace("from apr", "from bpr").replace("ap as", "bp as") + """,
pooled as (
  select model, patient, sum((y_true = 1 and y_pred = 1)::int) as tp, sum((y_true = 1 and y_pred = 0)::int) as fn, sum((y_true = 0 and y_pred = 1)::int) as fp
  from runp group by all),
runs as (
  select r.model, r.patient, count(*) as n_records, count(sensitivity) as n_seizure_records, count(fdr_per_24h) as n_nonseizure_records,
         avg(sensitivity) as sensitivity_mean, avg(latency_sec) as latency_sec_mean, avg(fdr_per_24h) as fdr_per_24h_mean,
         any_value(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end) as epoch_sensitivity,
         any_value(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end) as f1_score, any_value(bp.pr_auc) as pr_auc
  from res r join pooled using (model, patient) join bp using (model, patient) group by r.model, r.patient)"""
