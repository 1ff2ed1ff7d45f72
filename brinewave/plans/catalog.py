"""The registered queries: each applies operators to the given tables; SQL beside each query that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinewave import pipeline
from brinewave import sql as brinewave_sql
from brinewave.config import Config
from brinewave.operators import channels, cluster, components, detect, features, models, reduce, segment, signal, stretches
from brinewave.operators.asof import as_of
from brinewave.operators.tables import cut_lineage, shared_folder
from brinewave.plans import views as V
from brinewave.sources import annotations, npy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def join_names(c: str) -> Column:
    return F.array_join(c, ",")


TARGETS = ("ERROR", "CLICK", "VIEW", "PURCHASE", "LOGIN", "SIGNUP")
PATTERNS = ("ERR", "SIGN")
N_EPOCH = 16
TAPS = signal.windowed_sinc(9, 2.0, 20.0, 64.0)
EDGES = features.band_edges(8, 1.0, 25.0)
WIDTH, STEP, MARGIN = 21_600.0, 14_400.0, 10_800.0
STACKED = Config(stack=3, overlap=0.5)
EPS, LEAST = 1.2, 4


def sql_values(names: tuple[str, ...]) -> str:
    return ", ".join(f"('{n}', {k})" for k, n in enumerate(names))


# --- channels


@query("""select upper(replace(event_type, ' ', '')) as channel, count(*) as n from events
where not contains(upper(event_type), 'ERR') and not contains(upper(event_type), 'SIGN') group by 1""")
def q01_channel_filter(spark, sf_dir):
    kept = channels.exclude_auxiliary(V.sig(spark, sf_dir), PATTERNS)
    return kept.groupBy(channels.normalised(F.col("channel")).alias("channel")).agg(F.count("*").alias("n"))


@query(f"""with {V.SIG}, t(name, pos) as (values {sql_values(TARGETS)}), r as (select distinct record_id from sig),
g as (select r.record_id, t.name, t.pos, exists(select 1 from sig s where s.record_id = r.record_id and upper(replace(s.channel, ' ', '')) = t.name and s.x > 60) as hit from r, t
      where r.record_id in (select record_id from sig where x > 60))
select record_id, count(*) filter (where hit) as retained_n, count(*) filter (where not hit) as missing_n,
       coalesce(string_agg(name, ',' order by pos) filter (where hit), '') as retained, coalesce(string_agg(name, ',' order by pos) filter (where not hit), '') as missing
from g group by record_id""")
def q02_montage_select(spark, sf_dir):
    m = channels.select_montage(V.sig(spark, sf_dir).where("x > 60"), TARGETS)
    n = {c: F.col(c).cast("long") for c in ("retained_n", "missing_n")}
    return m.withColumns(n | {c: join_names(c) for c in ("retained", "missing")})


@query(f"""with {V.SIG} select record_id, count(distinct channel) as n_channels, case when count(distinct channel) < 4 then 'rejected' else 'ok' end as status
from sig where x > 100 group by record_id""")
def q03_quorum(spark, sf_dir):
    return channels.quorum(V.sig(spark, sf_dir).where("x > 100"), 4)


# --- signal


@query(f"""with {V.SIG}, s as (select record_id, channel, avg(x) as m, stddev_pop(x) as sd from sig group by all)
select event_id, record_id, channel, round((x - m) / (case when sd < 1e-12 then 1e-12 else sd end), 6) as z from sig join s using (record_id, channel)""")
def q04_zscore(spark, sf_dir):
    return signal.zscore(V.sig(spark, sf_dir)).select("event_id", "record_id", "channel", r("z").alias("z"))


@query(f"with {V.SIG} select record_id, channel, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, count(x) as n from sig group by all")
def q05_channel_stats(spark, sf_dir):
    return rounded(signal.channel_stats(V.sig(spark, sf_dir)), "mean", "std")


@query(f"""with {V.SIG} select event_id, record_id, i, round({" + ".join(
    f"{tap!r} * coalesce({f'lag(x, {4 - k}) over w' if k < 4 else f'lead(x, {k - 4}) over w' if k > 4 else 'x'}, 0.0)" for k, tap in enumerate(TAPS))}, 6) as y
from sig window w as (partition by record_id order by i)""")
def q06_fir_short(spark, sf_dir):
    return signal.fir(V.sig(spark, sf_dir), TAPS).select("event_id", "record_id", "i", r("y").alias("y"))


# --- segments and labels

EPOCHS_SQL = f"""{V.SIG}, e as (select record_id, i // {N_EPOCH} as epoch_id, count(*) as n, min(t_sec) as start_sec, max(t_sec) as last_sec from sig group by 1, 2 having count(*) = {N_EPOCH})"""


@query(f"with {EPOCHS_SQL} select record_id, epoch_id, n, round(start_sec, 6) as start_sec, round(last_sec, 6) as last_sec from e")
def q07_epochs(spark, sf_dir):
    return rounded(segment.epochs(V.sig(spark, sf_dir), N_EPOCH), "start_sec", "last_sec")


@query(f"""with {EPOCHS_SQL}, m as (select record_id, max(epoch_id) + 1 as n from e group by 1 having max(epoch_id) + 1 >= 3),
w as (select record_id, unnest(generate_series(0, n - 3, 2)) as first_epoch from m)
select record_id, (first_epoch // 2)::bigint as window_id, first_epoch, first_epoch + 2 as last_epoch from w""")
def q08_stack_windows(spark, sf_dir):
    return segment.stacks(segment.epochs(V.sig(spark, sf_dir), N_EPOCH), STACKED)


@query(f"""with {V.SIG}, b as (select record_id, min(ts) as first, max(ts) as last from sig group by 1),
k as (select record_id, (epoch_us(ts) // 14400000000 - d) * 14400000000 as w from sig, (values (0), (1)) v(d) where epoch_us(ts) < (epoch_us(ts) // 14400000000 - d) * 14400000000 + 21600000000),
g as (select record_id, w, count(*) as n from k group by all)
select record_id, w // 1000000 as w_start_sec, n from g join b using (record_id) where make_timestamp(w) >= first and make_timestamp(w + 21600000000) <= last""")
def q09_time_hop(spark, sf_dir):
    w = segment.complete_time_windows(V.sig(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "4 hours")
    return w.select("record_id", F.unix_seconds("w_start").alias("w_start_sec"), "n")


WINDOWS_SQL = f"""{V.SIG}, {V.ANN}, l as (select record_id, max(t_sec) as last from sig group by 1 having max(t_sec) >= {WIDTH}),
w as (select record_id, window_id, window_id * {STEP} as t0, window_id * {STEP} + {WIDTH} as t1
      from (select record_id, unnest(generate_series(0::bigint, floor((last - {WIDTH}) / {STEP})::bigint)) as window_id from l)),
o as (select w.record_id, window_id, t0, t1,
             max(case when s0 is null then 0.0 else greatest(0.0, least(t1, s1) - greatest(t0, s0)) end) as max_overlap,
             min(case when s0 is null then 'infinity'::double when t1 <= s0 then s0 - t1 when t0 >= s1 then t0 - s1 else 'infinity'::double end) as min_gap
      from w left join ann a on a.record_id = w.record_id group by 1, 2, 3, 4),
lab as (select *, case when max_overlap / (t1 - t0) >= 0.5 then 1 when max_overlap = 0 and min_gap >= {MARGIN} then 0 else -1 end as label from o)"""


def _windows(spark, sf_dir):
    s = V.sig(spark, sf_dir)
    return segment.hops(s, WIDTH, STEP), V.ann_of(s)


def _labelled(spark, sf_dir):
    return segment.label_windows(*_windows(spark, sf_dir), margin=MARGIN)


@query(f"""with {WINDOWS_SQL} select record_id, window_id, round(max_overlap, 6) as max_overlap, case when not isinf(min_gap) then round(min_gap, 6) end as min_gap from o""")
def q10_interval_join(spark, sf_dir):
    o = segment.interval_overlap(*_windows(spark, sf_dir))
    gap = F.when(F.col("min_gap") < float("inf"), r("min_gap"))
    return o.select("record_id", "window_id", r("max_overlap").alias("max_overlap"), gap.alias("min_gap"))


@query(f"""with {WINDOWS_SQL} select record_id, count(*) filter (where label = 1) as n_ictal, count(*) filter (where label = 0) as n_interictal,
count(*) filter (where label = -1) as n_unknown from lab group by 1""")
def q11_label_windows(spark, sf_dir):
    n = lambda v, name: F.count_if(F.col("label") == v).alias(name)
    return _labelled(spark, sf_dir).groupBy("record_id").agg(n(1, "n_ictal"), n(0, "n_interictal"), n(-1, "n_unknown"))


@query(f"""with {WINDOWS_SQL} select record_id % 12 as patient, record_id, count(*) as n_windows, count(*) filter (where label = 1) as n_ictal
from lab where label <> -1 group by rollup (1, 2)""")
def q12_drop_unknown(spark, sf_dir):
    k = segment.known(_labelled(spark, sf_dir)).withColumn("patient", F.col("record_id") % 12)
    return k.rollup("patient", "record_id").agg(F.count("*").alias("n_windows"), F.count_if(F.col("label") == 1).alias("n_ictal"))


# --- features

BINS = features.band_bins(64, 64.0, EDGES)
ENERGY_SQL = f"""{V.EP}, bins(band, k) as (values {", ".join(f"({b}, {k})" for b, ks in enumerate(BINS) for k in ks)}),
en as (select epoch_id, record_id, y, band, sum(re * re + im * im) as energy from (
  select epoch_id, record_id, y, band, k,
         list_sum(list_transform(range(64), lambda j: samples[j + 1] * cos(2 * pi() * k / 64 * j))) as re,
         list_sum(list_transform(range(64), lambda j: samples[j + 1] * sin(2 * pi() * k / 64 * j))) as im
  from ep, bins) group by all)"""
MOMENTS_SQL = f"""{V.EP}, m as (select epoch_id, record_id, samples, list_avg(samples) as mean from ep),
st as (select epoch_id, record_id, mean, samples, list_avg(list_transform(samples, lambda v: (v - mean) ** 2)) as m2, list_avg(list_transform(samples, lambda v: (v - mean) ** 3)) as m3,
              list_avg(list_transform(samples, lambda v: (v - mean) ** 4)) as m4 from m),
stats as (select epoch_id, mean, sqrt(m2) as std, case when m2 > 0 then m3 / m2 ** 1.5 end as skew, case when m2 > 0 then m4 / (m2 * m2) - 3 end as kurtosis,
                 sqrt(list_avg(list_transform(samples, lambda v: v * v))) as rms, list_max(samples) - list_min(samples) as ptp from st)"""
HJORTH_SQL = """d as (select epoch_id, samples as x, list_transform(range(1, 64), lambda j: samples[j + 1] - samples[j]) as d1, list_transform(range(1, 63), lambda j: samples[j + 2] - 2 * samples[j + 1] + samples[j]) as d2 from ep),
v as (select epoch_id, list_var_pop(x) as v0, list_var_pop(d1) as v1, list_var_pop(d2) as v2 from d),
hj as (select epoch_id, case when v0 > 0 then sqrt(v1 / v0) else 0.0 end as mobility, case when v1 > 0 then sqrt(v2 / v1) else 0.0 end as complexity from v)"""


@query(f"with {ENERGY_SQL} select epoch_id, band, round(energy, 6) as energy from en")
def q13_band_energy(spark, sf_dir):
    return rounded(features.band_energy(V.ep(spark, sf_dir), 64, 64.0, EDGES, keys=["epoch_id"]), "energy")


@query(f"with {MOMENTS_SQL} select epoch_id, {', '.join(f'round({n}, 6) as {n}' for n in features.STATS)} from stats")
def q14_basic_stats(spark, sf_dir):
    return rounded(features.basic_stats(V.ep(spark, sf_dir), keys=["epoch_id"]), *features.STATS)


@query(f"with {V.EP}, {HJORTH_SQL} select epoch_id, round(mobility, 6) as mobility, round(complexity, 6) as complexity from hj")
def q15_hjorth(spark, sf_dir):
    return rounded(features.hjorth(V.ep(spark, sf_dir), keys=["epoch_id"]), "mobility", "complexity")


@query(f"""with {ENERGY_SQL}, {MOMENTS_SQL.removeprefix(V.EP + ", ")}, {HJORTH_SQL},
long as (select 'spectral' as feature_set, energy as value from en
  union all select 'stats', unnest([mean, std, skew, kurtosis, rms, ptp]) from stats union all select 'hjorth', unnest([mobility, complexity]) from hj)
select feature_set, count(*) as n, round(sum(value), 4) as total from long group by 1""")
def q16_feature_concat(spark, sf_dir):
    f = features.extract(V.ep(spark, sf_dir), ("spectral", "stats", "hjorth"), n=64, rate=64.0, edges=EDGES, keys=["epoch_id"])
    return f.groupBy("feature_set").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query(f"""with {V.SIG}, w as (select record_id, record_id % 12 as patient, 408 + 24 * (count(*) % 2) as width from sig group by 1),
g as (select patient, width, count(*) as n, min(record_id) as first from w group by 1, 2),
b as (select * from (select *, row_number() over (partition by patient order by n desc, first) as k from g) where k = 1)
select b.patient, b.width, b.n, coalesce(string_agg(w.record_id::varchar, ',' order by w.record_id) filter (where w.width <> b.width), '') as dropped
from b join w on w.patient = b.patient group by all""")
def q17_feature_width_majority(spark, sf_dir):
    w = V.sig(spark, sf_dir).groupBy("record_id").agg((408 + 24 * (F.count("*") % 2)).alias("width")).withColumn("patient", F.col("record_id") % 12)
    best = features.majority_width(w)
    _, gone = features.drop_minority(w)
    gone = gone.groupBy("patient").agg(F.array_join(F.array_sort(F.collect_list("record_id")).cast("array<string>"), ",").alias("dropped"))
    return best.join(gone, "patient", "left").withColumn("dropped", F.coalesce("dropped", F.lit("")))


def _shift_sql(band: str) -> str:
    return f"""with {V.EP}, x as (select y, {band} as band, samples[j + 1] as v from ep, range(64) t(j)),
g as (select band, coalesce(avg(v) filter (where y = 1), 0.0) as a, coalesce(avg(v) filter (where y = 0), 0.0) as b from x group by 1)
select band::int as band, round(a, 6) as ictal_mean, round(b, 6) as interictal_mean, round(a - b, 6) as delta from g"""


@query(_shift_sql("j // 8"))
def q18_band_shift(spark, sf_dir):
    return rounded(reduce.band_shift(V.points(spark, sf_dir), 8, 8), "ictal_mean", "interictal_mean", "delta")


@query(_shift_sql("j % 8"))
def q19_band_shift_compat(spark, sf_dir):
    return rounded(reduce.band_shift(V.points(spark, sf_dir), 8, 8, layout="reference"), "ictal_mean", "interictal_mean", "delta")


def _aligned(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("record_id", "channel").orderBy("i"))
    return V.sig(spark, sf_dir).withColumn("k", k)


@query(f"""with {V.SIG}, a as (select *, row_number() over (partition by record_id, channel order by i) as k from sig)
select p.channel as channel_a, q.channel as channel_b, round(covar_samp(p.x, q.x), 4) as cov, count(*) as n
from a p join a q on p.record_id = q.record_id and p.k = q.k and p.channel <= q.channel group by 1, 2""")
def q20_channel_cov(spark, sf_dir):
    return rounded(reduce.channel_covariance(_aligned(spark, sf_dir)), "cov", digits=4)


@query()
def q21_cov_eig(spark, sf_dir):
    names, values, _ = reduce.covariance_eigen(reduce.channel_covariance(_aligned(spark, sf_dir)))
    return spark.createDataFrame([(k, float(v), len(names)) for k, v in enumerate(values)], "component int, eigenvalue double, channels int")


@query()
def q22_pca(spark, sf_dir):
    out, share = reduce.pca(V.points(spark, sf_dir), 2)
    return out.select("id", "y", r("pc1").alias("pc1"), r("pc2").alias("pc2"), F.lit(round(share[0], 6)).alias("share1"), F.lit(round(share[1], 6)).alias("share2"))


@query(f"""with {V.EP}, n as (select y, count(*) as n from ep group by 1),
s as (select a.epoch_id, a.y, b.y as other, sum(list_distance(a.samples, b.samples)) as total from ep a, ep b group by all),
g as (select epoch_id, s.y, max(case when s.y = other and n > 1 then total / (n - 1) end) as a, min(case when s.y <> other then total / n end) as b
      from s join n on n.y = other group by 1, 2)
select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette, count(*) as n from g""")
def q23_silhouette_exact(spark, sf_dir):
    return rounded(reduce.silhouette_score(V.points(spark, sf_dir), label="y"), "silhouette")


CENTROID_SQL = f"""{V.EP}, c as (select label, j, avg(samples[j + 1]) as m from ep, range(64) t(j) group by all),
cc as (select label, list(m order by j) as m from c group by 1),
nc as (select epoch_id, label, (select cc.label from cc order by list_sum(list_transform(range(1, 65), lambda i: (samples[i] - cc.m[i]) ** 2)), cc.label limit 1) as pred from ep)"""


@query(f"""with {CENTROID_SQL}, g as (select label, pred, count(*) as n from nc group by all),
a as (select sum(n * (n - 1) / 2) as s from (select sum(n) as n from g group by label)), b as (select sum(n * (n - 1) / 2) as s from (select sum(n) as n from g group by pred)),
t as (select sum(n * (n - 1) / 2) as s, sum(n) as n from g)
select round((t.s - a.s * b.s / (t.n * (t.n - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (t.n * (t.n - 1) / 2)), 6) as ari, t.n::bigint as n from a, b, t""")
def q24_ari(spark, sf_dir):
    near = models.nearest_centroid(V.points(spark, sf_dir), label="label", leave_out=False)
    return rounded(cluster.adjusted_rand(near, "label", "pred"), "ari")


KNN_SQL = f"""{V.EP}, dd as (
  select a.epoch_id as id, a.record_id as record, a.y, b.y as other_y, row_number() over (partition by a.epoch_id order by sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.samples[i] - b.samples[i]) ** 2))), b.epoch_id) as k
  from ep a join ep b on a.record_id <> b.record_id),
knn as (select id, record, y, sum(other_y)::bigint as votes, count(*) as n from dd where k <= 5 group by all)"""


@query(f"with {KNN_SQL} select id, record, y::bigint as y, votes, (2 * votes > n)::int as y_pred, round(votes / n, 6) as y_score from knn")
def q25_knn(spark, sf_dir):
    return rounded(models.knn(V.points(spark, sf_dir)), "y_score")


@query(f"""with {V.EP}, x as (select record_id, j as dim, count(*) as n, sum(samples[j + 1]) as s, sum(samples[j + 1] ** 2) as q from ep, range(64) t(j) group by all),
g as (select record_id, dim, sum(n) over w - n as n, sum(s) over w - s as s, sum(q) over w - q as q from x window w as (partition by dim))
select record_id, dim::int as dim, round(s / n, 6) as mean, round(case when q / n - (s / n) ** 2 > 0 then sqrt(q / n - (s / n) ** 2) else 1.0 end, 6) as std from g where n > 0""")
def q26_fold_scaler(spark, sf_dir):
    return rounded(models.fold_scaler(V.points(spark, sf_dir)), "mean", "std")


@query(f"""with {V.EP}, f as (select distinct record_id as fold from ep), c as (
  select fold, y, j, avg(samples[j + 1]) as m from f, ep, range(64) t(j) where record_id <> fold group by all), cc as (select fold, y, list(m order by j) as m from c group by 1, 2),
p as (select epoch_id, record_id, y, (select cc.y from cc where fold = record_id order by list_sum(list_transform(range(1, 65), lambda i: (samples[i] - cc.m[i]) ** 2)), cc.y limit 1) as pred from ep)
select record_id, count(*) as n, sum((y = pred)::int)::bigint as n_right, sum(pred)::bigint as n_positive from p group by 1""")
def q27_lro_centroid(spark, sf_dir):
    near = models.nearest_centroid(V.points(spark, sf_dir))
    return near.groupBy("record_id").agg(F.count("*").alias("n"), F.count_if(F.col("y") == F.col("pred")).alias("n_right"), F.sum("pred").alias("n_positive"))


@query(f"""with {V.SIG}, {V.PRED}, o as (select record_id % 12 as patient, record_id, count(*) as n, sum((y_true = 1 and y_score > 200)::int) as p from pred group by 1, 2),
g as (select patient, record_id, (sum(n) over w - n)::bigint as n_train, (sum(p) over w - p)::bigint as n_train_positive from o window w as (partition by patient))
select *, case when n_train > 0 and n_train_positive > 0 and n_train_positive < n_train then 'kept' else 'skipped' end as status from g""")
def q28_fold_guard(spark, sf_dir):
    p = V.pred(spark, sf_dir).withColumn("patient", F.col("record_id") % 12)
    return models.fold_guard(p.withColumn("y_true", F.when(F.col("y_score") > 200, F.col("y_true")).otherwise(0)))


def _scores(predictions: DataFrame) -> DataFrame:
    """Window metrics of predictions, all folds together."""
    p = predictions.withColumnRenamed("y", "y_true").withColumn("k", F.lit(0))
    return detect.recall_f1(p, by=["k"]).join(detect.average_precision(p, by=["k"]), "k").join(p.groupBy("k").agg(F.count("*").alias("n")), "k").drop("k")


@query()
def q29_logreg(spark, sf_dir):
    return _scores(models.leave_one_record_out(V.points(spark, sf_dir), models.logistic))


@query()
def q30_random_forest(spark, sf_dir):
    return _scores(models.leave_one_record_out(V.points(spark, sf_dir), models.random_forest))


@query()
def q31_svm_rff(spark, sf_dir):
    return _scores(models.leave_one_record_out(V.points(spark, sf_dir), models.kernel_machine))


# --- clusters


@query()
def q32_kmeans(spark, sf_dir):
    return cluster.cluster_profile(cluster.kmeans(V.points(spark, sf_dir)))


@query()
def q33_ward(spark, sf_dir):
    p = V.points(spark, sf_dir)
    return cluster.cluster_profile(cluster.ward(p).join(p.select("id", "y"), "id"))


@query(f"""with recursive {V.EP}, near as (
  select a.epoch_id as a, b.epoch_id as b from ep a, ep b where sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.samples[i] - b.samples[i]) ** 2))) <= {EPS}),
core as (select a as id from near group by 1 having count(*) >= {LEAST}), ce as (select a, b from near where a in (select id from core) and b in (select id from core)),
reach(id, c) as (select id, id from core union select ce.b, reach.c from reach join ce on ce.a = reach.id where reach.c < ce.b),
lab as (select id, min(c) as c from reach group by 1),
bord as (select near.a as id, min(lab.c) as c from near join lab on lab.id = near.b group by 1),
fin as (select ep.epoch_id, coalesce(lab.c, bord.c, -1) as cluster from ep left join lab on lab.id = ep.epoch_id left join bord on bord.id = ep.epoch_id)
select cluster, count(*) as n from fin group by 1""")
def q34_dbscan(spark, sf_dir):
    p = V.points(spark, sf_dir)
    return cluster.dbscan(p, EPS, LEAST).groupBy("cluster").agg(F.count("*").alias("n"))


# --- events and metrics

EDGES_SQL = f"{V.SIG}, {V.ANN}, {V.PRED}, {V.edges('pred', 'record_id')}"
EVENTS_SQL = f"{EDGES_SQL}, {V.events('record_id')}"


@query(f"with {EDGES_SQL} select record_id, event_id, round(t_sec, 6) as t_sec from edges")
def q35_rising_edges(spark, sf_dir):
    return detect.rising_edges(V.pred(spark, sf_dir)).select("record_id", "event_id", r("t_sec").alias("t_sec"))


@query(f"with {EVENTS_SQL} select record_id, round(event_sec, 6) as event_sec from ev")
def q36_detect_events(spark, sf_dir):
    return rounded(detect.detect_events(V.pred(spark, sf_dir), V.REFRACTORY), "event_sec")


def _events(spark, sf_dir):
    s = V.sig(spark, sf_dir)
    p = V.pred_of(s)
    return p, V.ann_of(s), detect.detect_events(p, V.REFRACTORY)


@query(f"""with {EVENTS_SQL} select a.record_id, max(case when event_sec >= s0 - {V.TOLERANCE} and event_sec <= s1 + {V.TOLERANCE} then 1.0 else 0.0 end)::double as sensitivity
from ann a left join ev using (record_id) group by 1""")
def q37_sensitivity(spark, sf_dir):
    _, a, e = _events(spark, sf_dir)
    return detect.sensitivity(a, e, V.TOLERANCE)


@query(f"""with {EVENTS_SQL}, o as (select record_id, min(s0) as onset from ann group by 1),
f as (select record_id, onset, min(event_sec) filter (where event_sec >= onset - {V.TOLERANCE}) as first from o left join ev using (record_id) group by 1, 2)
select record_id, case when first is not null then round(greatest(0.0, first - onset), 6) end as latency_sec from f""")
def q38_latency(spark, sf_dir):
    _, a, e = _events(spark, sf_dir)
    return rounded(detect.latency(a, e, V.TOLERANCE), "latency_sec")


@query(f"""with {EVENTS_SQL}, q as (select distinct record_id from pred where record_id not in (select record_id from ann))
select record_id, count(event_sec) as n_events, round(count(event_sec) * 86400.0 / {V.SPAN}, 6) as fdr_per_24h from q left join ev using (record_id) group by 1""")
def q39_fdr(spark, sf_dir):
    p, a, e = _events(spark, sf_dir)
    return rounded(detect.false_detections(V.records(p), a, e), "fdr_per_24h")


@query(f"""with {V.SIG}, {V.PRED} select a as actual, p as predicted, count(pred.event_id) as n
from (values (0), (1)) x(a) cross join (values (0), (1)) z(p) left join pred on y_true = a and y_pred = p group by 1, 2""")
def q40_confusion(spark, sf_dir):
    return detect.confusion(V.pred(spark, sf_dir))


@query(f"""with {V.SIG}, {V.PRED}, g as (
  select record_id, sum((y_true = 1 and y_pred = 1)::int) as tp, sum((y_true = 1 and y_pred = 0)::int) as fn, sum((y_true = 0 and y_pred = 1)::int) as fp from pred group by rollup (record_id))
select coalesce(record_id, -1) as record_id, round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end, 6) as f1 from g""")
def q41_recall_f1(spark, sf_dir):
    p = V.pred(spark, sf_dir)
    both = detect.recall_f1(p, by=["record_id"]).unionByName(detect.recall_f1(p).withColumn("record_id", F.lit(-1).cast("long")))
    return rounded(both, "recall", "f1")


@query(f"""with {V.SIG}, {V.PRED}, {V.precision('pred', 'record_id')}, {V.precision('pred', '').replace('apg', 'bpg').replace('apr ', 'bpr ').replace('from apr', 'from bpr').replace('ap as', 'bp as')}
select record_id, round(pr_auc, 6) as pr_auc from ap union all select -1, round(pr_auc, 6) from bp""")
def q42_average_precision(spark, sf_dir):
    p = V.pred(spark, sf_dir)
    one = detect.average_precision(p, by=["record_id"])
    pooled = detect.average_precision(p.withColumn("record_id", F.lit(-1).cast("long")), by=["record_id"])
    return rounded(one.unionByName(pooled), "pr_auc")


RUN_VALUES = ("sensitivity_mean", "latency_sec_mean", "fdr_per_24h_mean", "epoch_sensitivity", "f1_score", "pr_auc")


@query(f"with {V.RUNS} select model, patient, n_records, n_seizure_records, n_nonseizure_records, {', '.join(f'round({c}, 6) as {c}' for c in RUN_VALUES)} from runs")
def q43_run_summary(spark, sf_dir):
    return rounded(V.runs(spark, sf_dir), *RUN_VALUES)


RANK_SQL = f"""{V.RUNS}, ranked as (select *, row_number() over (partition by patient
  order by coalesce(round(sensitivity_mean, 9), -1.0) desc, coalesce(round(fdr_per_24h_mean, 9), 'infinity'::double), coalesce(round(latency_sec_mean, 9), 'infinity'::double), model) as rank from runs where n_records > 0)"""


@query(f"with {RANK_SQL} select patient, model, rank, round(sensitivity_mean, 6) as sensitivity_mean from ranked")
def q44_model_ranking(spark, sf_dir):
    return rounded(detect.ranking(V.runs(spark, sf_dir)).select("patient", "model", "rank", "sensitivity_mean"), "sensitivity_mean")


@query(f"""with {V.RUNS} select model, count(*) as patients_evaluated, round(avg(sensitivity_mean), 6) as mean_sensitivity, round(avg(fdr_per_24h_mean), 6) as mean_fdr_per_24h,
round(avg(latency_sec_mean), 6) as mean_latency_sec from runs where n_records > 0 group by 1""")
def q45_model_rollup(spark, sf_dir):
    return rounded(detect.rollup(V.runs(spark, sf_dir)), "mean_sensitivity", "mean_fdr_per_24h", "mean_latency_sec")


@query(f"with {RANK_SQL} select patient, model, round(sensitivity_mean, 6) as sensitivity_mean from ranked where rank = 1")
def q46_best_per_patient(spark, sf_dir):
    best = detect.ranking(V.runs(spark, sf_dir)).where("rank = 1").select("patient", "model", "sensitivity_mean")
    return rounded(best, "sensitivity_mean")


@query(f"""with {V.SIG}, d as (select distinct record_id % 12 as patient, channel as model from sig where x > 250), p as (select distinct record_id % 12 as patient from sig),
w as (select patient, model from p, (values ('click'), ('error'), ('purchase'), ('signup'), ('view')) m(model))
select patient, model from w anti join d using (patient, model)""")
def q47_resume(spark, sf_dir):
    s = V.sig(spark, sf_dir).select((F.col("record_id") % 12).alias("patient"), F.col("channel").alias("model"), "x")
    return detect.missing_runs(s, ("click", "error", "purchase", "signup", "view"), s.where("x > 250").select("patient", "model").distinct())


@query(f"""with {V.EP}, x as (select y, j as dim, samples[j + 1] as v from ep, range(64) t(j)), m as (select dim, quantile_cont(v, 0.5) as threshold from x group by 1),
g as (select dim, threshold, count(*) as n, sum(y) as p, sum((v >= threshold)::int) as h, sum((v >= threshold and y = 1)::int) as hp from x join m using (dim) group by 1, 2)
select dim::int as dim, round(threshold, 6) as threshold, round(hp / n, 6) as support, round(hp / h, 6) as confidence, round((hp / h) / (p / n), 6) as lift from g""")
def q48_association_rules(spark, sf_dir):
    return rounded(models.association_rules(V.points(spark, sf_dir)), "threshold", "support", "confidence", "lift")


@query()
def q49_rf_regression(spark, sf_dir):
    return models.forest_regression(V.points(spark, sf_dir))


# --- text, reports, end to end


@query(r"""with d as (select doc_id, 'File Name: rec' || doc_id || '.edf' || chr(10) || 'Number of Seizures: 1' || chr(10) || 'Seizure 1 Start Time: ' || n_chars || ' seconds' || chr(10)
  || 'Seizure 1 End Time: ' || (n_chars + 40) || ' seconds' || chr(10) || chr(10) || 'File Name: other.edf' || chr(10) || 'Seizure Start Time: 1 seconds' || chr(10) as content from documents)
select doc_id, 0 as seizure_no, regexp_extract(content, 'Start Time: ([0-9.]+)', 1)::double as s0, regexp_extract(content, 'End Time: ([0-9.]+)', 1)::double as s1 from d""")
def q50_annotation_parse(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.concat(
        F.lit("File Name: rec"), F.col("doc_id"), F.lit(".edf\nNumber of Seizures: 1\nSeizure 1 Start Time: "), F.col("n_chars"), F.lit(" seconds\nSeizure 1 End Time: "),
        F.col("n_chars") + 40, F.lit(" seconds\n\nFile Name: other.edf\nSeizure Start Time: 1 seconds\n"),
    )
    return annotations.summary_intervals(d.select("doc_id", content.alias("content"), F.concat(F.lit("rec"), F.col("doc_id"), F.lit(".edf")).alias("file_name")), keys=["doc_id"])


@query("select event_id, coalesce(json_extract(props, '$.k')::bigint, -1) as k, coalesce(json_extract_string(props, '$.none'), 'absent') as none_ from events")
def q51_json_meta(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("j", F.from_json("props", "k long, none string"))
    return e.select("event_id", annotations.with_default(F.col("j.k"), F.lit(-1).cast("long")).alias("k"), annotations.with_default(F.col("j.none"), F.lit("absent")).alias("none_"))


@query(f"""with {WINDOWS_SQL}, a as (select record_id, count(*) as n_seizures from ann group by 1), c as (select record_id, count(distinct channel) as channels from sig group by 1)
select record_id % 12 as patient, record_id, count(*) as n_windows, count(*) filter (where label = 1) as n_ictal, count(*) filter (where label = 0) as n_interictal,
       count(*) filter (where label = -1) as n_unknown, coalesce(any_value(n_seizures), 0)::bigint as n_seizures, any_value(channels) as channels,
       (any_value(channels) * 24)::bigint as feature_dim, (count(*) * {STEP})::double as duration_seconds
from lab left join a using (record_id) join c using (record_id) group by 1, 2""")
def q52_export_summary(spark, sf_dir):
    s = V.sig(spark, sf_dir)
    n = lambda v, name: F.count_if(F.col("label") == v).alias(name)
    lab = _labelled(spark, sf_dir).groupBy("record_id").agg(F.count("*").alias("n_windows"), n(1, "n_ictal"), n(0, "n_interictal"), n(-1, "n_unknown"))
    a = V.ann_of(s).groupBy("record_id").agg(F.count("*").alias("n_seizures"))
    c = s.groupBy("record_id").agg(F.countDistinct("channel").alias("channels"))
    out = lab.join(a, "record_id", "left").join(c, "record_id")
    return out.select(
        (F.col("record_id") % 12).alias("patient"), "record_id", "n_windows", "n_ictal", "n_interictal", "n_unknown", F.coalesce("n_seizures", F.lit(0)).cast("long").alias("n_seizures"),
        "channels", (F.col("channels") * 24).alias("feature_dim"), annotations.with_default(F.lit(None).cast("double"), F.col("n_windows") * STEP).alias("duration_seconds"),
    )


@query(f"""with {V.SIG}, {V.ANN}, {V.PRED} select p.record_id, event_id, y_true, y_pred, max(case when t_sec >= s0 and t_sec <= s1 then 1 else 0 end) as in_interval
from pred p left join ann using (record_id) group by 1, 2, 3, 4""")
def q53_timeline(spark, sf_dir):
    s = V.sig(spark, sf_dir)
    j = V.pred_of(s).join(V.ann_of(s), "record_id", "left")
    inside = F.max(F.when((F.col("t_sec") >= F.col("s0")) & (F.col("t_sec") <= F.col("s1")), 1).otherwise(0))
    return j.groupBy("record_id", "event_id", "y_true", "y_pred").agg(inside.alias("in_interval"))


@query(f"""with {V.SIG} select channel, count(*) filter (where x <= 200) as n_success, count(*) filter (where not x <= 200) as n_failed, round(sum(x), 4) as total_runtime_sec from sig group by 1""")
def q54_status_summary(spark, sf_dir):
    s = V.sig(spark, sf_dir).select("channel", F.when(F.col("x") <= 200, "success").otherwise("failure").alias("status"), F.col("x").alias("runtime_sec"))
    return rounded(detect.status_summary(s, by=["channel"]), "total_runtime_sec", digits=4)


@query(f"""with {KNN_SQL}, p as (select k.record as record_id, e.start_sec as t_sec, id as event_id, (votes > 0)::int as y_pred, k.y as y_true, votes / n as y_score from knn k join ep e on e.epoch_id = k.id),
{V.edges('p', 'record_id')}, {V.events('record_id', 30.0)}, g as (
  select record_id, count(*) as n_windows, sum((y_true = 1 and y_pred = 1)::int) as tp, sum((y_true = 1 and y_pred = 0)::int) as fn, sum((y_true = 0 and y_pred = 1)::int) as fp from p group by 1),
n as (select record_id, count(*) as n_events from ev group by 1)
select g.record_id, n_windows, coalesce(n_events, 0)::bigint as n_events, round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 6) as recall,
       round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end, 6) as f1 from g left join n using (record_id)""")
def q55_end_to_end(spark, sf_dir):
    e = V.ep(spark, sf_dir)
    votes = cut_lineage(models.knn(V.points(spark, sf_dir)), "votes").join(e.select(F.col("epoch_id").alias("id"), "start_sec"), "id")
    p = votes.select(F.col("record").alias("record_id"), F.col("start_sec").alias("t_sec"), F.col("id").alias("event_id"), F.when(F.col("votes") > 0, 1).otherwise(0).alias("y_pred"), F.col("y").alias("y_true"), "y_score")
    n = detect.detect_events(p, 30.0).groupBy("record_id").agg(F.count("*").alias("n_events"))
    out = detect.recall_f1(p, by=["record_id"]).join(p.groupBy("record_id").agg(F.count("*").alias("n_windows")), "record_id").join(n, "record_id", "left")
    return rounded(out.withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long")), "recall", "f1")


def _stretches(spark, sf_dir):
    """Each recording's channels in stretches of eight samples: an epoch holds eight channels of eight dimensions."""
    e = V.ep(spark, sf_dir).select("record_id", F.floor(F.col("epoch_id") / 10).alias("k"), "samples")
    channel = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("c")
    x = e.select("record_id", "k", "samples", channel)
    return x.select("record_id", F.concat(F.lit("C"), F.col("c").cast("string")).alias("channel"), (F.col("k") * 8).alias("start_sample"), F.lit(64.0).alias("rate"), F.slice("samples", F.col("c") * 8 + 1, F.lit(8)).alias("samples"))


def _with_total(x: DataFrame) -> DataFrame:
    return x.join(stretches.extents(x).select("record_id", "channel", "total"), ["record_id", "channel"])


def _tiled(spark, sf_dir, size: int = 1024) -> DataFrame:
    """The same, in tiles of more samples."""
    return stretches.tiles(_with_total(_stretches(spark, sf_dir)), F.lit(size), F.lit(0), keep=["rate"])


@query()
def q56_ica(spark, sf_dir):
    f = cut_lineage(components.frames(_tiled(spark, sf_dir)), "frames")
    return rounded(components.variance_profile(f, 8), "share", "channel_share")


STRETCH_SQL = f"""{V.EP}, st as (select record_id, 'C' || c::varchar as channel, (epoch_id // 10) * 8 + j as i, samples[c * 8 + j + 1] as x from ep, range(8) t(c), range(8) u(j))"""


@query(f"""with {V.EP}, x as (select record_id, 'C' || ((j - 1) // 8)::varchar as channel, epoch_id, j, samples[j] as v from ep, range(1, 65) t(j)),
s as (select record_id, channel, avg(v) as m, stddev_pop(v) as sd from x group by all),
z as (select x.record_id, x.channel, (v - m) / greatest(sd, 1e-12) as z from x join s on x.record_id = s.record_id and x.channel = s.channel)
select record_id, channel, count(*) as n, round(sum(z * z), 4) as squares, round(sum(z * z * z), 3) as cubes, round(max(z), 5) as highest from z group by all""")
def q60_standardise(spark, sf_dir):
    z = stretches.standardise(_stretches(spark, sf_dir)).select("record_id", "channel", F.explode("samples").alias("z"))
    sums = z.groupBy("record_id", "channel").agg(F.count("*").alias("n"), r(F.sum(F.pow("z", F.lit(2))), 4).alias("squares"), r(F.sum(F.pow("z", F.lit(3))), 3).alias("cubes"), r(F.max("z"), 5).alias("highest"))
    return sums


@query()
def q61_math_summary(spark, sf_dir):
    return rounded(reduce.math_summary(V.points(spark, sf_dir), 8, 8), "silhouette_pca2d")


@query(f"""with {V.SIG}, a as (select *, row_number() over (partition by record_id, channel order by i) - 1 as k from sig), s as (select * from a where k >= 2 and k < 9)
select p.channel as channel_a, q.channel as channel_b, round(covar_samp(p.x, q.x), 4) as cov, count(*) as n
from s p join s q on p.record_id = q.record_id and p.k = q.k and p.channel <= q.channel group by 1, 2""")
def q62_sliced_cov(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("record_id", "channel").orderBy("i")) - 1
    return rounded(reduce.channel_covariance(V.sig(spark, sf_dir).withColumn("k", k), span=(2.0, 1.25, 4.9)), "cov", digits=4)


@query(f"""with {V.EP}, k as (select epoch_id, m, samples, m / 2.0 as t from ep, range(128) u(m))
select epoch_id, m::int as k, round(case when m % 2 = 0 then samples[m // 2 + 1] else list_sum(list_transform(range(64), lambda j: samples[j + 1] * sin(pi() * (t - j)) / (64 * tan(pi() * (t - j) / 64)))) end, 6) as y from k""")
def q57_resample(spark, sf_dir):
    """Every sample of each epoch at twice its rate, against the sum of the Fourier interpolation's kernel."""
    e = V.ep(spark, sf_dir).withColumn("out", signal.resample(F.col("samples"), F.lit(128.0)))
    return e.select("epoch_id", F.posexplode("out").alias("k", "y")).select("epoch_id", "k", r("y").alias("y"))


@query()
def q58_artefact_removal(spark, sf_dir):
    c = components.clean(_tiled(spark, sf_dir))
    power = F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v))
    return c.groupBy("record_id", "channel").agg(F.first("status").alias("status"), F.first(F.size("removed")).alias("n_removed"), F.sum(F.size("samples")).alias("n"), r(power, 4).alias("power"))


@query()
def q59_band_pass(spark, sf_dir):
    c = stretches.band_pass(_with_total(_stretches(spark, sf_dir)), Config(low_hz=1.0, high_hz=25.0), tile=F.lit(512))
    g = c.groupBy("record_id", "channel").agg(F.sum(F.size("samples")).alias("n"), F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v)).alias("power"))
    return g.select("record_id", "channel", "n", r(F.sqrt(F.col("power") / F.col("n"))).alias("rms"))


BOTH_WAYS = [sum(TAPS[k] * TAPS[k + abs(d)] for k in range(len(TAPS) - abs(d))) for d in range(1 - len(TAPS), len(TAPS))]


@query(f"""with {STRETCH_SQL}, n as (select record_id, channel, count(*) as n from st group by all),
ends as (select record_id, channel, n, max(x) filter (where i = 0) as x0, max(x) filter (where i = n - 1) as x1 from st join n using (record_id, channel) group by all),
ext as (select record_id, channel, i, x from st
  union all select record_id, channel, -i, 2 * x0 - x from st join ends using (record_id, channel) where i between 1 and {len(TAPS)}
  union all select record_id, channel, 2 * (n - 1) - i, 2 * x1 - x from st join ends using (record_id, channel) where i between n - 1 - {len(TAPS)} and n - 2)
select record_id, channel, i, round(y, 6) as y from (
  select record_id, channel, i, {" + ".join(f"{g!r} * {f'lag(x, {8 - k}) over w' if k < 8 else f'lead(x, {k - 8}) over w' if k > 8 else 'x'}" for k, g in enumerate(BOTH_WAYS))} as y
  from ext window w as (partition by record_id, channel order by i)) join n using (record_id, channel) where i >= 0 and i < n""")
def q63_filter_stretches(spark, sf_dir):
    """A filter forward and backward over stretches of eight samples, in tiles of 40 with a halo."""
    y = stretches.band_pass(_with_total(_stretches(spark, sf_dir)), tile=F.lit(40), taps=TAPS)
    y = y.select("record_id", "channel", "start_sample", F.posexplode("samples").alias("k", "y"))
    return y.select("record_id", "channel", (F.col("start_sample") + F.col("k")).alias("i"), r("y").alias("y"))


# --- joins by time, files, SQL


@query(SQL["q10_interval_join"])
def q64_interval_join_bins(spark, sf_dir):
    """q10 for many intervals of a recording: by bins of time and as-of joins."""
    o = segment.interval_overlap_many(*_windows(spark, sf_dir), bin_sec=WIDTH)
    gap = F.when(F.col("min_gap") < float("inf"), r("min_gap"))
    return o.select("record_id", "window_id", r("max_overlap").alias("max_overlap"), gap.alias("min_gap"))


@query(f"""with {EVENTS_SQL}, f as (select a.record_id, s0, s1, min(event_sec) filter (where event_sec >= s0 - {V.TOLERANCE}) as first from ann a left join ev using (record_id) group by all)
select record_id, round(s0, 6) as s0, case when first is not null then round(greatest(0.0, first - s0), 6) end as latency_sec from f""")
def q65_onset_latencies(spark, sf_dir):
    """The latency of every interval of a recording, not of its first alone."""
    _, a, e = _events(spark, sf_dir)
    return rounded(detect.onset_latencies(a, e, V.TOLERANCE).select("record_id", "s0", "latency_sec"), "s0", "latency_sec")


@query(f"""with {V.SIG}, p as (select record_id, event_id, t_sec from sig where channel = 'purchase'), c as (select record_id, t_sec, x from sig where channel = 'click')
select p.event_id, round(c.t_sec, 6) as click_sec, c.x as click_value from p asof left join c on p.record_id = c.record_id and p.t_sec >= c.t_sec""")
def q66_as_of_channel(spark, sf_dir):
    """For every sample of one channel the last one of another before it."""
    s = V.sig(spark, sf_dir)
    right = s.where("channel = 'click'").select("record_id", F.col("t_sec").alias("click_sec"), F.col("x").alias("click_value"))
    left = s.where("channel = 'purchase'").select("record_id", "event_id", "t_sec")
    found = as_of(left, right, by=["record_id"], left_time="t_sec", right_time="click_sec", values=["click_sec", "click_value"], segment=WIDTH)
    return found.select("event_id", r("click_sec").alias("click_sec"), "click_value")


@query(f"""with {V.EP} select 'r' || record_id::varchar as name, (epoch_id // 10)::bigint as row, len(samples)::bigint as width, round(list_sum(samples), 5) as total, round(samples[1], 6) as first, round(samples[64], 6) as last from ep""")
def q67_array_files(spark, sf_dir):
    """Every epoch as a row of its recording's array file, written and read back."""
    path = shared_folder(spark, "arrays")
    e = V.ep(spark, sf_dir).select(F.concat(F.lit("r"), F.col("record_id").cast("string")).alias("name"), F.floor(F.col("epoch_id") / 10).alias("row"), F.col("samples").alias("values"))
    npy.write_arrays(e, path)
    a = npy.read_arrays(spark, path).where("reason = ''")
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return a.select("name", "row", F.size("values").cast("long").alias("width"), r(total, 5).alias("total"), r(F.col("values")[0]).alias("first"), r(F.col("values")[63]).alias("last"))


@query(SQL["q36_detect_events"])
def q68_sql_events(spark, sf_dir):
    """q36 as a user of SQL writes it."""
    brinewave_sql.register(spark)
    query_ = f"select record_id, round(event_sec, 6) as event_sec from detect_events(table(select record_id, event_id, t_sec, y_pred from {{p}}) partition by record_id order by (t_sec, event_id), cast({V.REFRACTORY} as double))"
    return spark.sql(query_, p=V.pred(spark, sf_dir))


# --- status rows and report files


@query(f"""with {V.SIG}, t(name, pos) as (values {sql_values(TARGETS)}), f as (select record_id, event_id, upper(channel) as channel, row_number() over (partition by record_id, channel order by i) - 1 as k from sig where x > 30),
c as (select record_id, channel, count(*) as n, max(k) + 1 as total from f where k < 3 and event_id % 61 <> 0 group by all),
g as (select record_id, count(*) as have, max((n <> total)::int) as gap, min(total) as shortest, max(total) as longest from c group by 1),
m as (select g.record_id, coalesce(string_agg(name, ', ' order by pos) filter (where c.channel is null), '') as missing from g cross join t left join c on c.record_id = g.record_id and c.channel = t.name group by 1)
select record_id, have as retained_n, missing, case when have < 5 then 'rejected' when gap = 1 or shortest <> longest then 'failed' else 'ok' end as status,
       case when have < 5 then 'only ' || have || ' of 6 channels; missing: ' || missing when gap = 1 then 'samples are missing or overlap' when shortest <> longest then 'channels of unequal lengths' else '' end as reason
from g join m using (record_id)""")
def q69_recording_status(spark, sf_dir):
    """One status row for each recording: quorum with the missing channels, gaps, unequal lengths. A stretch is one sample."""
    k = F.row_number().over(Window.partitionBy("record_id", "channel").orderBy("i")) - 1
    s = V.sig(spark, sf_dir).where("x > 30").withColumn("k", k).where("k < 3 and event_id % 61 <> 0")
    rows = s.select("record_id", "channel", F.col("k").cast("long").alias("start_sample"), F.lit(1.0).alias("sfreq"), F.array("x").alias("samples"), F.lit("ok").alias("status"), F.lit("").alias("reason"))
    out = pipeline.recordings(rows, Config(least_channels=5), targets=TARGETS, exclude=("ECG",))
    return out.select("record_id", F.size("retained").cast("long").alias("retained_n"), F.array_join("missing", ", ").alias("missing"), "status", "reason")


@query(SQL["q44_model_ranking"])
def q70_report_csv(spark, sf_dir):
    """The ranking as a CSV report that is read again."""
    path = shared_folder(spark, "ranking")
    ranked = detect.ranking(V.runs(spark, sf_dir))
    annotations.write_csv(ranked, path, ["patient", "model", "rank", "sensitivity_mean"])
    back = spark.read.option("header", True).schema("patient long, model string, rank long, sensitivity_mean double").csv(path)
    return rounded(back, "sensitivity_mean")


@query(f"""with {WINDOWS_SQL} select record_id % 12 as patient, count(*) as n_windows, count(*) filter (where label = 1) as n_ictal from lab where label <> -1 group by 1""")
def q71_processed_windows(spark, sf_dir):
    """Labelled windows by patient, written twice (the second time for one patient alone) and read again."""
    path = shared_folder(spark, "processed")
    k = segment.known(_labelled(spark, sf_dir)).withColumn("patient", F.col("record_id") % 12)
    annotations.write_processed(k, path)
    annotations.write_processed(k.where("patient = 3"), path)
    back = spark.read.schema("record_id long, window_id long, label int, patient long").parquet(path)
    return back.groupBy("patient").agg(F.count("*").alias("n_windows"), F.count_if(F.col("label") == 1).alias("n_ictal"))


@query(f"""with {V.SIG} select distinct 'p' || (record_id % 12)::varchar as patient from sig where channel in ('click', 'view') and x > 200""")
def q72_patients_of_results(spark, sf_dir):
    """Patients named by the files of models' results."""
    s = V.sig(spark, sf_dir).where("x > 200")
    names = s.select(F.concat("channel", F.lit("_p"), (F.col("record_id") % 12).cast("string"), F.lit("_loso.json")).alias("file_name"))
    return annotations.discover_patients(names, ("click", "view"))
