"""From signals to ranked models in one application: every step a transformation, patients a column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.config import AUXILIARY, DEFAULT, MONTAGE, Config
from brinewave.operators import channels, components, detect, features, segment, signal, stretches
from brinewave.operators.tables import cut_lineage
from brinewave.sources.edf import EdfSource

PIPELINE = "band_pass-components-zscore-resample"


def recordings(rows: DataFrame, config: Config = DEFAULT, *, targets: Sequence[str] = MONTAGE, exclude: Sequence[str] = AUXILIARY) -> DataFrame:
    """(record_id, status, reason, rate, total, original_channels, scalp_channels, retained, missing) of every recording, one row each.

    rows are stretches (record_id, channel, start_sample, sfreq, samples) with status and reason; a row that the source
    has failed, without a channel, fails its recording. Otherwise a recording is rejected under the quorum, and failed
    with gaps or overlaps, several rates, or channels of unequal lengths. retained and missing are in the targets' order.
    """
    broken = rows.where("status <> 'ok'").groupBy("record_id").agg(F.min("reason").alias("broken"))
    name = channels.normalised(F.col("channel"))
    kept = channels.exclude_auxiliary(rows.where("status = 'ok'").select("record_id", "channel").distinct(), exclude)
    counted = rows.groupBy("record_id").agg(F.countDistinct("channel").alias("original_channels"))
    scalp = kept.groupBy("record_id").agg(F.count("*").alias("scalp_channels"))
    e = stretches.extents(channels.exclude_auxiliary(rows.where("status = 'ok'"), exclude).withColumn("channel", name).where(F.col("channel").isin(*targets)), "sfreq")
    wanted = F.array(*map(F.lit, targets))
    g = e.groupBy("record_id").agg(
        F.collect_set("channel").alias("__have"), F.min("whole").alias("__whole"), (F.min("one_rate") & (F.max("rate") == F.min("rate"))).alias("__rates"),
        F.min("rate").alias("rate"), F.min("total").alias("total"), F.max("total").alias("__most"),
    )
    have = F.coalesce("__have", F.array().cast("array<string>"))
    out = counted.join(scalp, "record_id", "left").join(g, "record_id", "left").join(broken, "record_id", "left")
    out = out.withColumns({"retained": F.filter(wanted, lambda t: F.array_contains(have, t)), "missing": F.filter(wanted, lambda t: ~F.array_contains(have, t))})
    few = F.concat(F.lit("only "), F.size("retained").cast("string"), F.lit(f" of {len(targets)} channels; missing: "), F.array_join("missing", ", "))
    reason = (
        F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.size("retained") < config.least_channels, few).when(~F.col("__whole"), "samples are missing or overlap")
        .when(~F.col("__rates"), "channels have several rates").when(F.col("total") != F.col("__most"), "channels of unequal lengths").otherwise("")
    )
    status = F.when(F.col("broken").isNotNull(), "failed").when(F.size("retained") < config.least_channels, "rejected").when(reason != "", "failed").otherwise("ok")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("record_id", status.alias("status"), reason.alias("reason"), "rate", "total", number("original_channels"), number("scalp_channels"), "retained", "missing")


def read_recordings(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Stretches of all EDF files under a path, and a failed row for each that can't be read."""
    spark.dataSource.register(EdfSource)
    return spark.read.format("edf").options(**options).load(path)


def preprocess_files(spark: SparkSession, path: str, config: Config = DEFAULT, *, ica: bool = True, targets: Sequence[str] = MONTAGE, exclude: Sequence[str] = AUXILIARY) -> tuple[DataFrame, DataFrame]:
    """(clean stretches, status of every recording) of EDF files under a path, each filtered at its own rate; recordings that aren't ok are only in the status."""
    rows = read_recordings(spark, path)
    status = cut_lineage(recordings(rows, config, targets=targets, exclude=exclude), "recordings")
    return preprocess_stretches(rows.where("status = 'ok'"), status, config, ica=ica, targets=targets, exclude=exclude), status


def preprocess_stretches(rows: DataFrame, status: DataFrame, config: Config = DEFAULT, *, ica: bool = True, targets: Sequence[str] = MONTAGE, exclude: Sequence[str] = AUXILIARY) -> DataFrame:
    """(record_id, channel, rate, start_sample, samples, mean, std, status, reason, removed, steps): stretches of the recordings that are ok, filtered, cleaned, normalised and at the target rate.

    Stretches stay stretches: a filter takes its halo from the neighbours, all statistics are sums. Only channels at
    another rate than the target are gathered, since Fourier resampling is of a whole channel.
    """
    good = status.where("status = 'ok'").select("record_id", "rate", "total")
    named = channels.exclude_auxiliary(rows, exclude).withColumn("channel", channels.normalised(F.col("channel"))).where(F.col("channel").isin(*targets))
    x = named.select("record_id", "channel", "start_sample", "samples").join(good, "record_id")
    x = stretches.band_pass(x, config, tile=tile_samples(config))
    if ica:
        x = components.clean(x, components=config.ica_components, eye=config.eye_threshold, muscle=config.muscle_threshold)
    else:
        x = x.select("record_id", "channel", "rate", "start_sample", "samples", F.lit("skipped").alias("status"), F.lit("not asked for").alias("reason"), F.array().cast("array<int>").alias("removed"))
    x = stretches.standardise(cut_lineage(x, "cleaned"), config.zscore_eps)
    same = F.abs(F.col("rate") - config.target_hz) < config.rate_tolerance
    carried = ["rate", "status", "reason", "removed", "mean", "std"]
    other = stretches.whole(x.where(~same), keep=carried).withColumn("samples", signal.resample(F.col("samples"), F.col("rate"), config.target_hz, config.rate_tolerance))
    steps = [F.lit(f"band_pass {config.low_hz:g}-{config.high_hz:g} Hz"), *([F.lit("ica")] if ica else []), F.lit(f"zscore eps {config.zscore_eps:g}"), F.concat(F.lit("resample "), F.format_string("%s", F.col("rate")), F.lit(f" to {config.target_hz:g} Hz"))]
    both = x.where(same).unionByName(other.withColumn("start_sample", F.lit(0).cast("long")))
    return both.withColumn("steps", F.array(*steps)).withColumn("rate", F.lit(config.target_hz)).select("record_id", "channel", "rate", "start_sample", "samples", "mean", "std", "status", "reason", "removed", "steps")


def tile_samples(config: Config) -> Column:
    """Samples of a tile: whole epochs of about a minute."""
    epoch = F.floor(F.col("rate") * config.epoch_sec)
    return F.greatest(epoch, F.lit(1)) * max(1, round(60 / config.epoch_sec))


def preprocess(chunks: DataFrame, rate: float, config: Config = DEFAULT, **options) -> DataFrame:
    """preprocess_stretches of rows that hold whole channels at one rate: record_id, channel, samples. Recordings under the quorum are left out."""
    rows = chunks.select("record_id", "channel", F.lit(0).cast("long").alias("start_sample"), F.lit(float(rate)).alias("sfreq"), "samples", F.lit("ok").alias("status"), F.lit("").alias("reason"))
    named = {k: v for k, v in options.items() if k in ("targets", "exclude")}
    return preprocess_stretches(rows, recordings(rows, config, **named), config, **options)


def provenance(clean: DataFrame, status: DataFrame) -> DataFrame:
    """(record_id, pipeline, original_channels, scalp_channels, original_rate, missing, steps, removed, means, deviations, channel_names, n_samples, rate, duration_sec) of every recording that was cleaned."""
    c = clean.groupBy("record_id", "channel").agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"), F.first("rate").alias("rate"), F.first("removed").alias("removed"), F.first("steps").alias("steps"),
        F.max(F.col("start_sample") + F.size("samples")).alias("n"),
    )
    by_name = F.array_sort(F.collect_list(F.struct("channel", "mean", "std")))
    g = c.groupBy("record_id").agg(by_name.alias("c"), F.first("rate").alias("rate"), F.first("removed").alias("removed"), F.first("steps").alias("steps"), F.max("n").alias("n_samples"))
    said = status.select("record_id", F.lit(PIPELINE).alias("pipeline"), "original_channels", "scalp_channels", F.col("rate").alias("original_rate"), "missing")
    pairs = lambda v: F.map_from_arrays(F.col("c.channel"), F.col(f"c.{v}"))
    out = said.join(g, "record_id")
    return out.select(*said.columns, "steps", "removed", pairs("mean").alias("means"), pairs("std").alias("deviations"), F.col("c.channel").alias("channel_names"), "n_samples", "rate", (F.col("n_samples") / F.col("rate")).alias("duration_sec"))


def epoch_rows(clean: DataFrame, rate: float, config: Config = DEFAULT) -> DataFrame:
    """(record_id, channel, epoch_id, start_sec, samples): whole epochs of stretches, which begin and, but for the last, end with an epoch."""
    n = int(config.epoch_sec * rate)
    start = F.col("start_sample") if "start_sample" in clean.columns else F.lit(0)
    k = F.sequence(F.lit(0), F.floor(F.size("samples") / n).cast("int") - 1)
    e = clean.where(F.size("samples") >= n).select("record_id", "channel", F.floor(start / n).alias("first"), "samples", F.explode(k).alias("k"))
    epoch = F.col("first") + F.col("k")
    return e.select("record_id", "channel", epoch.alias("epoch_id"), (epoch * n / F.lit(rate)).alias("start_sec"), F.slice("samples", F.col("k") * n + 1, F.lit(n)).alias("samples"))


def window_features(epochs: DataFrame, intervals: DataFrame, rate: float, config: Config = DEFAULT) -> DataFrame:
    """(record_id, window_id, start_sec, label, features) of labelled windows; energies are taken once per epoch.

    Windows are labelled first, so that nothing is gathered for windows that are dropped.
    """
    n = int(config.epoch_sec * rate)
    edges = features.band_edges(config.bands, config.band_low, config.band_high)
    energy = epochs.select("record_id", "channel", "epoch_id", F.posexplode(features.band_energy_fft(F.col("samples"), rate, edges)).alias("band", "value"))
    one = epochs.groupBy("record_id", "epoch_id").agg(F.min("start_sec").alias("start_sec"))
    stacks = segment.stacks(one, config)
    at = stacks.join(one.withColumnRenamed("epoch_id", "first_epoch"), ["record_id", "first_epoch"])
    timed = at.select("record_id", "window_id", F.col("start_sec").alias("t0"), (F.col("start_sec") + config.stack * n / rate).alias("t1"))
    labelled = segment.known(segment.label_windows(timed, intervals, config)).select("record_id", "window_id", F.col("t0").alias("start_sec"), "label")
    placed = segment.stack_map(stacks, config).join(labelled.select("record_id", "window_id"), ["record_id", "window_id"], "left_semi")
    long_ = placed.join(energy, ["record_id", "epoch_id"])
    return labelled.join(features.vectors(long_, ["record_id", "window_id"], ["w", "band", "channel"]), ["record_id", "window_id"])


def evaluate(predictions: DataFrame, intervals: DataFrame, records: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(record results, run summaries) of predictions with model, patient, record_id, t_sec, event_id, y_true, y_pred, y_score."""
    by = ["model", "patient", "record_id"]
    results = detect.record_results(predictions, intervals, records, by=by, refractory=config.refractory_sec, tol=config.tolerance_sec)
    return results, detect.run_summary(results, predictions)


def rank(summaries: DataFrame, write: Callable[[DataFrame], None] | None = None) -> DataFrame:
    ranked = detect.ranking(summaries)
    if write:
        write(ranked)
    return ranked
