from pyspark.sql import functions as F

from brinewave.operators import detect
from brinewave.streaming import events as S


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_events_as_in_batch(spark, tmp_path):
    rows = [(k % 3, k, float(7 * k), int(k * k % 5 < 2)) for k in range(90)]
    schema = "record_id long, event_id long, t_sec double, y_pred int"
    for b in range(3):
        spark.createDataFrame(rows[30 * b : 30 * b + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.record_id, r.event_sec) for r in drain(S.stream_events(stream, 30.0), "ev").collect())
    batch = detect.detect_events(spark.createDataFrame(rows, schema), 30.0)
    assert got == sorted((r.record_id, r.event_sec) for r in batch.collect())


def test_complete_epochs(spark, tmp_path):
    t = spark.range(0, 21).select(F.lit(1).alias("record_id"), F.lit("c").alias("channel"), F.timestamp_seconds(F.col("id") * 0.5).alias("ts"), F.col("id").cast("double").alias("x"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    got = drain(S.stream_epochs(stream, 4, late="0 seconds"), "epochs").collect()
    assert len(got) == 5 and all(r.n == 4 for r in got)


def test_complete_stacks(spark, tmp_path):
    """Sliding stacks with all their samples; the last, which aren't full, are left out."""
    t = spark.range(0, 40).select((F.col("id") % 2).alias("record_id"), F.timestamp_seconds(F.floor(F.col("id") / 2).cast("double")).alias("ts"))
    t.where("not (record_id = 1 and ts = timestamp_seconds(9))").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    got = drain(S.stream_stacks(stream, 6, width="6 seconds", step="4 seconds", late="0 seconds"), "stacks").select("record_id", F.unix_seconds("start").alias("s")).collect()
    assert sorted(map(tuple, got)) == [(0, 0), (0, 4), (0, 8), (0, 12), (1, 0), (1, 12)]


def test_streamed_events_meet_a_table_of_intervals(spark, tmp_path):
    schema = "record_id long, event_sec double"
    spark.createDataFrame([(1, 10.0), (1, 50.0), (2, 10.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    intervals = spark.createDataFrame([(1, 12.0, 20.0), (1, 8.0, 9.0), (3, 0.0, 99.0)], "record_id long, s0 double, s1 double")
    got = drain(S.with_intervals(stream, intervals, 2.0), "hits").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 10.0, 12.0, 20.0), (1, 10.0, 8.0, 9.0), (1, 50.0, None, None), (2, 10.0, None, None)]


def ordered(spark, folder, checkpoint, out):
    """Run what there is of a stream of files, one a batch, from where the checkpoint is."""
    S.use_rocksdb(spark)
    schema = "record_id long, ts timestamp, t_sec double, y_pred int, place long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = S.stream_ordered_events(stream, 30.0, late="40 seconds", idle_sec=500.0).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_ordered_events_over_restarts_and_disorder(spark, tmp_path):
    """Rows out of order within the watermark give the batch operator's events, over a restart from the checkpoint; later rows are dropped."""
    import random

    rng = random.Random(4)
    rows = [(k % 2, k, float(5 * k), int(rng.random() < 0.5)) for k in range(80)]
    folder, schema = str(tmp_path / "in"), "record_id long, place long, t_sec double, y_pred int"

    def put(some):
        df = spark.createDataFrame(some, schema).withColumn("ts", F.timestamp_seconds(F.col("t_sec") + 1_000))
        df.select("record_id", "ts", "t_sec", "y_pred", "place").coalesce(1).write.mode("append").parquet(folder)

    shuffled = sorted(rows, key=lambda r: r[2] + rng.uniform(-18, 18))
    put(shuffled[:40])
    ordered(spark, folder, str(tmp_path / "ck"), str(tmp_path / "out"))
    put(shuffled[40:])
    put([(0, 900, 3.0, 1), (1, 901, 4.0, 1), (7, 902, 5_000.0, 0)])  # two too late, one that moves the watermark on
    put([(7, 903, 5_001.0, 0)])
    ordered(spark, folder, str(tmp_path / "ck"), str(tmp_path / "out"))
    got = sorted((r.record_id, r.event_sec) for r in spark.read.schema("record_id long, event_sec double").parquet(str(tmp_path / "out")).collect())
    batch = detect.detect_events(spark.createDataFrame([(r, p, t, y) for r, p, t, y in rows], "record_id long, event_id long, t_sec double, y_pred int"), 30.0)
    assert got == sorted((r.record_id, r.event_sec) for r in batch.collect())
