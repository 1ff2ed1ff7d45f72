from brinewave import sql
from brinewave.config import Config
from brinewave.operators import channels, detect, segment


def test_events_in_sql_as_by_the_operator(spark):
    rows = [(k % 5, k, float(7 * k), None if k % 17 == 0 else int(k * k % 5 < 2)) for k in range(300)]
    df = spark.createDataFrame(rows, "record_id long, event_id long, t_sec double, y_pred int").repartition(7)
    df.createOrReplaceTempView("p")
    sql.register(spark)
    got = spark.sql("select * from detect_events(table(p) partition by record_id order by (t_sec, event_id), 30.0)")
    expected = detect.detect_events(df.na.fill(0, ["y_pred"]), 30.0)
    assert sorted(map(tuple, got.collect())) == sorted((r.record_id, r.event_sec) for r in expected.collect())
    assert spark.sql("select * from detect_events(table(select * from p where false) partition by record_id order by (t_sec), 30.0)").count() == 0


def test_functions_in_sql(spark):
    sql.register(spark)
    c = spark.createDataFrame([(1, "fp1 - f7"), (1, "ecg 2"), (1, None)], "record_id int, channel string")
    c.createOrReplaceTempView("c")
    assert {r.n for r in spark.sql("select normal_channel(channel) as n from c where not is_auxiliary(channel)").collect()} == {r.n for r in channels.exclude_auxiliary(c).select(channels.normalised(c.channel).alias("n")).collect()} == {"FP1-F7"}
    w = spark.createDataFrame([(0.0, 10.0, 5.0, 1e9), (0.0, 10.0, 0.0, 30.0), (0.0, 10.0, 0.0, 29.0), (0.0, 10.0, 4.0, 99.0)], "t0 double, t1 double, max_overlap double, min_gap double")
    w.createOrReplaceTempView("w")
    rows = spark.sql("select interval_label(t0, t1, max_overlap, min_gap, 30.0) as a, * from w")
    assert [r.a for r in rows.collect()] == [r.b for r in w.withColumn("b", segment.label(Config(), margin=30.0)).collect()] == [1, 0, -1, -1]
