"""Operators for SQL: register(spark) makes them known to a session.

    SELECT * FROM detect_events(TABLE(p) PARTITION BY record_id ORDER BY (t_sec, event_id), 30.0)
    SELECT interval_label(t0, t1, max_overlap, min_gap, 30.0) FROM windows

detect_events is a table function: Spark partitions and sorts its rows, and it sees them one by one, so a recording is
never held. The others are scalar SQL functions, which Catalyst inlines.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from brinewave.config import AUXILIARY, DEFAULT


@udtf(returnType="record_id: bigint, event_sec: double")
class DetectEvents:
    """Rising edges of y_pred outside the refractory, of rows with record_id, t_sec and y_pred in order of time; the state is the last event and the last prediction."""

    def __init__(self) -> None:
        self.last, self.before = None, 0

    def eval(self, row: Row, refractory: float) -> Iterator[tuple]:
        pred = row["y_pred"]
        if pred == 1 and self.before == 0:
            t = float(row["t_sec"])
            if self.last is None or t - self.last > refractory:
                self.last = t
                yield int(row["record_id"]), t
        self.before = 0 if pred is None else int(pred)


def register(spark: SparkSession) -> None:
    """detect_events(table, refractory), normal_channel(name), is_auxiliary(name), interval_label(t0, t1, max_overlap, min_gap, margin)."""
    spark.udtf.register("detect_events", DetectEvents)
    hit = " or ".join(f"contains(upper(name), '{p}')" for p in AUXILIARY)
    for name, head, body in (
        ("normal_channel", "name string) returns string", "replace(upper(name), ' ', '')"),
        ("is_auxiliary", "name string) returns boolean", hit),
        (
            "interval_label", "t0 double, t1 double, max_overlap double, min_gap double, margin double) returns int",
            f"case when max_overlap / (t1 - t0) >= {DEFAULT.ictal_overlap} then 1 when max_overlap = 0 and min_gap >= margin then 0 else -1 end",
        ),
    ):
        spark.sql(f"create or replace temporary function {name}({head} return {body}")
