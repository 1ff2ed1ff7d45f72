"""As-of joins: to each row of one table the last (or first) row of another at or before (or after) its time, by key.

Both sides become one stream of rows, sorted by key, segment of time and time; what a row looks for is the last value
seen in its segment, else what earlier segments end with. A key's rows are never gathered and a key isn't one task: its
segments are, and only one row for each of them is carried over borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 86_400.0


def as_of(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], forward: bool = False, segment: float = SEGMENT) -> DataFrame:
    """left with right's values from the row with the greatest right_time <= left_time, or forward the least >= left_time; null without one.

    Equal times match. Of right rows with equal times that with the greatest values counts, compared in their order
    (forward: the least). Rows of left without a time or a key get nulls; columns of left named as a value are replaced.
    """
    sign = -1.0 if forward else 1.0
    kept = [c for c in left.columns if c not in values]
    kind = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    clock = lambda c: (F.col(c).cast("double") * sign).alias("__t")
    key = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    keys = [f"__k{i}" for i in range(len(by))]
    a = left.select(*key, clock(left_time), F.lit(1).alias("__side"), F.struct(*kept).alias("__row"), F.lit(None).cast(kind).alias("__v"))
    row = a.schema["__row"].dataType
    known = F.col(right_time).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    b = right.where(known).select(*key, clock(right_time), F.lit(0).alias("__side"), F.lit(None).cast(row).alias("__row"), F.struct(*values).alias("__v"))
    both = a.unionByName(b).withColumn("__segment", F.floor(F.col("__t") / segment))
    seen = Window.partitionBy(*keys, "__segment").orderBy("__t", "__side", F.desc("__v") if forward else F.asc("__v")).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("__own", F.last("__v", ignorenulls=True).over(seen)).where("__side = 1")
    before = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    if forward:  # of rows at the segment's end, in turned time, the least values
        at_end = F.max(F.when(F.col("__side") == 0, F.col("__t")))
        end_time = both.groupBy(*keys, "__segment").agg(at_end.alias("__end_t"))
        ends = end_time.join(both.where("__side = 0").groupBy(*keys, "__segment", F.col("__t").alias("__end_t")).agg(F.min("__v").alias("__end")), [*keys, "__segment", "__end_t"], "left")
    else:
        ends = both.groupBy(*keys, "__segment").agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__v")))["__v"].alias("__end"))
    carried = ends.select(*keys, "__segment", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    joined = own.join(carried, [*keys, "__segment"], "left")
    found = F.when(F.col("__t").isNotNull(), F.coalesce("__own", "__carried"))
    return joined.withColumn("__found", found).select("__row.*", *[F.col("__found")[v].alias(v) for v in values])
