"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Document rates r in [0, 2] stay as near as possible, in relative entropy, to rate 1
for each document, subject to `sum of r * size = target` for each source. The convex dual has one multiplier per
source, the rates are exponentially tilted in the document's size,

    r = 2 exp(l c) / (1 + exp(l c)),   c = size / mean size of the source,

and Newton steps on the dual need two sums per source. These sums are taken by Spark over a histogram of (source,
size), so each step costs the number of distinct sizes and not the number of documents; a bracket keeps every step
safe. The rates become whole copies by systematic rounding: within a source, from the largest size to the smallest, the copies
follow the running total of the rates, so that the words taken miss the target by no more than about the source's
longest document. Rows of equal source and size are ranked by a hash of id and text.

Only DataFrame operations are used; the driver sees nothing but the largest residual of a step.

Defined cases. A null text has size 0; documents of size 0 get whatever copies their rate gives and take no words. A null
source is a source of its own, the last in order. An empty table gives an empty mix. Very long texts are measured
whole. Repeated rows are separate documents; of rows that are equal in id and text any may be that which is taken.
Extra columns are kept by `mix`, but those named as its outputs are replaced; __ columns are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinewave.llm.common import materialize, n_words, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
STEPS = 40
RESIDUAL = 1e-9
ROWS_PER_PART = 500  # rows of equal source and size that are ranked together


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by repeating weights, none above most times its size.

    The excess goes to the others by weight until none is above. The result is target = min(most * size, level * weight),
    and the level follows from sums over the sources in the order in which they reach their limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("__w", w).withColumn("__cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns({
        "__total": F.sum("source_size").over(whole) * F.lit(share),
        "__full": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
        "__rest": F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
    })
    level = (F.col("__total") - F.col("__full")) / F.col("__rest")  # if all sources before this one are at their limit
    s = s.withColumn("__level", F.max(F.when(level * F.col("__w") <= F.col("__cap"), level)).over(whole))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def tilted(multiplier: Column, c: Column, most: float = MOST) -> Column:
    """Rate of a document; stable for multipliers of either sign."""
    x = F.greatest(F.least(multiplier * c, F.lit(700.0)), F.lit(-700.0))
    return F.lit(most) / (1 + F.exp(-x))


def balance(cells: DataFrame, goals: DataFrame, *, steps: int = STEPS, residual: float = RESIDUAL, most: float = MOST) -> DataFrame:
    """(source, multiplier) for cells (source, size, n) and goals (source, source_size, target), by safeguarded Newton steps on the dual.

    A multiplier of plus or minus infinity stands for rate most or 0: those sources are at their limit.
    """
    unit = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"))
    state = goals.join(unit, goals.source.eqNullSafe(unit.source)).select(goals.source, "source_size", "target", "unit")
    full = F.col("target") >= F.lit(most * (1 - 1e-12)) * F.col("source_size")
    start = F.when(full, F.lit(float("inf"))).when(F.col("target") <= 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))
    state = materialize(state.withColumns({"multiplier": start, "lo": F.lit(-1e6), "hi": F.lit(1e6), "miss": F.lit(1.0)}), "multipliers")
    for _ in range(steps):
        open_ = state.where(F.abs("multiplier") < F.lit(float("inf"))).where(F.col("miss") > residual)
        x = cells.join(open_.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
        c = F.col("size") / F.col("unit")
        r = tilted(F.col("multiplier"), c, most)
        sums = x.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * r).alias("__have"), F.sum(F.col("n") * F.col("size") * c * r * (1 - r / most)).alias("__slope"))
        sums = sums.withColumnRenamed("source", "__s")
        j = state.join(sums, F.col("source").eqNullSafe(F.col("__s")), "left")
        gap = F.col("__have") - F.col("target")
        lo = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("hi"))
        newton = F.col("multiplier") - gap / F.col("__slope")
        middle = F.when(hi >= 1e6, F.greatest(lo, F.lit(0.0)) * 2 + 1).when(lo <= -1e6, F.least(hi, F.lit(0.0)) * 2 - 1).otherwise((lo + hi) / 2)
        step = F.when(F.col("__have").isNull() | (gap == 0), F.col("multiplier")).when((F.col("__slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise(middle)
        miss = F.when(F.col("__have").isNull(), F.lit(0.0)).otherwise(F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0)))
        state = materialize(j.select("source", "source_size", "target", "unit", step.alias("multiplier"), lo.alias("lo"), hi.alias("hi"), miss.alias("miss")), "multipliers")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= residual:
            break
    return state.select("source", "source_size", "target", "unit", "multiplier")


def mix(documents: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The documents with size, source_size, target, rate and copies."""
    key = F.xxhash64("doc_id", "text") if "doc_id" in documents.columns else F.xxhash64("text")
    # A null source is told apart by a column of its own, so that joins and windows share one partitioning.
    sized = documents.withColumns({"__src": F.coalesce(F.col("source").cast("string"), F.lit("")), "__nil": F.col("source").isNull(), "__size": n_words(F.col("text")), "__key": key})
    slim = materialize(sized.select("source", "__src", "__nil", "__size", "__key"), "sizes")
    cells = materialize(slim.groupBy("source", F.col("__size").alias("size")).agg(F.count("*").alias("n")), "cells")
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    state = balance(cells, goals, most=most)
    rated = cells.join(state.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
    c = F.when(F.col("unit") > 0, F.col("size") / F.col("unit")).otherwise(F.lit(0.0))
    rate = F.when(F.col("multiplier") == float("inf"), F.lit(most)).when(F.col("multiplier") == float("-inf"), F.lit(0.0)).otherwise(tilted(F.col("multiplier"), c, most))
    rated = rated.select("source", "size", "n", "source_size", "target", rate.alias("rate"))
    run = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("__from", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(run), F.lit(0.0)))
    rated = rated.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__src"), F.col("source").isNull().alias("__nil"), F.col("size").alias("__size"),
        F.col("n").alias("__rows"), "source_size", "target", "rate", "__from",
    )
    rated = materialize(rated, "rates")
    # A cell of equal sizes may hold a third of all rows. Its rows are ranked in parts, which are ranges of their keys;
    # the rows of the parts before are added to a rank, so a cell has the same ranks however it is cut.
    cell, piece = ["__src", "__nil", "__size"], ["__src", "__nil", "__size", "__part"]
    part = F.floor((F.col("__key") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("__rows") / ROWS_PER_PART))
    pieces = slim.join(rated.where(F.col("__rows") > ROWS_PER_PART), cell).groupBy(*cell, part.alias("__part")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*cell).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*piece, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    ranked = sized.join(rated, cell).withColumn("__part", part)
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy(*piece).orderBy("__key")))
    placed = ranked.join(pieces, piece, "left").withColumn("__rank", F.col("__rank") + F.coalesce(F.col("__before"), F.lit(0)))
    phase = F.col("__from") + F.lit(0.5)
    upto = lambda k: F.floor(phase + k * F.col("rate") + F.lit(1e-9))
    copies = F.when(F.col("rate") >= most, F.lit(int(most))).otherwise(upto(F.col("__rank")) - upto(F.col("__rank") - 1)).cast("long")
    out = {"size": F.col("__size"), "source_size": F.col("source_size"), "target": F.col("target"), "rate": F.col("rate"), "copies": copies}
    keep = [x for x in documents.columns if x not in out]
    return placed.select(*keep, *[v.alias(k) for k, v in out.items()])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Odd rows as in the module; the columns are those of docs."""
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__row"))
    return mix(whole).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
