"""Channel exclusion, montage selection and the quorum of a recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.config import AUXILIARY, DEFAULT, MONTAGE


def normalised(name: Column) -> Column:
    """Upper case without spaces."""
    return F.replace(F.upper(name), F.lit(" "), F.lit(""))


def exclude_auxiliary(channels: DataFrame, patterns: Sequence[str] = AUXILIARY, *, name: str = "channel") -> DataFrame:
    """Channels whose upper-cased name contains none of the patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(F.upper(name), F.lit(p))
    return channels.where(~hit)


def select_montage(channels: DataFrame, targets: Sequence[str] = MONTAGE, *, by: Sequence[str] = ("record_id",), name: str = "channel") -> DataFrame:
    """Per recording: found, retained and missing, both in the targets' order.

    Names are collected as a set, which the targets bound once other names are dropped before the shuffle.
    """
    known = channels.withColumn("__name", normalised(F.col(name)))
    wanted = F.array(*[F.lit(t) for t in targets])
    hit = F.collect_set(F.when(F.col("__name").isin(*targets), F.col("__name")))
    found = known.groupBy(*by).agg(hit.alias("__hit"))
    return found.select(
        *by,
        F.filter(wanted, lambda t: F.array_contains("__hit", t)).alias("retained"),
        F.filter(wanted, lambda t: ~F.array_contains("__hit", t)).alias("missing"),
    ).withColumns({"retained_n": F.size("retained"), "missing_n": F.size("missing")})


def quorum(channels: DataFrame, least: int = DEFAULT.least_channels, *, by: Sequence[str] = ("record_id",), name: str = "channel") -> DataFrame:
    """Per recording: number of distinct channels and status ok or rejected."""
    n = channels.groupBy(*by).agg(F.countDistinct(name).alias("n_channels"))
    return n.withColumn("status", F.when(F.col("n_channels") < least, "rejected").otherwise("ok"))
