"""Helpers that the training-data operators share: shared folders, intermediate tables, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\x0b\x0c\r"
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing (a local session, as in tests) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-brinewave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/brinewave/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no earlier stage, and what was drawn once stays.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Let no more than BATCH_ROWS whole texts travel to a Python worker at once; what the session has below that stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return memory that is free to the system: Spark uses a Python worker again for other stages, beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def n_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows whose count is above a cut-off, at most limit of them and as many as classes of like counts allow.

    The cut-off comes from a histogram of some hundred classes, so no task and not the driver sorts the rows.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 16)
    total, cut = 0, None
    for r in sorted(df.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += r["count"]
        if total > limit:
            break
        cut = r.step
    return df.where(F.lit(False) if cut is None else step >= cut)


def portions(texts: pa.Array, size: int = 500_000) -> Iterator[list[str | None]]:
    """Consecutive texts of about so many bytes together, as Python strings, so that a batch of long texts is never held twice."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        start = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, start + size, side="right")))
        yield texts.slice(at, end - at).to_pylist()
        at = end
