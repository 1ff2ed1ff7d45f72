"""A training-data pipeline over `documents`: quality rules, toxicity, near-duplicates, mixing, byte-level BPE.

Defined cases. Null, empty and blank texts fail the quality rules. Of rows equal in doc_id and text one is left after the
near-duplicates, and rows that only share a doc_id are judged each by its text; a row without doc_id goes through all
stages. Very long texts are judged and encoded whole. An empty table gives no rows in every stage. Extra columns go
through to the last stage but one; those named as a stage's own columns are replaced there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brinewave.llm import byte_bpe, near_dedup, quality_rules, source_mixing, toxicity
from brinewave.llm.common import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules.stage),
    ("toxicity", toxicity.stage),
    ("near_dedup", near_dedup.stage),
    ("source_mixing", source_mixing.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: Learned rules, scores and merges have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
