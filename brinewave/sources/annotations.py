"""Interval annotations from text: sidecar files of one recording and summaries of many; JSON metadata; report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERVALS = "array<struct<s0:double,s1:double>>"


def sidecar(lines: DataFrame, *, keys: Sequence[str], text: str = "value") -> DataFrame:
    """(keys, s0, s1): the first two words of each line as numbers; lines with fewer words or other words are skipped."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    number = lambda k: F.get(words, F.lit(k)).try_cast("double")
    return lines.select(*keys, number(0).alias("s0"), number(1).alias("s1")).where("s0 is not null and s1 is not null")


# What the keys of a summary's `key: value` lines say.
FILE, EVENT, START, END = "file name", "seizure", "start time", "end time"


def block_of(content: Column, file_name: Column) -> Column:
    """array<struct<key, value>>: the `key: value` lines that a summary has for one file, up to the next file's; null without the file.

    Keys are in lower case. Each line is cut at its first colon; the file that a line belongs to is carried along.
    """
    lines = F.transform(F.filter(F.split(content, r"\r?\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    kind = "array<struct<key:string,value:string>>"
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("found"), F.array().cast(kind).alias("own"))
    step = lambda s, x: F.when(
        x["key"] == FILE, F.struct((~s["found"] & (x["value"] == file_name)).alias("on"), (s["found"] | (x["value"] == file_name)).alias("found"), s["own"].alias("own"))
    ).otherwise(F.when(s["on"], F.struct(s["on"].alias("on"), s["found"].alias("found"), F.array_append(s["own"], x).alias("own"))).otherwise(s))
    return F.aggregate(lines, start, step, lambda s: F.when(s["found"], s["own"]))


def summary_intervals(files: DataFrame, *, keys: Sequence[str], content: str = "content", file_name: str = "file_name") -> DataFrame:
    """(keys, seizure_no, s0, s1) from the blocks of summaries; starts and ends are paired in order, the longer list is cut."""
    said = lambda end: F.filter("__b", lambda x: F.startswith(x["key"], F.lit(EVENT)) & F.endswith(x["key"], F.lit(end)))
    times = lambda end: F.transform(said(end), lambda x: F.substring_index(x["value"], " ", 1).try_cast("double"))
    b = files.withColumn("__b", block_of(F.col(content), F.col(file_name))).where("__b is not null")
    both = b.select(*keys, F.posexplode(F.arrays_zip(times(START).alias("a"), times(END).alias("b"))).alias("seizure_no", "p"))
    out = both.select(*keys, "seizure_no", F.col("p.a").alias("s0"), F.col("p.b").alias("s1"))
    return out.where("s0 is not null and s1 is not null")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, s0, s1) of all *.seizure files under a path."""
    lines = spark.read.option("pathGlobFilter", "*.seizure").option("recursiveFileLookup", True).text(path)
    lines = lines.select("value", F.regexp_extract("_metadata.file_name", r"^(.*)\.seizure$", 1).alias("record_id"))
    return sidecar(lines, keys=["record_id"])


def read_summaries(spark: SparkSession, path: str, recordings: DataFrame) -> DataFrame:
    """(patient, record_id, seizure_no, s0, s1): recordings (patient, record_id) against each patient's summary file."""
    text = spark.read.option("wholetext", True).option("pathGlobFilter", "*-summary.txt").option("recursiveFileLookup", True).text(path)
    text = text.select(F.col("value").alias("content"), F.regexp_extract("_metadata.file_name", r"^(.*)-summary\.txt$", 1).alias("patient"))
    files = recordings.join(text, "patient").withColumn("file_name", F.concat("record_id", F.lit(".edf")))
    return summary_intervals(files, keys=["patient", "record_id"])


def with_default(value: Column, default: Column) -> Column:
    return F.coalesce(value, default)


def read_json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that hold one object each; files with a list or broken text are left out."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    named = text.select(F.trim(F.regexp_replace("value", r"^\s+", "")).alias("value"), F.col("_metadata.file_name").alias("file_name"))
    parsed = named.where(F.startswith("value", F.lit("{"))).withColumn("j", F.from_json("value", schema))
    return parsed.where("j is not null").select("file_name", "j.*")


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One CSV file with a header in the given order; null is empty. For reports, whose rows are few."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_processed(df: DataFrame, path: str) -> None:
    """Processed windows by patient; only the patients written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patient").parquet(path)


def discover_patients(files: DataFrame, models: Sequence[str], *, name: str = "file_name") -> DataFrame:
    """Patients named by result files, <model>_<patient>_loso.json or comparison_<patient>.json, each once."""
    loso = F.regexp_extract(name, rf"^(?:{'|'.join(models)})_(.+)_loso\.json$", 1)
    other = F.regexp_extract(name, r"^comparison_(.+)\.json$", 1)
    both = files.select(loso.alias("patient")).union(files.select(other.alias("patient")))
    return both.where("patient <> ''").distinct().orderBy("patient")


def patient_folders(files: DataFrame, *, path: str = "path") -> list[str]:
    """Names of the folders that hold recordings, sorted, one for each patient; an error if there are none."""
    names = files.select(F.element_at(F.split(path, "/"), -2).alias("patient")).distinct().orderBy("patient").collect()
    if not names:
        raise ValueError("no patient folders with recordings")
    return [r.patient for r in names]


def first_available(wanted: Sequence[str], available: DataFrame, *, name: str = "patient") -> str | None:
    """The first of the wanted names, in their order, that is available; without wanted names, the first of all; else None."""
    found = available.select(name).where(F.col(name).isNotNull()).distinct()
    if wanted:
        place = F.array_position(F.array(*map(F.lit, wanted)), F.col(name))
        found = found.where(place > 0).orderBy(place)
    else:
        found = found.orderBy(name)
    row = found.first()
    return row[0] if row else None
