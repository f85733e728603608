"""Statistics of files and levels, size estimates, properties, seek budgets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LEVELS

# Bytes read that pay for one wasted seek, and the least budget.
SEEK_BYTES = 16384
LEAST_SEEKS = 100
PREFIX = "tidelog."


def encoded_size(k: Column, v: Column) -> Column:
    """Bytes of an entry: key, its 8-byte tag, value."""
    return F.octet_length(k) + F.lit(8) + F.coalesce(F.octet_length(v), F.lit(0))


def file_table(entries: DataFrame) -> DataFrame:
    """One row for each (level, file_no) of entries that carry them."""
    return entries.groupBy("level", "file_no").agg(
        F.min("k").alias("smallest"), F.max("k").alias("largest"), F.count("*").alias("entries"),
        F.sum(encoded_size(F.col("k"), F.col("v"))).cast("long").alias("file_size"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )


def find_file(files: DataFrame, level: int, probes: DataFrame) -> DataFrame:
    """(probe, file_no): first file of a disjoint level whose largest key is >= the probe; null past the end."""
    f = files.where(F.col("level") == level)
    best = probes.join(f, F.col("largest") >= F.col("probe"), "left").groupBy("probe").agg(F.min_by("file_no", "largest").alias("file_no"))
    return best


def level_summary(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files and bytes of all levels, zero where there are none."""
    levels = spark.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    per = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    return levels.join(per, "level", "left").select(F.col("level").cast("long").alias("level"), F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def max_next_overlap(files: DataFrame) -> DataFrame:
    """Most bytes of the next level that one file of levels 1 and deeper overlaps."""
    a = files.where("level >= 1").select(F.col("level").alias("l"), F.col("file_no").alias("f"), F.col("smallest").alias("a"), F.col("largest").alias("b"))
    met = a.join(files, (F.col("level") == F.col("l") + 1) & (F.col("smallest") <= F.col("b")) & (F.col("largest") >= F.col("a")))
    return met.groupBy("l", "f").agg(F.sum("file_size").alias("bytes")).agg(F.coalesce(F.max("bytes"), F.lit(0)).cast("long").alias("bytes"))


def approximate_sizes(entries: DataFrame, ranges: list[tuple]) -> DataFrame:
    """(begin, end, bytes) of entries in each half-open range: one pass, one aggregate for each."""
    size = encoded_size(F.col("k"), F.col("v"))
    row = entries.agg(*[F.sum(F.when((F.col("k") >= F.lit(a)) & (F.col("k") < F.lit(b)), size)).alias(f"r{i}") for i, (a, b) in enumerate(ranges)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("begin"), F.lit(b).alias("end"), F.coalesce(F.col(f"r{i}"), F.lit(0)).cast("long").alias("bytes")) for i, (a, b) in enumerate(ranges)])).alias("r")).select("r.*")


def file_offset(entries: DataFrame, key) -> DataFrame:
    """(file_no, before): bytes of each file's entries below the key."""
    size = F.when(F.col("k") < F.lit(key), encoded_size(F.col("k"), F.col("v"))).otherwise(0)
    return entries.groupBy("file_no").agg(F.sum(size).cast("long").alias("before"))


def approximate_offset(files: DataFrame, key) -> DataFrame:
    """Bytes of files that end before the key, and of those that hold it: where an offset lies between."""
    k = F.lit(key)
    before = F.sum(F.when(F.col("largest") < k, F.col("file_size")).otherwise(0))
    inside = F.sum(F.when((F.col("smallest") <= k) & (F.col("largest") >= k), F.col("file_size")).otherwise(0))
    return files.agg(before.cast("long").alias("least"), (before + inside).cast("long").alias("most"))


def seek_budget(files: DataFrame) -> DataFrame:
    """Lookups a file may waste before it is worth compacting."""
    return files.withColumn("allowed_seeks", F.greatest(F.lit(LEAST_SEEKS), F.floor(F.col("file_size") / SEEK_BYTES)).cast("long"))


def exhausted(files: DataFrame, charges: DataFrame) -> DataFrame:
    """Files whose charges (file_no) have used up their budget."""
    used = charges.groupBy("file_no").agg(F.count("*").alias("used"))
    return seek_budget(files).join(used, "file_no").where("used >= allowed_seeks")


def property_of(spark: SparkSession, files: DataFrame, name: str):
    """Value of a property, or None if there is no such property."""
    if not name.startswith(PREFIX):
        return None
    name = name[len(PREFIX) :]
    if m := re.fullmatch(r"num-files-at-level(\d+)", name):
        level = int(m[1])
        return str(files.where(F.col("level") == level).count()) if level < LEVELS else None
    if name == "sstables":
        rows = files.orderBy("level", "smallest", "file_no").collect()  # one for each file
        return "".join(f"{r['level']} {r['file_no']}:{r['file_size']}[{r['smallest']!r} .. {r['largest']!r}]\n" for r in rows)
    if name == "stats":
        return "".join(f"{r['level']} {r['files']} {r['bytes']}\n" for r in level_summary(spark, files).orderBy("level").collect() if r["files"])
    if name == "approximate-memory-usage":
        return str(sum(x.memSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo()))
    return None
