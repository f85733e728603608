"""Folding the manifest's deltas: live files, files missing or no longer needed, counters.

Deltas are rows (delta_no, is_add, level, file_no, ...): one for each file added or removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replayed(deltas: DataFrame) -> DataFrame:
    """Files left after all deltas; in one delta removals come before additions."""
    newest = Window.partitionBy("level", "file_no").orderBy(F.desc("delta_no"), F.desc("is_add"))
    return deltas.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1 AND is_add = 1").drop("_rank", "is_add")


def missing(live: DataFrame, listing: DataFrame) -> DataFrame:
    """Live files that the folder doesn't have."""
    return live.select("file_no").join(listing, "file_no", "left_anti")


def obsolete(live: DataFrame, listing: DataFrame) -> DataFrame:
    """Files in the folder that nothing refers to."""
    return listing.join(live.select("file_no"), "file_no", "left_anti")


def counters(deltas: DataFrame, *names: str) -> DataFrame:
    """Each counter's newest set value; a null leaves it as it was."""
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("delta_no"))).alias(c) for c in names]
    return deltas.agg(*newest)


def full_record(files: DataFrame, delta_no: int) -> DataFrame:
    """One delta that holds the whole state: earlier ones are no longer needed."""
    return files.withColumn("delta_no", F.lit(delta_no).cast("long")).withColumn("is_add", F.lit(1).cast("long"))


DELTA = "delta_no long, is_add long, level long, file_no long"


def encoded(deltas: DataFrame) -> DataFrame:
    """(delta_no, record): a delta's files as one JSON record."""
    files = F.collect_list(F.struct("is_add", "level", "file_no"))
    return deltas.groupBy("delta_no").agg(F.to_json(F.struct(F.lit(1).alias("format"), files.alias("files"))).alias("record"))


def decoded(records: DataFrame) -> DataFrame:
    """Deltas from their records; one that isn't well formed is null, and raises."""
    kind = "struct<format:int,files:array<struct<is_add:bigint,level:bigint,file_no:bigint>>>"
    read = F.from_json("record", kind)
    bad = F.raise_error(F.concat(F.lit("bad delta: "), F.substring("record", 1, 80))).cast(kind)
    rows = records.withColumn("_r", F.when(read.isNotNull() & read["files"].isNotNull(), read).otherwise(bad))
    return rows.select("delta_no", F.explode("_r.files").alias("f")).select("delta_no", "f.*")
