"""Operators over a whole order, without a single task that holds it.

Rows are dealt by range once and kept (the range of a row must not change between the
passes). Each range works by itself; a table with one row for each range carries what
passes from one to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, Window.currentRow)


def dealt(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows by range of ``order``, with the range's number as ``_part``."""
    return df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)


def _parts(df: DataFrame, *aggs: Column) -> DataFrame:
    return df.groupBy("_part").agg(*aggs)


def neighbours(df: DataFrame, key: str = "k", before: str = "prev_k", after: str = "next_k") -> DataFrame:
    """Each row with the key before and after it; keys must be unique."""
    rows = dealt(df, [key])
    ranges = Window.orderBy("_part")
    edges = _parts(rows, F.min(key).alias("_low"), F.max(key).alias("_high"))
    edges = edges.select("_part", F.lag("_high").over(ranges).alias("_before"), F.lead("_low").over(ranges).alias("_after"))
    within = Window.partitionBy("_part").orderBy(key)
    rows = rows.withColumn(before, F.lag(key).over(within)).withColumn(after, F.lead(key).over(within))
    rows = rows.join(edges, "_part")
    return rows.withColumn(before, F.coalesce(before, "_before")).withColumn(after, F.coalesce(after, "_after")).drop("_part", "_before", "_after")


def numbered(df: DataFrame, order: Sequence[str], name: str = "n", base: int = 0, held: list[DataFrame] | None = None) -> DataFrame:
    """Consecutive numbers from ``base`` in the order of the columns, which must be unique together.

    ``held`` takes the rows that are kept, for a caller that lets go of them.
    """
    rows = dealt(df, order)
    if held is not None:
        held.append(rows)
    offsets = _parts(rows, F.count("*").alias("_count"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_count").over(Window.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_row", within).join(offsets, "_part").withColumn(name, (F.col("_offset") + F.col("_row") - 1 + base).cast("long")).drop("_part", "_row", "_offset")


def running(df: DataFrame, order: Sequence[str], value: str, name: str, how: str = "sum", inclusive: bool = True) -> DataFrame:
    """Running sum or maximum of ``value`` in the order of the columns."""
    f = {"sum": F.sum, "max": F.max}[how]
    rows = dealt(df, order)
    carried = _parts(rows, f(value).alias("_all"))
    carried = carried.select("_part", f("_all").over(Window.orderBy("_part").rowsBetween(*BEFORE)).alias("_carry"))
    within = f(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(*(UPTO if inclusive else BEFORE)))
    rows = rows.withColumn("_own", within).join(carried, "_part")
    both = F.coalesce("_own", F.lit(0)) + F.coalesce("_carry", F.lit(0)) if how == "sum" else F.greatest("_own", "_carry")
    return rows.withColumn(name, both).drop("_part", "_own", "_carry")


def cut(rows: DataFrame, key: str, size: str, each: int, name: str) -> DataFrame:
    """Rows dealt by ``key`` with the number of the stretch of ``each`` bytes that their key ends in; a key is in one."""
    carried = _parts(rows, F.sum(size).alias("_all"))
    carried = carried.select("_part", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0)).alias("_carry"))
    upto = F.sum(size).over(Window.partitionBy("_part").orderBy(key).rangeBetween(*UPTO))
    rows = rows.withColumn("_own", upto).join(carried, "_part")
    return rows.withColumn(name, F.floor((F.col("_carry") + F.col("_own") - 1) / F.lit(each)).cast("int")).drop("_part", "_own", "_carry")


def covered(points: DataFrame, ranges: DataFrame, key: str = "k") -> DataFrame:
    """Points with ``covered``: whether any range [smallest, largest] holds the key.

    One order of points and range starts; a point is covered if the largest end of all
    ranges that start at or before it isn't below it. No pairs are made.
    """
    starts = ranges.select(F.col("smallest").alias(key), F.lit(0).alias("_kind"), F.col("largest").alias("_end"))
    both = starts.unionByName(points.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    both = running(both, [key, "_kind"], "_end", "_reach", how="max")
    return both.where("_kind = 1").withColumn("covered", F.coalesce(F.col("_reach") >= F.col(key), F.lit(False))).drop("_kind", "_end", "_reach")
