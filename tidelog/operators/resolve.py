"""Version resolution: the newest version of each key as of a sequence number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.codec import pack_tag, unpack_op
from ..schema import PUT


def at_snapshot(log: DataFrame, snapshot: int | Column | None) -> DataFrame:
    """Entries visible at a snapshot. Must stand below resolution: seq predicates don't move through it."""
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def resolve(log: DataFrame, snapshot: int | None = None, keys: Sequence[str] = ("k",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Newest entry of each key, tombstones included.

    The optimiser turns the filter on row_number into a per-key limit before and after
    the exchange, and pushes key predicates of the caller below it to the files.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return at_snapshot(log, snapshot).withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def live(log: DataFrame, snapshot: int | None = None, keys: Sequence[str] = ("k",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Newest puts. The tombstone test stands above resolution, or deleted keys would come back."""
    return resolve(log, snapshot, keys, order).where(F.col("op") == PUT)


def live_fixed_width(log: DataFrame, snapshot: int | None = None, keys: Sequence[str] = ("k",)) -> DataFrame:
    """As ``live``, for values of fixed width and unique (key, seq): hash aggregates, no sort."""
    newest = at_snapshot(log, snapshot).groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.max_by("v", "seq").alias("v"))
    return newest.where(F.col("op") == PUT)


def live_keys(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Keys with a live entry. The largest tag of a key names its newest entry: a hash aggregate, no sort, no values."""
    newest = at_snapshot(log, snapshot).groupBy("k").agg(F.max(pack_tag(F.col("seq"), F.col("op"))).alias("tag"))
    return newest.where(unpack_op(F.col("tag")) == PUT).select("k")


def merge_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """Bag union of runs; duplicates stay."""
    first, *rest = runs
    for r in rest:
        first = first.unionByName(r)
    return first
