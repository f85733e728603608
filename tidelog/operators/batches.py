"""Atomic batches: building, numbering, validation, grouping of writers, and admission."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DELETE, PUT, Corruption
from . import ordered

# Limits of a group of writers, and of files before writers are slowed.
GROUP_BYTES = 1 << 20
SMALL_BYTES = 128 << 10
SLOW_FILES, STOP_FILES = 8, 12
HEADER_BYTES = 12


class Batch:
    """An ordered list of puts and deletes that is applied as one."""

    def __init__(self, ops: Iterable[tuple] = ()):
        self.ops: list[tuple[int, bytes, bytes | None]] = list(ops)

    def put(self, k: bytes, v: bytes) -> "Batch":
        self.ops.append((PUT, bytes(k), bytes(v)))
        return self

    def delete(self, k: bytes) -> "Batch":
        self.ops.append((DELETE, bytes(k), None))
        return self

    def append(self, other: "Batch") -> "Batch":
        self.ops += other.ops
        return self

    def clear(self) -> None:
        self.ops.clear()

    def __len__(self) -> int:
        return len(self.ops)

    def size(self) -> int:
        """Approximate bytes in the log."""
        return HEADER_BYTES + sum(2 + len(k) + len(v or b"") for _, k, v in self.ops)

    def rows(self, spark: SparkSession, base: int) -> DataFrame:
        """Log rows numbered from ``base`` in order."""
        return spark.createDataFrame([(k, base + i, op, v) for i, (op, k, v) in enumerate(self.ops)], "k binary, seq long, op byte, v binary")


def expand(batches: DataFrame) -> DataFrame:
    """(batch_id, ops array<struct<op,k,v>>, count) -> one row for each op with its place; checks the declared count."""
    wrong = F.raise_error(F.concat(F.lit("batch has the wrong number of entries: "), F.col("batch_id").cast("string")))
    checked = batches.withColumn("ops", F.when(F.size("ops") == F.col("count"), F.col("ops")).otherwise(wrong))
    return checked.select("batch_id", F.posexplode("ops").alias("pos", "o")).select("batch_id", "pos", "o.op", "o.k", "o.v")


def check_ops(ops: Iterable[tuple]) -> None:
    for op, k, v in ops:
        if op not in (DELETE, PUT) or k is None or (v is None) != (op == DELETE):
            raise Corruption(f"bad batch entry {op!r}")


def number(ops: DataFrame, base: int, held: list[DataFrame] | None = None) -> DataFrame:
    """Consecutive seq from ``base`` by (batch_id, pos), over any number of rows."""
    return ordered.numbered(ops, ["batch_id", "pos"], "seq", base, held)


def last_in_batch(ops: DataFrame) -> DataFrame:
    """Of each key in a batch, the last op."""
    last = Window.partitionBy("batch_id", "k").orderBy(F.desc("pos"))
    return ops.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def group_writers(queue: Iterable[tuple[int, bool]]) -> list[list[int]]:
    """Which writers a leader takes along: (bytes, sync) in order of arrival -> groups of positions.

    A group ends at GROUP_BYTES, or for a small leader at its own size and SMALL_BYTES;
    a writer that asks for sync doesn't join a leader that doesn't.
    """
    groups: list[list[int]] = []
    total = limit = 0
    leader_sync = False
    for i, (size, sync) in enumerate(queue):
        if groups and total + size <= limit and (leader_sync or not sync):
            groups[-1].append(i)
            total += size
        else:
            groups.append([i])
            total, leader_sync = size, sync
            limit = size + SMALL_BYTES if size <= SMALL_BYTES else GROUP_BYTES
    return groups


def slowed(level0_files: Column) -> Column:
    """Whether a writer is held back once, for a moment, before it is admitted."""
    return level0_files >= SLOW_FILES


def admission(level0_files: Column, buffer_full: Column, flushing: Column) -> Column:
    """What a writer meets then: GO, WAIT for a flush, STOP for compaction, or ROTATE the full buffer."""
    return F.when(~buffer_full, "GO").when(flushing, "WAIT").when(level0_files >= STOP_FILES, "STOP").otherwise("ROTATE")
