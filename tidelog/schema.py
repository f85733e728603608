"""The log model: rows (k, seq, op, v), newest version of a key by the largest seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operation codes; their order matters among versions of equal seq.
DELETE, PUT = 0, 1
LEVELS = 7
MAX_SEQUENCE = (1 << 56) - 1

LOG = T.StructType([
    T.StructField("k", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.ByteType(), False),
    T.StructField("v", T.BinaryType(), True),
])


class InvalidArgument(ValueError):
    """A request that can't be right, whatever the data."""


class Corruption(ValueError):
    """Stored data that breaks the format."""


def problems(log: DataFrame) -> DataFrame:
    """Rows that break the model, each with a reason."""
    reason = (
        F.when(F.col("k").isNull(), "key is null")
        .when(F.col("seq").isNull() | (F.col("seq") < 0) | (F.col("seq") > MAX_SEQUENCE), "sequence out of range")
        .when(~F.col("op").isin(DELETE, PUT), "unknown operation")
        .when((F.col("op") == DELETE) != F.col("v").isNull(), "value and operation disagree")
    )
    return log.withColumn("reason", reason).where("reason IS NOT NULL")


def as_binary(c: Column) -> Column:
    return c.cast("binary")
