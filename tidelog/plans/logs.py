"""Logs over the test tables: Spark DataFrames and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts and deletes of users' last event."""
    gone = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.lpad(F.col("user_id").cast("string"), 16, "0").alias("k"), (F.col("event_id") + 1).alias("seq"),
        F.when(gone, 0).otherwise(1).cast("long").alias("op"), F.when(~gone, F.col("props")).alias("v"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the lower layer, line items over them; newest by ORDER."""
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("layer"), F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("part"),
        F.lit(0).cast("long").alias("supp"), F.lit(0.0).alias("price"), F.lit(1).cast("long").alias("op"), F.col("o_orderpriority").alias("v"),
    )
    gone = F.col("l_returnflag") == "R"
    over = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.lit(1).cast("long").alias("layer"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").cast("long").alias("part"),
        F.col("l_suppkey").cast("long").alias("supp"), F.col("l_extendedprice").alias("price"), F.when(gone, 0).otherwise(1).cast("long").alias("op"),
        F.when(~gone, F.col("l_linestatus")).alias("v"),
    )
    return base.unionByName(over)


ORDER = ("layer", "line", "part", "supp", "price")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("role") == "system"
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("seq"), F.when(gone, 0).otherwise(1).cast("long").alias("op"), F.when(~gone, F.col("role")).alias("v"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("k"), (F.col("page_id") + 1).alias("seq"), F.lit(1).cast("long").alias("op"), F.length("html").cast("long").alias("v"))


def last_sequence(log: DataFrame) -> int:
    """The sequence a read without a snapshot is pinned to."""
    return log.agg(F.max("seq")).first()[0] or 0


def filed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The event log laid out in files: the newest half in overlapping level-0 runs, the rest by key below."""
    log = table(spark, sf_dir, "events")
    n = log.agg(F.max("event_id")).first()[0] + 1
    rows = events(spark, sf_dir).withColumn("user", F.col("k").cast("long"))
    level = F.when(F.col("seq") * 2 > n, 0).when(F.col("seq") * 4 > n, 1).otherwise(2).cast("long")
    rows = rows.withColumn("level", level)
    run = F.floor(F.col("seq") * 16 / F.lit(n + 1)).cast("long")
    file_no = F.when(F.col("level") == 0, run + 1000).otherwise(F.col("level") * 100000 + F.floor(F.col("user") / (F.lit(3) * F.col("level"))).cast("long"))
    return rows.withColumn("file_no", file_no).drop("user"), n


SQL = """
l1 AS (SELECT lpad(user_id::VARCHAR, 16, '0') AS k, event_id + 1 AS seq, (CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)::BIGINT AS op,
    CASE WHEN event_type <> 'error' THEN props END AS v FROM events),
n1 AS (SELECT max(seq)::BIGINT AS n FROM l1),
l2 AS (SELECT o_orderkey AS k, 0::BIGINT AS layer, 0::BIGINT AS line, 0::BIGINT AS part, 0::BIGINT AS supp, 0.0::DOUBLE AS price, 1::BIGINT AS op, o_orderpriority AS v FROM orders
    UNION ALL SELECT l_orderkey, 1, l_linenumber::BIGINT, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END,
    CASE WHEN l_returnflag <> 'R' THEN l_linestatus END FROM lineitem),
l3 AS (SELECT conv_id AS k, turn AS seq, (CASE WHEN role = 'system' THEN 0 ELSE 1 END)::BIGINT AS op, CASE WHEN role <> 'system' THEN role END AS v FROM conversations),
l4 AS (SELECT url AS k, page_id + 1 AS seq, 1::BIGINT AS op, length(html)::BIGINT AS v FROM pages),
r1 AS (SELECT * EXCLUDE rk FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rk FROM l1) WHERE rk = 1),
live1 AS (SELECT * FROM r1 WHERE op = 1),
e1 AS (SELECT l1.*, (CASE WHEN seq * 2 > n THEN 0 WHEN seq * 4 > n THEN 1 ELSE 2 END)::BIGINT AS level, n FROM l1, n1),
f1 AS (SELECT *, (CASE WHEN level = 0 THEN (seq * 16) // (n + 1) + 1000 ELSE level * 100000 + k::BIGINT // (3 * level) END)::BIGINT AS file_no FROM e1),
files AS (SELECT level, file_no, min(k) AS smallest, max(k) AS largest, count(*)::BIGINT AS entries, sum(strlen(k) + 8 + coalesce(strlen(v), 0))::BIGINT AS file_size,
    min(seq) AS min_seq, max(seq) AS max_seq FROM f1 GROUP BY level, file_no)
"""
