"""Mixing sources to target weights.

Each row gets a random key from a hash of its id. Within a source, rows are
sorted by that key in 4,096 key ranges; sums of the ranges give each range its
offset, a window inside the range the rest: a prefix sum over the whole source
that no single task holds. The source's word budget then cuts that order
exactly. A budget above the source's size repeats whole epochs first.

Nulls: a null source is a source of its own, sorted last; a null text has no
words. Repeated rows share a key; equal ones are interchangeable. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, durable, n_words

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"


def source_targets(sums: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(src, source_size) -> (src, source_size, target): weights shared out under caps.

    ``src`` sorts as the sources do. A target is min(cap, level x weight) at the one
    level where all targets add up to all sizes; the level follows from running sums
    over the sources sorted by cap / weight. One row per source, so one task is enough.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "src")
    t = sums.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(epochs))
    t = t.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("all_words", F.sum("source_size").over(everything))
    capped_before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("all_words") - capped_before) / weight_left)
    first_free = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True)
    t = t.withColumn("level", first_free.over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("src", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs``.

    ``taken``: words the mix takes of the row, repeats counted; a source's sum is its
    target, rounded down. Columns named in ``keep`` come along.
    """
    src = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))  # null last
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), src.alias("src"), key.alias("mix_key"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    ).withColumn("span", F.substring("mix_key", 1, 3))
    rows = durable(rows)  # texts are read once; the sums and the windows read this narrow table
    spans = rows.groupBy("src", "span").agg(F.sum("size").alias("span_size"))
    in_order = Window.partitionBy("src").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("offset", F.coalesce(F.sum("span_size").over(in_order), F.lit(0)))
    targets = source_targets(spans.groupBy("src").agg(F.sum("span_size").alias("source_size")), weights, epochs)
    spans = spans.join(targets, "src").select("src", "span", "offset", "source_size", "target")
    within = Window.partitionBy("src", "span").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(spans, ["src", "span"])
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("whole") * F.col("source_size")
    before = F.col("offset") + F.col("upto") - F.col("size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return rows.withColumn("whole", whole).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + cut).cast("long").alias("taken"),
        *[F.col(f"kept_{c}").alias(c) for c in keep],
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


QUERIES = {"op5_mixing": op5_mixing}

ORACLES = {
    "op5_mixing": rf"""
WITH r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('0' || source, '1') AS src,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM r GROUP BY src),
a AS (SELECT *, (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT AS t,
        [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS w FROM s),
b AS (SELECT *, cap / w AS ratio FROM a),
c AS (SELECT *, (t - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
d AS (SELECT src, source_size, least(cap, coalesce(
        (SELECT arg_min(level, ratio) FROM c WHERE level <= ratio) * w, cap)) AS target FROM c),
e AS (SELECT r.*, d.source_size, d.target, floor(d.target)::BIGINT AS budget,
        (sum(size) OVER (PARTITION BY r.src ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
      FROM r JOIN d USING (src)),
f AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM e)
SELECT doc_id, source, size, source_size, target,
  (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken
FROM f""",
}
