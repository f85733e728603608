"""Queries over a table in a folder: written, reopened, compacted, repaired, and logs replayed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import Batch
from ..sources import record_log
from ..sources.table import KVTable
from . import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS = 3
SMALL_OUTPUT = 4096


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one in a local session only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return f"{shared.rstrip('/')}/table-{uuid.uuid4().hex}"


def _written(spark: SparkSession, d: str, **options) -> KVTable:
    """The event log in a table, written in parts in its order."""
    table = KVTable.open(spark, _folder(spark), create_if_missing=True, **options)
    log = logs.events(spark, d)
    n = logs.last_sequence(log)
    rows = log.select(F.floor((F.col("seq") - 1) / 8).alias("batch_id"), ((F.col("seq") - 1) % 8).alias("pos"), "op", F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v"), "seq")
    for i in range(PARTS):
        table.write(rows.where((F.col("seq") > n * i // PARTS) & (F.col("seq") <= n * (i + 1) // PARTS)).drop("seq"))
    return table


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast("string").alias(c) if c in ("k", "v") else F.col(c).cast("long").alias(c) for c in rows.columns])


@query("SELECT k, v FROM live1")
def table_scan(spark, d):
    """Written in parts, closed, opened again, scanned."""
    table = _written(spark, d)
    table.close()
    with KVTable.open(spark, table.folder.path) as again:
        return _text(again.scan())


@query("SELECT k, seq, op, v FROM l1")
def table_versions(spark, d):
    with _written(spark, d) as table:
        return _text(table.versions())


@query("SELECT k, seq, op, v FROM live1")
def table_compacted(spark, d):
    """One version of each live key is left, in several outputs."""
    with _written(spark, d, output_bytes=SMALL_OUTPUT) as table:
        table.compact()
        return _text(table.versions())


@query(", x AS (SELECT l1.*, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rk FROM l1, n1 WHERE seq <= n // 3) SELECT k, v FROM x WHERE rk = 1 AND op = 1")
def table_compacted_under_snapshot(spark, d):
    """Reads at a snapshot taken after the first part, from what compaction kept for it."""
    table = KVTable.open(spark, _folder(spark), create_if_missing=True)
    log = logs.events(spark, d)
    n = logs.last_sequence(log)
    rows = log.select(F.col("seq").alias("batch_id"), F.lit(0).alias("pos"), "op", F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v"))
    table.write(rows.where(F.col("batch_id") <= n // 3))
    handle = table.snapshot()
    table.write(rows.where(F.col("batch_id") > n // 3))
    table.compact()
    out = _text(table.scan(snapshot=handle))
    table.close()
    return out


@query("SELECT n AS last_seq, n // 3 AS pinned, n // 3 AS oldest_held, n AS oldest_released FROM n1")
def table_snapshot_release(spark, d):
    with _written(spark, d) as table:
        n = table.state["last_seq"]
        table.state["snapshots"]["old"] = n // 3
        held = table.oldest()
        table.release("old")
        return spark.createDataFrame([(n, n // 3, held, table.oldest())], "last_seq long, pinned long, oldest_held long, oldest_released long")


@query("SELECT count(*)::BIGINT AS entries, sum(strlen(k) + 8 + strlen(v))::BIGINT AS bytes, true AS split, 0::BIGINT AS shared_keys, true AS sorted FROM live1")
def table_outputs(spark, d):
    """Outputs of a compaction: all entries, more than one file, no key in two, each file in order."""
    with _written(spark, d, output_bytes=SMALL_OUTPUT) as table:
        table.compact()
        files = table.state["files"]
        ranges = sorted((f["smallest"], f["largest"]) for f in files)
        shared = sum(a[1] >= b[0] for a, b in zip(ranges, ranges[1:]))
        rows = table._scan(files).select("k", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
        falls = rows.withColumn("before", F.expr("lag(k) OVER (PARTITION BY file ORDER BY at)")).where("before > k").count()
        return spark.createDataFrame([(sum(f["entries"] for f in files), sum(f["file_size"] for f in files), len(files) > 1, shared, falls == 0)], "entries long, bytes long, split boolean, shared_keys long, sorted boolean")


@query("SELECT k, v FROM live1")
def table_maintained(spark, d):
    """Many small parts, then compactions by score until none is due: the same reads."""
    table = KVTable.open(spark, _folder(spark), create_if_missing=True)
    log = logs.events(spark, d)
    n = logs.last_sequence(log)
    rows = log.select(F.col("seq").alias("batch_id"), F.lit(0).alias("pos"), "op", F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v"))
    for i in range(6):
        table.write(rows.where((F.col("batch_id") > n * i // 6) & (F.col("batch_id") <= n * (i + 1) // 6)))
    while table.maintain():
        pass
    out = _text(table.scan())
    table.close()
    return out


@query("SELECT k, v FROM live1")
def table_repaired(spark, d):
    """The manifest is lost; the runs alone give the table."""
    table = _written(spark, d)
    for name in table.folder.names():
        if name in ("CURRENT", "LOCK") or name.startswith("MANIFEST-"):
            table.folder.delete(name)
    with KVTable.repair(spark, table.folder.path) as again:
        return _text(again.scan())


@query("SELECT true AS before, false AS after")
def table_destroyed(spark, d):
    table = _written(spark, d)
    before = table.folder.exists("CURRENT")
    table.close()
    KVTable.destroy(spark, table.folder.path)
    return spark.createDataFrame([(before, table.folder.exists())], "before boolean, after boolean")


@query("SELECT k, CASE WHEN op = 1 THEN 'FOUND' ELSE 'DELETED' END AS state, v FROM r1 UNION ALL SELECT k || 'x', 'ABSENT', NULL FROM r1")
def table_get_many(spark, d):
    with _written(spark, d) as table:
        k = logs.events(spark, d).select("k").distinct()
        asked = k.union(k.select(F.concat("k", F.lit("x")))).select(F.col("k").cast("binary").alias("k"))
        return table.get_many(asked).select(F.col("k").cast("string").alias("k"), "state", F.col("v").cast("string").alias("v"))


@query("SELECT 0 AS last_seq, 0 AS rows, true AS absent")
def table_empty(spark, d):
    with KVTable.open(spark, _folder(spark), create_if_missing=True) as table:
        return spark.createDataFrame([(table.state["last_seq"], table.scan().count(), table.get(b"x") is None)], "last_seq int, rows int, absent boolean")


@query("SELECT k, seq, op, v FROM l1")
def log_replay(spark, d):
    """Batches of the event log as record logs, one for each 50 batches, read and decoded again."""
    n = F.col("seq") - 1
    path = _folder(spark)
    record_log.write_logs(logs.events(spark, d).select(F.floor(n / 400).alias("log_no"), F.floor(n / 8).alias("batch_id"), "seq", "op", "k", "v"), path)
    return _text(record_log.replay(spark, path, names="part-*"))


@query("SELECT count(*)::BIGINT AS records, (12 * count(*))::BIGINT AS header_bytes, 0::BIGINT AS dropped, max(b)::BIGINT AS last_batch FROM (SELECT (seq - 1) // 8 AS b FROM l1 GROUP BY 1)")
def log_records(spark, d):
    """Records of one log by their places; the last begins at the largest offset."""
    path = f"{_folder(spark)}/000001.log"
    record_log.write_log(logs.events(spark, d).select(F.lit(1).alias("log_no"), F.floor((F.col("seq") - 1) / 8).alias("batch_id"), "seq", "op", "k", "v"), path)
    rows = record_log.read_log(spark, path)
    seq = sum(F.conv(F.hex(F.substring("record", i + 1, 1)), 16, 10).cast("long") * (1 << 8 * i) for i in range(4))
    return rows.agg(F.count("record").alias("records"), F.sum(F.lit(12)).cast("long").alias("header_bytes"), F.coalesce(F.sum("dropped"), F.lit(0)).cast("long").alias("dropped"), F.max_by((seq - 1) / 8, "at").cast("long").alias("last_batch"))


@query("SELECT name, text FROM (VALUES ('clear', '0 12'), ('append', '3 25')) t(name, text)")
def batch_append_clear(spark, d):
    """Number of entries and size of batches put together and cleared."""
    a = Batch().put(b"a", b"1").append(Batch().delete(b"bb").put(b"c", b"22"))
    b = Batch().put(b"a", b"1")
    b.clear()
    return spark.createDataFrame([("append", f"{len(a)} {a.size()}"), ("clear", f"{len(b)} {b.size()}")], "name string, text string")


@query("SELECT i AS level, (CASE WHEN i = 2 THEN 1 ELSE 0 END)::BIGINT AS files FROM (SELECT unnest(range(0, 7)) AS i)")
def table_properties(spark, d):
    """Files at each level by property, after one write into an empty table: it sinks as deep as it may."""
    table = KVTable.open(spark, _folder(spark), create_if_missing=True)
    log = logs.events(spark, d)
    table.write(log.select(F.col("seq").alias("batch_id"), F.lit(0).alias("pos"), "op", F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v")))
    from ..operators import stats

    rows = [(n, int(table.property(f"{stats.PREFIX}num-files-at-level{n}"))) for n in range(7)]
    table.close()
    return spark.createDataFrame(rows, "level long, files long")
