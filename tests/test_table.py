"""The table facade: opening, commits, snapshots, compaction, recovery, streaming."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators.batches import Batch
from tidelog.schema import Corruption, InvalidArgument
from tidelog.sources.table import KVTable
from tidelog.streaming import ingest


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / "t")


def pairs(df):
    return [(bytes(r["k"]), bytes(r["v"])) for r in df.collect()]


def test_open_flags_lock_and_destroy(spark, path):
    with pytest.raises(InvalidArgument):
        KVTable.open(spark, path)
    t = KVTable.open(spark, path, create_if_missing=True)
    with pytest.raises(InvalidArgument, match="lock"):
        KVTable.open(spark, path)
    t.close()
    with pytest.raises(InvalidArgument):
        KVTable.open(spark, path, error_if_exists=True)
    with pytest.raises(InvalidArgument, match="comparator"):
        KVTable.open(spark, path, comparator="reverse")
    with KVTable.open(spark, path) as t:
        assert pairs(t.scan()) == []
    KVTable.destroy(spark, path)
    KVTable.destroy(spark, path)
    with pytest.raises(InvalidArgument):
        KVTable.open(spark, path)


def test_reads_snapshots_and_reopen(spark, path):
    with KVTable.open(spark, path, create_if_missing=True) as t:
        t.write(Batch().put(b"a", b"1").put(b"b", b"").put(b"a", b"2").delete(b"zz").put(b"", b"empty"))
        assert t.get(b"a") == b"2" and t.get(b"b") == b"" and t.get(b"zz") is None and t.get(b"") == b"empty"
        pinned = t.snapshot()
        t.delete(b"a")
        t.put(b"ab", b"3")
        assert t.get(b"a") is None and t.get(b"a", pinned) == b"2"
        assert pairs(t.scan(prefix=b"a")) == [(b"ab", b"3")]
        assert [k for k, _ in pairs(t.scan(reverse=True))] == [b"b", b"ab", b""]
    with KVTable.open(spark, path) as t:
        assert t.get(b"a", pinned) == b"2" and t.state["last_seq"] == 7
        t.compact()
        assert t.get(b"a", pinned) == b"2" and t.get(b"a") is None
        t.release(pinned)
        t.compact()
        with pytest.raises(InvalidArgument):
            t.get(b"a", 2)
        assert t.property("tidelog.num-files-at-level9") is None and t.property("nope") is None
        assert t.approximate_sizes([(b"", b"b"), (b"b", b"c"), (b"x", b"y")])[2] == 0
        assert t.property("tidelog.stats").startswith("level files") and len(t.property("tidelog.sstables").splitlines()) == len(t.state["files"])
        assert sum(int(t.property(f"tidelog.num-files-at-level{i}")) for i in range(7)) == len(t.state["files"])
        assert int(t.property("tidelog.approximate-memory-usage")) >= 0
        kept = t.cache()
        assert kept.count() == 3
        kept.unpersist()
        t.view("kv")
        assert spark.sql("SELECT count(*) FROM kv").first()[0] == 3


def test_random_operations_equal_a_dict(spark, path):
    rng, model, held = random.Random(4), {}, {}
    with KVTable.open(spark, path, create_if_missing=True) as t:
        for step in range(12):
            b = Batch()
            for _ in range(rng.randint(1, 8)):
                k = bytes(rng.choices(b"ab\x00\xff", k=rng.randint(0, 2)))
                if rng.random() < 0.5:
                    b.put(k, v := str(step).encode())
                    model[k] = v
                else:
                    b.delete(k)
                    model.pop(k, None)
            t.write(b)
            if step % 5 == 2:
                held[t.snapshot()] = dict(model)
            if step % 4 == 3:
                t.maintain() or t.compact()
        assert dict(pairs(t.scan())) == model
        for handle, then in held.items():
            assert dict(pairs(t.scan(snapshot=handle))) == then


def test_recovery_finds_missing_runs_and_clears_orphans(spark, path):
    with KVTable.open(spark, path, create_if_missing=True) as t:
        t.put(b"a", b"1")
        name = t.state["files"][0]["name"]
        spark.range(1).write.parquet(f"{path}/runs/999999.run")
    with KVTable.open(spark, path) as t:  # a run that no manifest names is the trace of a failed commit
        assert t.folder.names("runs") == [name] and t.get(b"a") == b"1"
        t.folder.delete(f"runs/{name}")
    with pytest.raises(Corruption, match="missing"):
        KVTable.open(spark, path)


def test_failed_write_stays(spark, path):
    with KVTable.open(spark, path, create_if_missing=True) as t:
        t.put(b"a", b"1")
        bad = spark.range(1).select(F.lit(1).alias("batch_id"), F.lit(0).alias("pos"), F.lit(1).alias("op"), F.raise_error(F.lit("disk full")).cast("binary").alias("k"), F.lit(b"v").alias("v"))
        with pytest.raises(Exception, match="disk full"):
            t.write(bad)
        with pytest.raises(Exception, match="disk full"):
            t.put(b"b", b"2")
        assert t.get(b"a") == b"1"


def test_bulk_write_and_stream(spark, path, tmp_path):
    rows = spark.range(100).select(F.floor(F.col("id") / 10).alias("batch_id"), (F.col("id") % 10).alias("pos"), F.when(F.col("id") % 7 == 0, 0).otherwise(1).alias("op"), F.format_string("k%02d", F.col("id") % 20).cast("binary").alias("k"))
    rows = rows.withColumn("v", F.when(F.col("op") == 1, F.format_string("v%d", F.col("batch_id") * 10 + F.col("pos")).cast("binary")))
    model = {}
    for i in range(100):
        model.pop(b"k%02d" % (i % 20), None) if i % 7 == 0 else model.__setitem__(b"k%02d" % (i % 20), b"v%d" % i)
    with KVTable.open(spark, path, create_if_missing=True) as t:
        assert t.write(rows) == 100 and dict(pairs(t.scan())) == model
    source = str(tmp_path / "in")
    rows.repartition(1).write.parquet(source)
    with KVTable.open(spark, path + "2", create_if_missing=True) as t:
        for _ in range(2):  # the second start finds nothing new
            ingest.into_table(spark.readStream.schema(rows.schema).parquet(source), t, str(tmp_path / "cp")).awaitTermination()
        assert t.state["last_seq"] == 100 and dict(pairs(t.scan())) == model


def test_waiting_writers_share_commits(spark, path):
    with KVTable.open(spark, path, create_if_missing=True) as t:
        version = t.state["version"]
        queue = [(Batch().put(b"a", b"1"), False), (Batch().put(b"b", b"2").delete(b"a"), False), (Batch().put(b"c", b"3"), True)]
        assert t.write_all(queue) == [1, 3, 4] and t.state["version"] == version + 2
        assert dict(pairs(t.scan())) == {b"b": b"2", b"c": b"3"} and t.write_all([]) == []


def test_stream_state_equals_batch(spark, tmp_path):
    rows = [("a", 5, 1, "new"), ("b", 2, 1, "x"), ("a", 1, 1, "old"), ("b", 9, 0, None), ("c", 3, 1, "y"), ("b", 4, 1, "late")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k string, seq long, op long, v string").coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema("k string, seq long, op long, v string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in/*"))
    q = ingest.newest_versions(stream).writeStream.outputMode("update").format("memory").queryName("newest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = spark.sql("SELECT k, max_by(op, seq) AS op, max_by(v, seq) AS v FROM newest GROUP BY k").collect()
    assert {r["k"]: (r["op"], r["v"]) for r in got} == {"a": (1, "new"), "b": (0, None), "c": (1, "y")}


def test_a_lock_ends_with_its_lease(spark, path):
    old = KVTable.open(spark, path, create_if_missing=True, lease=-1)
    with KVTable.open(spark, path) as new:
        new.put(b"a", b"1")
        with pytest.raises(InvalidArgument, match="lock"):
            old.put(b"a", b"2")
        old.close()  # leaves the other's lock
        assert new.get(b"a") == b"1" and new.folder.exists("LOCK")


def test_outputs_are_split_and_picked_one_by_one(spark, path):
    rows = spark.range(400).select(F.col("id").alias("batch_id"), F.lit(0).alias("pos"), F.lit(1).alias("op"), F.format_string("k%03d", F.col("id")).cast("binary").alias("k"), F.lit(b"v" * 20).alias("v"))
    with KVTable.open(spark, path, create_if_missing=True, output_bytes=3000) as t:
        t.write(rows)
        t.write(rows)
        t.compact()
        files = sorted(t.state["files"], key=lambda f: f["smallest"])
        assert len(files) > 2 and all(a["largest"] < b["smallest"] for a, b in zip(files, files[1:]))
        names = {f["name"] for f in files}
        assert t.collect_garbage() == [] and t._runs_there() == names
        assert len(pairs(t.scan())) == 400 and t.get(b"k123") == b"v" * 20
    with KVTable.open(spark, path) as t:
        assert {f["name"] for f in t.state["files"]} == names and len(pairs(t.scan())) == 400


def test_a_failed_stream_batch_is_not_remembered(spark, path):
    bad = spark.range(1).select(F.lit(0).alias("batch_id"), F.lit(0).alias("pos"), F.lit(5).alias("op"), F.lit(b"k").alias("k"), F.lit(b"v").alias("v"))
    with KVTable.open(spark, path, create_if_missing=True) as t:
        with pytest.raises(Corruption):
            t.write(bad, stream_batch=3)
        t.put(b"a", b"1", sync=True)
        assert "stream_batch" not in t.state
        t.write(bad.limit(0), stream_batch=4)
        assert t.state["stream_batch"] == 4


def test_a_writer_waits_for_compaction_of_many_small_runs(spark, path, monkeypatch):
    from tidelog.sources import table as module

    monkeypatch.setattr(module, "STOP_FILES", 5)
    with KVTable.open(spark, path, create_if_missing=True) as t:
        for i in range(9):
            t.put(b"a", b"%d" % i)
        assert sum(f["level"] == 0 for f in t.state["files"]) <= 5 and t.get(b"a") == b"8"


def test_outputs_fit_what_is_left_and_their_filters_fit_their_keys(spark, path):
    rows = spark.range(8000).select(F.col("id").alias("batch_id"), F.lit(0).alias("pos"), F.lit(1).alias("op"), F.format_string("k%03d", F.col("id") % 400).cast("binary").alias("k"), F.lit(b"v" * 20).alias("v"))
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    with KVTable.open(spark, path, create_if_missing=True, output_bytes=3000) as t:
        t.write(rows)
        t.write(rows)
        t.compact()
        files = sorted(t.state["files"], key=lambda f: f["smallest"])
        assert len(files) == -(-400 * 32 // 3000)  # of the live entries, not of the 16,000 read
        assert all(a["largest"] < b["smallest"] for a, b in zip(files, files[1:])) and sum(f["entries"] for f in files) == 400
        assert sum(f["stored"] for f in files) < 40_000 and t.get(b"k123") == b"v" * 20
        assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept


def test_compaction_reaches_runs_that_nothing_overlaps(spark, path):
    with KVTable.open(spark, path, create_if_missing=True) as t:
        t.write(Batch().put(b"a", b"1").put(b"a", b"2").put(b"b", b"1").delete(b"b"))
        t.write(Batch().put(b"x", b"1").put(b"x", b"2"))
        held = t.snapshot()
        t.put(b"y", b"1")
        t.put(b"a", b"3")
        t.compact()
        assert t.get(b"a", held) == b"2" and t.get(b"a") == b"3" and t.get(b"b") is None
        t.release(held)
        t.compact()
        assert [(bytes(r["k"]), bytes(r["v"])) for r in t.versions().collect()] == [(b"a", b"3"), (b"x", b"2"), (b"y", b"1")]
        names = {f["name"] for f in t.state["files"]}
        t.compact()  # nothing is left to do
        assert {f["name"] for f in t.state["files"]} == names
