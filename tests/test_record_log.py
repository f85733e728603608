"""Record logs: fragments, damage, offsets, batches, replay."""

import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.batches import Batch
from tidelog.operators.resolve import live
from tidelog.schema import Corruption
from tidelog.sources import record_log as log
from tidelog.sources.table import KVTable


def written(records):
    w = log.Writer()
    for r in records:
        w.append(r)
    return bytes(w.out)


def records(data, offset=0):
    return [x[1] for x in log.scan(data, offset) if x[1] is not None]


def drops(data):
    return [(x[2], x[3]) for x in log.scan(data) if x[1] is None]


@pytest.mark.parametrize("sizes", [[0, 3, 1000], [50_000, 97_270, 8000], [log.BLOCK - 2 * log.HEADER, 0, 4], [log.BLOCK - 2 * log.HEADER + 4, 9], [log.BLOCK - log.HEADER, 100_000]])
def test_round_trip(sizes):
    rng = random.Random(1)
    rs = [rng.randbytes(n) for n in sizes]
    assert records(written(rs)) == rs and drops(written(rs)) == []


def test_append_to_an_existing_log():
    a = written([b"x" * 40_000])
    w = log.Writer(len(a))
    w.append(b"more")
    assert records(a + bytes(w.out)) == [b"x" * 40_000, b"more"]


def test_torn_ends_are_silent():
    data = written([b"foo", b"bar" * 20_000])
    for cut in (1, 5, 100, 30_000):
        assert records(data[:-cut]) == [b"foo"] and drops(data[:-cut]) == []
    assert records(b"") == [] and records(data[:4]) == []


def damaged(data, at, value):
    return data[:at] + bytes([value]) + data[at + 1 :]


def test_damage_is_dropped_and_reported():
    data = written([b"a" * 10, b"b" * 10, b"c" * log.BLOCK, b"d"])
    bad = damaged(data, log.HEADER + 2, 0)
    assert drops(bad)[0] == ("bytes and checksum differ", log.BLOCK) and records(bad) == [b"d"]
    long = damaged(data, 5, 255)
    assert drops(long)[0][0] == "longer than its block" and records(long) == [b"d"]

    def fragment(kind, body):
        return log._sum(kind, body).to_bytes(4, "little") + len(body).to_bytes(2, "little") + bytes([kind]) + body

    assert drops(fragment(9, b"xyz")) == [("of no known kind", 3)]
    assert drops(fragment(log.MIDDLE, b"foo")) == [("goes on what never began", 3)] and drops(fragment(log.LAST, b"foo")) == [("goes on what never began", 3)]
    both = fragment(log.FIRST, b"foo") + fragment(log.FULL, b"bar")
    assert drops(both) == [("begun and never finished", 3)] and records(both) == [b"bar"]
    assert drops(fragment(log.FIRST, b"foo")) == []


def test_reading_from_an_offset():
    rs = [bytes([65 + i]) * n for i, n in enumerate((10_000, 10_000, 2 * log.BLOCK, 1, 13_716))]
    data = written(rs)
    starts = [at for at, *_ in log.scan(data)]
    for i, at in enumerate(starts):
        assert records(data, at) == rs[i:] and records(data, at + 1) == rs[i + 1 :]


def test_batches_in_bytes():
    b = Batch().put(b"foo", b"bar").delete(b"box").put(b"", b"x" * 300)
    data = log.encode_batch(b, 100)
    assert log.decode_batch(data)[0] == 100 and log.decode_batch(data)[1].ops == b.ops
    for bad in (data[:-1], data[:11], data + b"\x07", damaged(data, 8, 4), damaged(data, 12, 9)):
        with pytest.raises(Corruption):
            log.decode_batch(bad)


def test_replay_of_a_folder(spark, tmp_path):
    (tmp_path / "000003.log").write_bytes(log.log_bytes([(1, Batch().put(b"a", b"1").put(b"b", b"2")), (3, Batch().delete(b"a"))]))
    second = log.log_bytes([(4, Batch().put(b"c", b"3")), (5, Batch().put(b"d", b"y" * 40_000)), (6, Batch().put(b"e", b"5"))])
    (tmp_path / "000004.log").write_bytes(second[:-3])
    (tmp_path / "LOCK").write_bytes(b"x")
    got = {bytes(r["k"]): bytes(r["v"])[:1] for r in live(log.replay(spark, str(tmp_path))).collect()}
    assert got == {b"b": b"2", b"c": b"3", b"d": b"y"}
    (tmp_path / "000005.log").write_bytes(damaged(second, 9, 77))
    assert log.read(spark, str(tmp_path)).where("reason IS NOT NULL").count() >= 1
    with pytest.raises(Exception, match="bytes and checksum differ"):
        log.replay(spark, str(tmp_path), paranoid=True).collect()


def test_repair_without_a_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    with KVTable.open(spark, path, create_if_missing=True) as t:
        t.write(Batch().put(b"a", b"1").put(b"b", b"2"))
        t.delete(b"a")
        for name in ("CURRENT", f"MANIFEST-{t.state['version']:06d}"):
            t.folder.delete(name)
    with KVTable.repair(spark, path) as t:
        assert t.get(b"a") is None and t.get(b"b") == b"2" and t.state["last_seq"] == 3
    with KVTable.open(spark, path) as t:
        assert t.get(b"b") == b"2"


def rows_of_logs(spark, n):
    rows = spark.range(n).select(F.floor(F.col("id") / 40).alias("log_no"), F.floor(F.col("id") / 8).alias("batch_id"), (F.col("id") + 1).alias("seq"), F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("op"), F.format_string("k%d", F.col("id") % 30).alias("k"))
    return rows.withColumn("v", F.when(F.col("op") == 1, F.repeat(F.lit("v\0\xff"), (F.col("seq") % 50).cast("int"))))


def test_tasks_write_logs_that_replay(spark, tmp_path, monkeypatch):
    rows = rows_of_logs(spark, 1000).where("seq NOT IN (5, 90)")  # a sequence may have gaps
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    log.write_logs(rows, str(tmp_path / "logs"))
    assert len(list((tmp_path / "logs").glob("part-*"))) == 25
    got = log.replay(spark, str(tmp_path / "logs"), paranoid=True, names="part-*").select(F.col("k").cast("string"), "seq", F.col("op").cast("int"), F.col("v").cast("string"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(map(tuple, rows.select("k", "seq", "op", "v").collect()), key=lambda r: r[1])


def test_tasks_write_one_log_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "PART_BYTES", 10_000)
    path = str(tmp_path / "1.log")
    log.write_log(rows_of_logs(spark, 4000).withColumn("log_no", F.lit(1)).repartition(3), path)
    got = sorted(log.read_log(spark, path).collect(), key=lambda r: r["at"])
    assert [log.decode_batch(bytes(r["record"]))[0] for r in got] == list(range(1, 4001, 8)) and all(r["dropped"] is None for r in got)
    parts = sorted(p.read_bytes() for p in (tmp_path / "1.log").glob("part-*"))
    assert len(parts) > 1 and all(len(p) % log.BLOCK == 0 for p in parts) and len({r["at"] for r in got}) == 500


def test_sums_of_many_records_are_made_together(monkeypatch):
    calls, plain = [], log.crc32c_values
    monkeypatch.setattr(log, "crc32c_values", lambda values: calls.append(1) or plain(values))
    rs = [b"x" * (i % 90) for i in range(2000)]
    assert records(log.log_bytes((i, Batch().put(b"k", r)) for i, r in enumerate(rs))) == [log.encode_batch(Batch().put(b"k", r), i) for i, r in enumerate(rs)]
    assert len(calls) < 40
