"""Invariants of the log model on small cases and on random logs against a dict."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import batches, bloom, compact, ordered, reads
from tidelog.operators.resolve import live, merge_runs, resolve
from tidelog.schema import Corruption, problems

LOG = "k string, seq long, op long, v string"


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG)


def state(rows, s):
    out = {}
    for k, seq, op, v in sorted(rows, key=lambda r: r[1]):
        if seq <= s:
            out.pop(k, None) if op == 0 else out.__setitem__(k, v)
    return out


def as_dict(df):
    return {r["k"]: r["v"] for r in df.collect()}


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(1)
    keys = ["", "a", "aa", "b", "c\0", "z", "é"]
    return [(k := rng.choice(keys), s, op := int(rng.random() > 0.4), f"v{s}" if op else None) for s in range(1, 81)]


def test_reads_equal_model(spark, random_rows):
    log = log_of(spark, random_rows)
    for s in (0, 1, 20, 50, 80):
        assert as_dict(live(log, s)) == state(random_rows, s)


def test_golden_cases(spark):
    log = log_of(spark, [("a", 1, 1, "v1"), ("a", 2, 1, "v2"), ("d", 3, 1, "x"), ("d", 4, 0, None), ("e", 5, 1, ""), ("m", 6, 0, None)])
    assert as_dict(live(log)) == {"a": "v2", "e": ""}
    assert as_dict(live(log, 1)) == {"a": "v1"} and as_dict(live(log, 3))["d"] == "x" and as_dict(live(log, 0)) == {}
    wanted = spark.createDataFrame([("a",), ("d",), ("q",)], "k string")
    assert {r["k"]: r["state"] for r in reads.three_state(log, wanted).collect()} == {"a": "FOUND", "d": "DELETED", "q": "ABSENT"}
    assert {r["k"] for r in reads.misses(log, wanted).collect()} == {"d", "q"}
    assert as_dict(reads.hits(log, wanted)) == {"a": "v2"}


def test_tombstone_filter_stands_above_resolution(spark):
    log = log_of(spark, [("a", 1, 1, "x"), ("a", 2, 0, None)])
    assert live(log).count() == 0 and log.where("op = 1").count() == 1


def test_seek_and_neighbours(spark):
    log = log_of(spark, [("a", 1, 1, "x"), ("b", 2, 1, "x"), ("c", 3, 1, "x"), ("b", 4, 0, None)])
    ge = {r["probe"]: r["k"] for r in reads.seek(live(log), ["", "ax", "c", "d"]).collect()}
    assert ge == {"": "a", "ax": "c", "c": "c", "d": None}
    lt = {r["probe"]: r["k"] for r in reads.seek(live(log), ["a", "c", "zz"], forward=False).collect()}
    assert lt == {"a": None, "c": "a", "zz": "c"}
    around = {r["k"]: (r["prev_k"], r["next_k"]) for r in reads.neighbours(live(log).select("k")).collect()}
    assert around == {"a": (None, "c"), "c": ("a", None)}


def test_neighbours_and_numbers_over_many_ranges(spark):
    df = spark.range(0, 1000, 3, 7).select(F.col("id").alias("k")).orderBy(F.rand(3))
    got = sorted((r["k"], r["prev_k"], r["next_k"]) for r in ordered.neighbours(df).collect())
    ks = list(range(0, 1000, 3))
    assert got == list(zip(ks, [None, *ks[:-1]], [*ks[1:], None]))
    assert sorted((r["k"], r["n"]) for r in ordered.numbered(df, ["k"], base=5).collect()) == [(k, i + 5) for i, k in enumerate(ks)]
    assert sorted((r["k"], r["s"]) for r in ordered.running(df, ["k"], "k", "s").collect()) == list(zip(ks, np.cumsum(ks).tolist()))


def test_as_of_and_difference(spark, random_rows):
    log = log_of(spark, random_rows)
    probes = spark.createDataFrame([(k, s) for k in ("a", "z", "none") for s in (0, 10, 40, 80)], "k string, s long")
    for r in reads.as_of(log, probes).collect():
        assert r["seen_v"] == state(random_rows, r["s"]).get(r["k"])
    old, new = state(random_rows, 30), state(random_rows, 70)
    changes = {r["k"]: r["change"] for r in reads.difference(log, 30, 70).collect()}
    assert {k for k, c in changes.items() if c == "ADDED"} == set(new) - set(old)
    assert {k for k, c in changes.items() if c == "REMOVED"} == set(old) - set(new)
    assert {k for k, c in changes.items() if c == "CHANGED"} == {k for k in old if k in new and old[k] != new[k]}


def test_compaction_keeps_all_reads_from_oldest(spark, random_rows):
    log = log_of(spark, random_rows)
    for oldest in (0, 25, 60, 80):
        small = compact.compact(log, oldest)
        assert small.count() <= log.count()
        for s in (oldest, 70, 80):
            if s >= oldest:
                assert as_dict(live(small, s)) == state(random_rows, s)


def test_rule_b_keeps_tombstones_above_deeper_ranges(spark):
    log = log_of(spark, [("b", 5, 0, None), ("m", 6, 0, None), ("x", 7, 1, "v")])
    deeper = spark.createDataFrame([("a", "c"), ("k", "l")], "smallest string, largest string")
    assert {r["k"] for r in compact.compact(log, 10, deeper).collect()} == {"b", "x"}
    assert {r["k"] for r in compact.compact(log, 5, deeper).collect()} == {"b", "m", "x"}


def test_boundary_inputs_follow_the_chain(spark):
    schema = "file_no long, smallest string, smallest_seq long, largest string, largest_seq long"
    files = spark.createDataFrame([(1, "100", 3, "100", 2), (2, "100", 1, "200", 3), (3, "200", 2, "300", 1), (4, "400", 1, "500", 1)], schema)
    got = compact.boundary_inputs(files, files.where("file_no = 1"))
    assert {r["file_no"] for r in got.collect()} == {1, 2, 3}


def test_overlap_and_closure(spark):
    files = spark.createDataFrame([(0, i, a, b, 10) for i, (a, b) in enumerate([("150", "200"), ("200", "250"), ("300", "350"), ("400", "450")])], "level long, file_no long, smallest string, largest string, file_size long")
    ask = spark.createDataFrame([(0, "100", "149"), (1, "251", "299"), (2, "375", "400"), (3, None, "149"), (4, None, "150"), (5, "451", None), (6, "450", None)], "range_id long, begin string, end string")
    assert {r["range_id"] for r in compact.overlapping(files, ask).collect()} == {2, 4, 6}
    assert compact.closure(files, "210", "220") == [0, 1]
    assert compact.closure(files, None, "149") == []
    assert compact.is_trivial_move(1, 0, 0) and not compact.is_trivial_move(1, 1, 0) and not compact.is_trivial_move(1, 0, 10**9)


def test_batches(spark):
    b = batches.Batch().put(b"foo", b"bar").delete(b"box").put(b"baz", b"boo")
    rows = b.rows(spark, 100).collect()
    assert [(bytes(r["k"]), r["seq"], r["op"]) for r in rows] == [(b"foo", 100, 1), (b"box", 101, 0), (b"baz", 102, 1)]
    assert len(b.append(batches.Batch().put(b"x", b""))) == 4 and b.size() > 12
    with pytest.raises(Corruption):
        batches.check_ops([(7, b"k", None)])
    wrong = spark.createDataFrame([(1, [(1, "a", "x")], 2)], "batch_id long, ops array<struct<op:long,k:string,v:string>>, count int")
    with pytest.raises(Exception, match="wrong number"):
        batches.expand(wrong).collect()
    assert batches.group_writers([(100, False), (100, False), (100, True), (200_000, True), (900_000, False)]) == [[0, 1], [2], [3], [4]]
    assert batches.group_writers([(200_000, True), (800_000, True), (100_000, True)]) == [[0, 1], [2]]


def test_model_problems_are_named(spark):
    log = spark.createDataFrame([(None, 1, 1, "v"), ("a", -1, 1, "v"), ("a", 1, 2, "v"), ("a", 2, 1, None), ("a", 3, 1, "v")], LOG)
    assert problems(log).count() == 4


def test_merge_keeps_duplicates(spark):
    a = log_of(spark, [("a", 1, 1, "x")])
    assert merge_runs([a, a]).count() == 2 and resolve(merge_runs([a, a])).count() == 1


def test_checksum_and_hash_vectors():
    # fixed values: published test vectors of CRC-32C
    assert [hex(x) for x in codec.crc32c_values([b"\0" * 32, b"\xff" * 32, bytes(range(32)), bytes(range(31, -1, -1))])] == ["0x8a9136aa", "0x62a8ab43", "0x46dd794e", "0x113fdb5c"]
    assert codec.crc32c_values([b"hello world"])[0] == codec.crc32c_values([b"world"], codec.crc32c_values([b"hello "])[0])[0]

    def plain(b, seed):
        m, h = codec.HASH_MULTIPLIER, (seed ^ (len(b) * codec.HASH_MULTIPLIER)) & 0xFFFFFFFF
        for i in range(0, len(b) - 3, 4):
            h = (h + int.from_bytes(b[i : i + 4], "little")) * m & 0xFFFFFFFF
            h ^= h >> 16
        if tail := b[len(b) // 4 * 4 :]:
            h = (h + int.from_bytes(tail, "little")) * m & 0xFFFFFFFF
            h ^= h >> 24
        return h

    values = [bytes(range(n, 2 * n)) for n in range(40)]
    assert codec.hash_values(values).tolist() == [plain(v, codec.BLOOM_SEED) for v in values]


def test_bloom_filter():
    keys = [f"key{i}".encode() for i in range(5000)]
    f = bloom.create(keys)
    assert bloom.may_contain(f, keys).all()
    assert bloom.may_contain(f, [f"other{i}".encode() for i in range(10_000)]).mean() < 0.02
    assert not bloom.may_contain(bloom.create([]), [b"x"]).any() and not bloom.may_contain(b"", [b"x"]).any() and bloom.may_contain(b"\0\0\x1f", [b"x"]).all()


def test_separators():
    assert codec.shortest_separator(b"abcdef", b"abzz") == b"abd" and codec.shortest_separator(b"foo", b"foobar") == b"foo"
    assert codec.shortest_separator(b"abc1", b"abc2xx") == b"abc1" and codec.short_successor(b"\xff\x01a") == b"\xff\x02" and codec.short_successor(b"\xff\xff") == b"\xff\xff"
    assert reads.prefix_end(b"a\xff") == b"b" and reads.prefix_end(b"\xff") is None


def test_codecs_round_trip(spark):
    ns = [0, 1, 127, 128, 300, 2**32, 2**56 - 1]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    for r in df.select("n", codec.varint(F.col("n")).alias("b"), codec.varint_length(F.col("n")).alias("size"), codec.fixed_le(F.col("n"), 8).alias("f")).collect():
        assert len(r["b"]) == r["size"] and int.from_bytes(r["f"], "little") == r["n"]
    back = df.select("n", codec.varint_value(codec.varint(F.col("n"))).alias("m"), codec.unmask_crc(codec.mask_crc(F.col("n").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("c")).collect()
    assert all(r["n"] == r["m"] and r["c"] == r["n"] & 0xFFFFFFFF for r in back)


def test_comparators(spark):
    rows = [("[10]", 1, 1, "a"), ("[0xa]", 2, 1, "b"), ("[20]", 3, 1, "c"), ("[0x14]", 4, 0, None)]
    log = log_of(spark, rows).withColumn("sk", reads.sort_key("numeric", F.col("k")))
    assert {(r["sk"], r["v"]) for r in live(log, keys=["sk"]).collect()} == {(10, "b")}


def test_key_predicates_reach_the_files(spark):
    from tidelog.plans import logs

    def plan_of(df):
        return df._jdf.queryExecution().executedPlan().toString()

    plan = plan_of(live(logs.pages(spark, "/root/testdata/sf0.001")).where(F.col("k") == "x"))
    assert "EqualTo(url,x)" in plan and "WindowGroupLimit" in plan
    assert "props" not in plan_of(live(logs.events(spark, "/root/testdata/sf0.001")).select("k"))


def chain_of_files(spark, n, loose=()):
    """Files of which each goes on with the last key of the one before, but for those in ``loose``."""
    rows = [(i, f"k{i:04d}", 1 if i not in loose else 9, f"k{i + 1:04d}", 5) for i in range(n)]
    return spark.createDataFrame(rows, "file_no long, smallest string, smallest_seq long, largest string, largest_seq long")


def test_boundary_inputs_of_a_long_chain_take_one_round(spark, monkeypatch):
    files, rounds, chained = chain_of_files(spark, 60, loose=(7, 50)), [], compact._chained
    monkeypatch.setattr(compact, "_chained", lambda *args: rounds.append(1) or chained(*args))
    got = compact.boundary_inputs(files, files.where("file_no IN (3, 20)"))
    assert {r["file_no"] for r in got.collect()} == {*range(3, 7), *range(20, 50)}
    assert got.columns == files.columns and len(rounds) == 1


def test_boundary_inputs_where_files_overlap(spark):
    rows = [(1, "a", 9, "m", 5), (2, "b", 9, "c", 5), (3, "c", 4, "n", 3), (4, "m", 4, "p", 2), (5, "n", 1, "q", 1), (6, "x", 1, "z", 1)]
    files = spark.createDataFrame(rows, "file_no long, smallest string, smallest_seq long, largest string, largest_seq long")
    got = lambda *chosen: {r["file_no"] for r in compact.boundary_inputs(files, files.where(F.col("file_no").isin(*chosen))).collect()}
    assert got(1) == {1, 4} and got(2) == {2, 3, 5} and got(1, 2) == {1, 2, 3, 4, 5} and got(6) == {6}
