"""Each query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([bytes(r[i]) if isinstance(r[i], bytearray) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_query_equals_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [q for q in catalogue.QUERIES if q not in catalogue.ORACLES])
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert os.path.isdir(entry.SMOKE_DIR)


def written(tmp_path, **tables):
    """A folder with these tables, and DuckDB over it."""
    c = duckdb.connect()
    for name, sql in tables.items():
        c.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for name in TABLES:
        if name not in tables:
            c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return str(tmp_path), c


def assert_equal(spark, name, d, con):
    got, want = catalogue.QUERIES[name](spark, d), con.sql(catalogue.ORACLES[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
    return got


def test_pick_candidate_where_a_deeper_level_is_more_due(spark, tmp_path):
    d, con = written(tmp_path, events="SELECT i AS event_id, i % 1500 AS user_id, 'view' AS event_type, repeat('x', 4000) AS props FROM range(60000) t(i)")
    got = assert_equal(spark, "pick_candidate", d, con)
    assert got.first()["level"] == 0


def test_candidate_is_of_the_level_most_due(spark):
    from tidelog.operators import compact

    files = spark.createDataFrame([(0, n, 10, "a", "z") for n in range(8)] + [(1, n, 50 << 20, f"k{n}", f"k{n}") for n in (100, 101)], "level long, file_no long, file_size long, smallest string, largest string")
    pointers = spark.createDataFrame([(1, "k100")], "level long, pointer string")
    pick = lambda f: tuple(f.select("level", "file_no").first())
    assert pick(compact.candidate(files, pointers)) == (1, 101) and pick(compact.next_file(files.where("level = 0"), pointers)) == (0, 0)


def test_scan_prefix_of_a_key_with_several_versions(spark, tmp_path):
    d, con = written(tmp_path, pages="SELECT i AS page_id, 'http://t' || i % 3 AS url, repeat('h', i::INT) AS html FROM range(7) t(i)")
    assert assert_equal(spark, "scan_prefix", d, con).count() == 7


def test_a_scan_by_prefix_has_live_entries_only(spark):
    from tidelog.operators import reads

    log = spark.createDataFrame([("ta", 1, 1, "x"), ("ta", 2, 1, "y"), ("tb", 3, 1, "z"), ("tb", 4, 0, None), ("u", 5, 1, "w")], "k string, seq long, op long, v string")
    assert [tuple(r) for r in reads.scan(log, prefix="t").select("k", "v").collect()] == [("ta", "y")]
