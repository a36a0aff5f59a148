"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from lamella.plans import volume_queries
from lamella.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_queue_edits_of_a_long_queue(spark, tmp_path):
    path = str(tmp_path / "part.parquet")
    spark.range(10_050).selectExpr("id AS p_partkey", "'a' AS p_brand", "CAST(1 AS int) AS p_size").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view part as select * from read_parquet('{path}/*.parquet')")
    want = con.sql(ORACLE_SQL["queue_edits"]).fetchall()
    assert len(want) == 10_049 and sorted(tuple(r) for r in QUERIES["queue_edits"](spark, str(tmp_path)).collect()) == sorted(want)


@pytest.mark.parametrize("name", ["equidistant_round", "equidistant_trunc"])
def test_slices_are_counted_where_few_parts_are(spark, monkeypatch, name):
    monkeypatch.setattr(volume_queries, "TASK_SLICES", 500)
    counts = QUERIES[name](spark, SF).rdd.glom().map(lambda rows: (len(rows), len({r.p_partkey for r in rows}))).collect()
    parts = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey % 60 > 0").count()
    assert sum(p for _, p in counts) == parts  # each in one task
    assert max(n for n, _ in counts) < 1500 < sum(n for n, _ in counts)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
