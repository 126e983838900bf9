import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and {"p1_found", "p2_found", "p3_found"} <= names


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == entry.entry(spark).columns


@pytest.mark.parametrize("name", ["flagship", "agg_mode", "pivot_with_static", "role_join", "column_profile", "spearman_pairs", "impute_median", "p2_found", "p2_profile", "p3_found", "p3_report"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")

    def plain(v):
        return repr(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = con.sql(entry.oracle_sql()[name])
    at = [sql.columns.index(c) for c in columns]
    assert sorted(sql.columns) == columns
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())
