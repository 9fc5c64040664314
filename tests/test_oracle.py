"""Every registered query against its DuckDB SQL on the smoke tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from psephos.plans.registry import QUERIES
from scripts.check_oracle import TABLES, rows_of
from tests.conftest import SF_SMOKE

NAMES = sorted(QUERIES)  # the reports; the optional operators have tests of their own


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    return c


def test_every_query_has_oracle_sql():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "turnout" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMOKE)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(df.columns, s_rows, False) == rows_of(d_cols, d_rows, False)


@pytest.mark.parametrize("name", NAMES)
def test_oracle_sql_makes_a_view(con, name):
    con.sql(oracle_sql()[name]).create_view(f"o_{name}")
    assert con.sql(f"SELECT count(*) FROM o_{name}").fetchall()[0][0] > 0


@pytest.mark.parametrize("name", ["seat_summary", "tcp_comparison", "senate_quotas_candidate"])
def test_shuffle_join_plans_give_the_same_answer(spark, con, name):
    """With broadcasts off (the plans a large input gets) results are unchanged."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries()[name](spark, SF_SMOKE)
        s_rows = [tuple(r) for r in df.collect()]
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    res = con.execute(oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    assert rows_of(df.columns, s_rows, False) == rows_of(d_cols, res.fetchall(), False)
    assert "BroadcastExchange" not in plan


def test_oracle_column_types_match_spark(spark, con):
    norm = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER"}
    for name, fn in QUERIES.items():
        spark_types = {n: norm.get(t, t) for n, t in fn(spark, SF_SMOKE).dtypes}
        rel = con.sql(oracle_sql()[name])
        duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
        assert spark_types == duck_types, name
