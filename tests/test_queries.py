"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quillspan.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    cell = lambda v: "null" if v is None or v != v else f"{v:.5f}" if isinstance(v, (float, np.floating)) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_row_order_does_not_matter(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        df.orderBy(df.columns[0], ascending=False).repartition(7).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stratified_draw", "evidence_spans", "tier_spread_sample"):
        assert rows(QUERIES[name](spark, SF).toPandas()) == rows(QUERIES[name](spark, str(tmp_path)).toPandas())
