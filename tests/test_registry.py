import pytest

import __spark_entry__ as entry
from statloom.operators import correlation, groups
from tools.check import rows_of


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 110


def test_flagship(spark):
    got = entry.entry(spark)
    assert {"category", "variable", "test_name", "p_value"} <= set(got.columns) and got.count() > 0


@pytest.mark.parametrize("name", ["column_profile", "clean_run", "ols_coefficients", "chi_squared_two_by_two"])
def test_against_duckdb(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetch_df()
    assert rows_of(got) == rows_of(want)


def test_plans_keep_their_shape(spark, sf):
    """Only needed columns are read, pairs are pre-aggregated, nothing is gathered unsorted in one task."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = correlation.pearson(lines, [("l_tax", "l_discount")])._jdf.queryExecution().toString()
    assert "l_shipdate" not in plan.split("== Physical Plan ==")[1]
    plan = groups.group_moments(lines, ["l_returnflag"], ["l_tax"])._jdf.queryExecution().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan
