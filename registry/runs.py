"""Composed runs."""

from __future__ import annotations

import os
import uuid
from itertools import combinations

from pyspark.sql import functions as F

from registry.base import (
    DIRTY_SQL, PEOPLE_SQL, REG_SQL, dirty_orders, p_chi2, people, query, rd, reg_lines, rounded, table,
)
from registry.cleaning import CONFIG, STAGES
from registry.modelling import BP, CLOSED_FORM, MOMENTS
from registry.profiling import DETECTED, mask_sql
from registry.testing import _chi, _kw, _pairs_sql, _with_p, ranks_sql
from statloom.functions.frames import scratch_dir
from statloom.operators.groups import compare_groups, labelled
from statloom.plans import charts, full, general


@query("group_test_sentences", f"""
with k as (with {_kw('orders', [('o_orderpriority', 'o_totalprice'), ('o_orderpriority', 'o_custkey'), ('o_orderstatus', 'o_totalprice')])} select * from kw)
select category, variable, test_name, p_value < 0.05 as significant,
  printf('%s: %s difference in %s across %s groups (p=%.4f)', test_name, case when p_value < 0.05 then 'significant' else 'not significant' end,
  variable, category, p_value) as interpretation from k""")
def group_test_sentences(spark, sf):
    pairs = [("o_orderpriority", "o_totalprice"), ("o_orderpriority", "o_custkey"), ("o_orderstatus", "o_totalprice")]
    out = labelled(compare_groups(table(spark, sf, "orders"), "kruskal", pairs))
    return out.select("category", "variable", "test_name", "significant", "interpretation")


CUSTOMER = ["c_custkey", "c_nationkey", "c_acctbal"]


@query("general_tests", f"""
with c as (with {ranks_sql('customer', CUSTOMER)}, {_with_p(_pairs_sql('ranked', [('c_custkey', 'c_nationkey'), ('c_custkey', 'c_acctbal'), ('c_nationkey', 'c_acctbal')]))}
  select 'Spearman Correlation' as test_name, x as col_a, y as col_b, r as statistic, p_value, cast(n - 2 as double) as df, n from tested),
k as (with {_kw('customer', [('c_mktsegment', v) for v in CUSTOMER])}
  select test_name, category as col_a, variable as col_b, statistic, p_value, df, n from kw)
select test_name, col_a, col_b, {rd('statistic')} as statistic, {rd('p_value')} as p_value, df, n, p_value < 0.05 as significant
from (select * from c union all select * from k)""")
def general_tests(spark, sf):
    run = general.general_tests(table(spark, sf, "customer"))
    return rounded(run.test_results.select(
        "test_name", F.col("columns_tested")[0].alias("col_a"), F.col("columns_tested")[1].alias("col_b"),
        "statistic", "p_value", "df", "n", "significant"))


@query("general_totals", f"""
with c as (with {ranks_sql('orders', ['o_orderkey', 'o_custkey', 'o_totalprice'])}, {_with_p(_pairs_sql('ranked', list(combinations(['o_orderkey', 'o_custkey', 'o_totalprice'], 2))))}
  select p_value from tested),
k as (with {_kw('orders', [(g, v) for g in ('o_orderstatus', 'o_orderpriority') for v in ('o_orderkey', 'o_custkey', 'o_totalprice')])} select p_value from kw),
x as (with {_chi('orders', [('o_orderstatus', 'o_orderpriority')])} select p_value from chi)
select 'mixed' as classification, count(*) as total_tests_run, count(*) filter (p_value < 0.05) as significant_findings
from (select * from c union all select * from k union all select * from x)""")
def general_totals(spark, sf):
    return general.general_tests(table(spark, sf, "orders")).totals()


@query("findings_counts", """
select 'p_type' as variable, (select count(distinct p_type) from part) as n_unique, p_type as value, count(*) as n
from part group by p_type order by n desc, value limit 15""")
def findings_counts(spark, sf):
    found = general.findings(table(spark, sf, "part"))
    return found.category_counts.select("variable", "n_unique", "value", "n")


PLAN_COLS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "disc_price", "charge"]


@query("chart_plan", f"""
with {REG_SQL}, {_with_p(_pairs_sql('reg_lines', list(combinations(PLAN_COLS, 2))))},
top as (select x, y, row_number() over (order by abs(r) desc, x, y) as position from tested where abs(r) > 0.3 and p_value < 0.05)
select cast(position as integer) as position, 'scatter' as kind, x || ', ' || y as columns, 'Correlation: ' || x || ' vs ' || y as title
from top where position <= 3
union all select 4, 'histogram', '{", ".join(PLAN_COLS[:4])}', 'Distributions & Normality' from top where position = 1
union all select 5, 'qq', 'l_quantity', 'QQ Plot: l_quantity' from top where position = 1
union all select 6, 'heatmap', '{", ".join(PLAN_COLS)}', 'Correlation Matrix' from top where position = 1""")
def chart_plan(spark, sf):
    plan = charts.chart_plan(general.findings(reg_lines(spark, sf).drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), spark, charts.ONE_PAGE)
    return plan.withColumn("columns", F.concat_ws(", ", "columns"))


@query("full_run", f"""
with {PEOPLE_SQL}
select 'csv_people_' || substr(md5('people'), 1, 6) as db_name, 'people' as table_name,
       'id, name, email, phone, ref_a, ref_b, ref_c, contact, segment' as columns, 9 as column_count, count(*) as row_count,
       count(*) as total_rows, 'Auto-loaded as single table' as rationale from people""")
def full_run(spark, sf):
    """Profile, clean, mask, load, test and chart one table; its load manifest."""
    return full.analyse(people(spark, sf), load_as="people.csv", order_by=["id"]).manifest


@query("full_run_masked_file", f"with {PEOPLE_SQL} select id, "
       + ", ".join(f"{mask_sql(t, c)} as {c}" for c, t in DETECTED.items()) + ", segment from people")
def full_run_masked_file(spark, sf):
    """The masked file that the full run writes, read back."""
    folder = os.path.join(scratch_dir(spark), f"full-run-{uuid.uuid4().hex}")
    run = full.analyse(people(spark, sf), order_by=["id"], write_to=folder, name="people", chart_limits=charts.ONE_PAGE)
    return spark.read.parquet(run.files["masked"])


@query("full_run_cleaned_file", f"""with {STAGES} select o_orderkey, {rd('o_totalprice', 4)} as o_totalprice, o_orderpriority, o_orderstatus,
  custkey_text, orderdate_text from s6""")
def full_run_cleaned_file(spark, sf):
    """The cleaned file that the full run writes, read back."""
    folder = os.path.join(scratch_dir(spark), f"full-run-{uuid.uuid4().hex}")
    run = full.analyse(dirty_orders(spark, sf), "regression", CONFIG, target="o_totalprice", order_by=["o_orderkey"], write_to=folder, name="orders")
    return rounded(spark.read.parquet(run.files["cleaned"]), 4)


@query("full_regression_run", f"""
with {DIRTY_SQL}, rows as (select distinct o_orderkey, o_totalprice, custkey_text from dirty_orders),
middle as (select median(o_totalprice) as m from rows),
src as (select coalesce(o_totalprice, m) as y, o_orderkey as a, try_cast(custkey_text as bigint) as b from rows, middle
  where try_cast(custkey_text as bigint) is not null),
{CLOSED_FORM}, {MOMENTS}, {BP},
steps as (select e - lag(e) over (order by a) as d from res), dw as (select sum(d*d) / max(ssr) as dw from steps, rr)
select 'Durbin-Watson' as test, {rd('dw', 4)} as statistic, cast(null as double) as p_value,
  case when dw < 1.5 then 'positive autocorrelation' when dw <= 2.5 then 'no autocorrelation' else 'negative autocorrelation' end as verdict from dw
union all select 'Jarque-Bera', {rd('j', 4)}, {rd('exp(-j/2)', 4)}, case when exp(-j/2) > 0.05 then 'normal' else 'not normal' end from jb
union all select 'Breusch-Pagan', {rd('lm', 4)}, {rd(p_chi2('lm', 'k2'), 4)},
  case when {p_chi2('lm', 'k2')} > 0.05 then 'homoscedastic' else 'heteroscedastic' end from bp""")
def full_regression_run(spark, sf):
    run = full.analyse(dirty_orders(spark, sf).select("o_orderkey", "o_totalprice", "custkey_text", "o_orderstatus"), "regression",
                       {"convert_types": {"custkey_text": "int"}, "fill_nulls": {"custkey_text": "drop"}},
                       target="o_totalprice", order_by=["o_orderkey"])
    return rounded(run.regression.tables["residual_diagnostics"], 4)
