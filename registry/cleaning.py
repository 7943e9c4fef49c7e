"""Cleaning-stage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import DIRTY_SQL, dirty_orders, query, rd, rounded, table
from statloom.operators import clean as cl

COLS = "o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, custkey_text, orderdate_text, empty_col"


@query("drop_duplicates", f"with {DIRTY_SQL} select distinct * from dirty_orders")
def drop_duplicates(spark, sf):
    return cl.drop_duplicates(dirty_orders(spark, sf))


@query("fill_drop", f"with {DIRTY_SQL} select * from dirty_orders where o_orderstatus is not null")
def fill_drop(spark, sf):
    return cl.drop_null_rows(dirty_orders(spark, sf), "o_orderstatus")


def _filled(column: str, value: str, digits: int | None = None) -> str:
    new = f"coalesce({column}, {value})"
    cols = COLS.replace(column, f"{rd(new, digits) if digits else new} as {column}")
    return f"with {DIRTY_SQL} select {cols} from dirty_orders"


@query("fill_mean", _filled("o_totalprice", "(select avg(o_totalprice) from dirty_orders)", 4))
def fill_mean(spark, sf):
    return rounded(cl.fill_mean(dirty_orders(spark, sf), "o_totalprice"), 4)


@query("fill_median", _filled("o_totalprice", "(select quantile_cont(o_totalprice, 0.5) from dirty_orders)", 4))
def fill_median(spark, sf):
    return rounded(cl.fill_median(dirty_orders(spark, sf), "o_totalprice"), 4)


def _mode(column: str, source: str = "dirty_orders") -> str:
    return (f"(select {column} from {source} where {column} is not null group by {column} "
            f"order by count(*) desc, {column} limit 1)")


@query("fill_mode", _filled("o_orderpriority", _mode("o_orderpriority")))
def fill_mode(spark, sf):
    return cl.fill_mode(dirty_orders(spark, sf), "o_orderpriority")


@query("fill_zero", _filled("o_totalprice", "0.0"))
def fill_zero(spark, sf):
    return cl.fill_zero(dirty_orders(spark, sf), "o_totalprice")


@query("fill_literal", _filled("o_orderstatus", "'?'"))
def fill_literal(spark, sf):
    return cl.fill_value(dirty_orders(spark, sf), "o_orderstatus", "?")


PRESENT = " + ".join(f"cast({c} is not null as integer)" for c in
                     ("o_totalprice", "o_orderpriority", "o_orderstatus", "empty_col"))


@query("drop_sparse_rows", f"""
with {DIRTY_SQL} select o_totalprice, o_orderpriority, o_orderstatus, empty_col from dirty_orders where {PRESENT} >= 2""")
def drop_sparse_rows(spark, sf):
    df = dirty_orders(spark, sf).select("o_totalprice", "o_orderpriority", "o_orderstatus", "empty_col")
    return cl.drop_sparse_rows(df)


@query("auto_fill_numeric", _filled("o_totalprice", "(select quantile_cont(o_totalprice, 0.5) from dirty_orders)", 4))
def auto_fill_numeric(spark, sf):
    return rounded(cl.auto_fill_numeric(dirty_orders(spark, sf))[0], 4)


@query("auto_fill_text", f"""
with {DIRTY_SQL} select o_orderkey, o_totalprice, coalesce(o_orderpriority, {_mode('o_orderpriority')}) as o_orderpriority,
  coalesce(o_orderstatus, {_mode('o_orderstatus')}) as o_orderstatus, custkey_text, orderdate_text, empty_col from dirty_orders""")
def auto_fill_text(spark, sf):
    return cl.auto_fill_text(dirty_orders(spark, sf))[0]


@query("convert_types", f"""
with {DIRTY_SQL} select cast(o_orderkey as varchar) as o_orderkey, try_cast(custkey_text as bigint) as custkey_text,
  try_cast(custkey_text as double) as custkey_float, strftime(try_cast(orderdate_text as timestamp), '%Y-%m-%d') as order_day
from dirty_orders""")
def convert_types(spark, sf):
    df = dirty_orders(spark, sf).select("o_orderkey", "custkey_text", F.col("custkey_text").alias("custkey_float"),
                                        F.col("orderdate_text").alias("order_day"))
    for name, target in (("o_orderkey", "str"), ("custkey_text", "int"), ("custkey_float", "float"), ("order_day", "datetime")):
        df = cl.convert_type(df, name, target)
    return df.withColumn("order_day", F.date_format("order_day", "yyyy-MM-dd"))


FENCED = """
with a_q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events),
a as (select e.event_id, e.user_id, e.value from events e, a_q where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)),
b_q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from a)
select a.event_id, a.user_id, a.value from a, b_q where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)"""


@query("remove_outliers", FENCED)
def remove_outliers(spark, sf):
    # the same column twice: the second fence comes from the survivors
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    return cl.remove_outliers(df, ["value", "value"])


@query("drop_empty_columns", f"""
with {DIRTY_SQL} select o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, custkey_text, orderdate_text from dirty_orders""")
def drop_empty_columns(spark, sf):
    return cl.drop_empty_columns(dirty_orders(spark, sf))


CONFIG = {
    "drop_duplicates": True,
    "fill_nulls": {"o_orderpriority": "mode"},
    "convert_types": {"custkey_text": "int"},
    "remove_outliers": ["o_totalprice"],
}
# The configured run, stage by stage.
STAGES = f"""{DIRTY_SQL},
s1 as (select distinct * from dirty_orders),
s2 as (select o_orderkey, o_totalprice, coalesce(o_orderpriority, {_mode('o_orderpriority', 's1')}) as o_orderpriority,
  o_orderstatus, custkey_text, orderdate_text, empty_col from s1),
s3 as (select * from s2 where cast(o_orderkey is not null as integer) + cast(o_totalprice is not null as integer)
  + cast(o_orderpriority is not null as integer) + cast(o_orderstatus is not null as integer)
  + cast(custkey_text is not null as integer) + cast(orderdate_text is not null as integer) >= 3),
s4 as (select o_orderkey, coalesce(o_totalprice, (select quantile_cont(o_totalprice, 0.5) from s3)) as o_totalprice,
  o_orderpriority, coalesce(o_orderstatus, {_mode('o_orderstatus', 's3')}) as o_orderstatus, custkey_text, orderdate_text from s3),
s5 as (select o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, try_cast(custkey_text as bigint) as custkey_text,
  orderdate_text from s4),
q as (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from s5),
s6 as (select s5.* from s5, q where o_totalprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))"""


@query("clean_run", f"""with {STAGES} select o_orderkey, {rd('o_totalprice', 4)} as o_totalprice, o_orderpriority, o_orderstatus,
  custkey_text, orderdate_text from s6""")
def clean_run(spark, sf):
    return rounded(cl.clean(dirty_orders(spark, sf), CONFIG).df, 4)


@query("cleaning_report", f"""with {STAGES}, n as (select (select count(*) from dirty_orders) as n0, (select count(*) from s1) as n1,
  (select count(*) from s3) as n3, (select count(*) from s6) as n6)
select step, stage, "column", action, rows_before, rows_after from n, lateral (values
  (1, 'input', null, 'read', n0, n0), (2, 'duplicates', null, 'dropped duplicate rows', n0, n1),
  (3, 'fill_nulls', 'o_orderpriority', 'mode', n1, n1),
  (4, 'sparse_rows', null, 'dropped rows with >50% null values', n1, n3),
  (5, 'auto_fill', 'o_totalprice', 'auto: median', n3, n3), (6, 'auto_fill', 'o_orderstatus', 'auto: mode', n3, n3),
  (7, 'convert_types', 'custkey_text', 'int', n3, n3),
  (8, 'outliers', 'o_totalprice', 'dropped rows outside 1.5 IQR', n3, n6),
  (9, 'empty_columns', 'empty_col', 'dropped column', n6, n6), (10, 'output', null, 'kept', n6, n6))
  v(step, stage, "column", action, rows_before, rows_after)""")
def cleaning_report(spark, sf):
    return cl.clean(dirty_orders(spark, sf), CONFIG).report


@query("cleaning_totals", f"""with {STAGES}
select (select count(*) from dirty_orders) as rows_before, (select count(*) from s6) as rows_after,
  (select count(*) from dirty_orders) - (select count(*) from s1) as duplicates_removed,
  (select count(*) from s5) - (select count(*) from s6) as outliers_removed,
  cast(3 as bigint) as nulls_filled, cast(1 as bigint) as type_conversions, cast(1 as bigint) as columns_dropped""")
def cleaning_totals(spark, sf):
    return cl.cleaning_totals(cl.clean(dirty_orders(spark, sf), CONFIG).report)
