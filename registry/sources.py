"""Scans, sinks, table loads."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from registry.base import DIRTY_SQL, dirty_orders, people, query, rd, table
from statloom.functions.frames import cut, scratch_dir
from statloom.functions.missing import NA_TOKENS, normalise_missing
from statloom.sources import readers, writers


def _folder(spark, tag: str) -> str:
    return os.path.join(scratch_dir(spark), f"{tag}-{uuid.uuid4().hex}")


@query("csv_scan", """
select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer""")
def csv_scan(spark, sf):
    path = _folder(spark, "csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return readers.read_csv(spark, path)


TOKENS = ", ".join("'" + t + "'" for t in NA_TOKENS)


@query("csv_scan_with_gaps", f"""
with {DIRTY_SQL}
select o_orderkey, o_totalprice, o_orderpriority, o_orderstatus,
       try_cast(custkey_text as bigint) as custkey_text, orderdate_text, empty_col
from dirty_orders""")
def csv_scan_with_gaps(spark, sf):
    path = _folder(spark, "csv")
    dirty_orders(spark, sf).write.option("header", True).csv(path)
    return readers.read_csv(spark, path)


@query("csv_scan_split", f"""
select doc_id, case when text in ({TOKENS}) then null else text end as text, lang, n_chars from documents""")
def csv_scan_split(spark, sf):
    """Large files with quoted line breaks, each read in many ranges."""
    path = _folder(spark, "csv")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    docs.write.option("header", True).option("escape", '"').csv(path)
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        return cut(readers.read_csv(spark, path), "csv-ranges")
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


@query("na_tokens", f"""
with {DIRTY_SQL}
select o_orderkey, o_totalprice, o_orderpriority, o_orderstatus,
       case when custkey_text in ({TOKENS}) then null else custkey_text end as custkey_text, orderdate_text, empty_col
from dirty_orders""")
def na_tokens(spark, sf):
    return normalise_missing(dirty_orders(spark, sf))


@query("parquet_scan", """
select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipmonth from (
  select l_orderkey, l_linenumber, l_quantity, l_extendedprice, cast(month(l_shipdate) as integer) as l_shipmonth, l_discount
  from lineitem) where l_discount >= 0.05""")
def parquet_scan(spark, sf):
    return readers.read_parquet(spark, f"{sf}/lineitem.parquet").where("l_discount >= 0.05").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.month("l_shipdate").alias("l_shipmonth")
    )


@query("cleaned_sink", "select distinct o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def cleaned_sink(spark, sf):
    df = table(spark, sf, "orders").drop("o_orderdate").distinct()
    return spark.read.parquet(writers.write_cleaned(df, _folder(spark, "sink"), "orders"))


@query("masked_sink", """
select c_custkey as id, 'PERSON_' || substr(sha256(c_name), 1, 8) as name, c_mktsegment as segment from customer""")
def masked_sink(spark, sf):
    path = writers.write_masked(people(spark, sf).select("id", "name", "segment"), _folder(spark, "sink"), "people")
    return spark.read.parquet(path)


@query("table_load", """
select 'csv_sales_orders_' || substr(md5('sales orders'), 1, 6) as db_name, 'sales_orders' as table_name,
       'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' as columns, 6 as column_count,
       count(*) as row_count, count(*) as total_rows, 'Auto-loaded as single table' as rationale
from orders""")
def table_load(spark, sf):
    return writers.load_tables(table(spark, sf, "orders"), "Sales Orders.csv")


DESIGN = {
    "tables": [
        {"name": "Customers", "source_columns": ["o_custkey", "no_such_column"]},
        {"name": "2 statuses", "source_columns": ["o_orderstatus", "o_orderpriority"]},
        {"name": "everything"},
    ],
    "rationale": "customers repeat",
}


@query("designed_projection", "select distinct o_orderstatus, o_orderpriority from orders")
def designed_projection(spark, sf):
    return writers.designed_tables(table(spark, sf, "orders"), DESIGN, "orders")[1][1]


@query("load_manifest", """
with sizes as (
  select 1 as k, 'customers' as table_name, 'o_custkey' as columns, 1 as column_count, count(distinct o_custkey) as row_count from orders
  union all
  select 2, 't_2_statuses', 'o_orderstatus, o_orderpriority', 2, count(*) from (select distinct o_orderstatus, o_orderpriority from orders)
  union all
  select 3, 'everything', 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority', 6, count(*) from orders)
select 'csv_orders_' || substr(md5('orders'), 1, 6) as db_name, table_name, columns, column_count, row_count,
       cast(sum(row_count) over () as bigint) as total_rows, 'customers repeat' as rationale
from sizes""")
def load_manifest(spark, sf):
    return writers.plan_manifest(table(spark, sf, "orders"), "orders.csv", DESIGN)


@query("loaded_table", """
select o_custkey, count(*) as n, """ + rd("sum(o_totalprice)", 2) + """ as total from orders group by o_custkey""")
def loaded_table(spark, sf):
    manifest = writers.load_tables(table(spark, sf, "orders"), "order book.csv").first()
    loaded = spark.table(f"`{manifest['db_name']}`.`{manifest['table_name']}`")
    return loaded.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("safe_column_names", """
select o_orderkey as a_b, o_custkey as a_b_1, o_totalprice as a_b_2, o_orderstatus as "column" from orders""")
def safe_column_names(spark, sf):
    odd = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("a b"), F.col("o_custkey").alias("a_b"), F.col("o_totalprice").alias("a-b"),
        F.col("o_orderstatus").alias("%"))
    return writers.sanitise_columns(odd)
