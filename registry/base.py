"""Registration, table access, shared fixtures and SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under `name`, with the SQL that must agree."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; keyword arguments give other digits per column."""
    return df.withColumns({
        f.name: F.round(F.col(f.name), special.get(f.name, digits))
        for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)
    })


def rd(expr: str, digits: int = 6) -> str:
    """SQL rounding that never yields a negative zero."""
    return f"(case when round({expr}, {digits}) = 0 then cast(0 as double) else round({expr}, {digits}) end)"


# --- fixtures: the same rows from Spark and from DuckDB ---------------------

DIRTY = """select o_orderkey,
         case when o_orderkey % 17 = 0 then null else o_totalprice end as o_totalprice,
         case when o_orderkey % 23 = 0 then null else o_orderpriority end as o_orderpriority,
         case when o_orderkey % 3 = 0 then null else o_orderstatus end as o_orderstatus,
         case when o_orderkey % 11 = 0 then 'n/a' else cast(o_custkey as {text}) end as custkey_text,
         substr(cast(o_orderdate as {text}), 1, 10) as orderdate_text,
         cast(null as double) as empty_col
  from {orders}"""
DIRTY_SQL = (
    "dirty_base as (" + DIRTY.format(text="varchar", orders="orders") + "), "
    "dirty_orders as (select * from dirty_base union all select * from dirty_base where o_orderkey % 50 = 0)"
)


def dirty_orders(spark, sf) -> DataFrame:
    """Orders with nulls, an all-null column, numbers and dates kept as text, plus duplicate rows."""
    base = spark.sql(DIRTY.format(text="string", orders="{orders}"), orders=table(spark, sf, "orders"))
    return base.unionByName(base.where("o_orderkey % 50 = 0"))


PEOPLE = """select c_custkey as id,
       c_name as name,
       concat('user', cast(c_custkey as {text}), '@mail', cast(c_nationkey as {text}), '.example.com') as email,
       concat('555-', lpad(cast(c_custkey % 1000 as {text}), 3, '0'), '-', lpad(cast(c_custkey % 10000 as {text}), 4, '0')) as phone,
       concat('900-', lpad(cast(c_custkey % 100 as {text}), 2, '0'), '-', lpad(cast(c_custkey % 10000 as {text}), 4, '0')) as ref_a,
       concat('4000 0000 0000 ', lpad(cast(c_custkey % 10000 as {text}), 4, '0')) as ref_b,
       concat('10.0.', cast(c_nationkey as {text}), '.', cast(c_custkey % 250 as {text})) as ref_c,
       case when c_custkey % 2 = 0 then concat('mail me: u', cast(c_custkey as {text}), '@example.org') else 'none' end as contact,
       c_mktsegment as segment
from {customer}"""
PEOPLE_SQL = "people as (" + PEOPLE.format(text="varchar", customer="customer") + ")"


def people(spark, sf) -> DataFrame:
    return spark.sql(PEOPLE.format(text="string", customer="{customer}"), customer=table(spark, sf, "customer"))


REG_LINES = """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_quantity, l_discount, l_tax, l_extendedprice,
       l_extendedprice * (1 - l_discount) as disc_price,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge
from {lineitem}"""
REG_SQL = "reg_lines as (" + REG_LINES.format(lineitem="lineitem") + ")"


def reg_lines(spark, sf) -> DataFrame:
    return spark.sql(REG_LINES, lineitem=table(spark, sf, "lineitem"))


# --- distribution tails in SQL: Simpson's rule with 2000 steps ---------------

def simpson(f: str, upper: str) -> str:
    """Integral of f(h) for h from 0 to `upper`; f is an SQL expression in h."""
    return (
        f"(select sum((case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * ({f})) * ({upper}) / 6000 "
        f"from (select i, i * ({upper}) / 2000.0 as h from range(2001) r(i)))"
    )


def unit(p: str) -> str:
    return f"greatest(0.0, least(1.0, {p}))"


def p_t(t: str, df: str) -> str:
    upper = f"least(atan(abs({t}) / sqrt({df})), 14 / sqrt({df}))"
    area = simpson(f"pow(cos(h), ({df}) - 1)", upper)
    return unit(f"1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0) - lgamma(0.5)) * {area}")


def p_f(f: str, a: str, b: str) -> str:
    upper = f"least(asin(sqrt(({a}) * ({f}) / (({a}) * ({f}) + ({b})))), 40 / sqrt({b}))"
    area = simpson(f"pow(sin(h), ({a}) - 1) * pow(cos(h), ({b}) - 1)", upper)
    return unit(f"1 - 2 * exp(lgamma((({a}) + ({b})) / 2.0) - lgamma(({a}) / 2.0) - lgamma(({b}) / 2.0)) * {area}")


def p_chi2(x: str, k: str) -> str:
    area = simpson(f"pow(h, ({k}) - 1) * exp(-h * h / 2)", f"least(sqrt({x}), 40)")
    return unit(f"1 - 2 * exp(-(({k}) / 2.0) * ln(2.0) - lgamma(({k}) / 2.0)) * {area}")


def p_norm2(z: str) -> str:
    """Two-sided normal tail."""
    return unit(f"1 - sqrt(2 / pi()) * {simpson('exp(-h * h / 2)', f'least(abs({z}), 40)')}")


def norm_upper(z: str) -> str:
    """P(Z > z)."""
    half = f"(sqrt(1 / (2 * pi())) * {simpson('exp(-h * h / 2)', f'least(abs({z}), 40)')})"
    return unit(f"case when ({z}) >= 0 then 0.5 - {half} else 0.5 + {half} end")


def norm_ppf(p: str) -> str:
    """Normal quantile: published rational approximation, column `p` must be simple."""
    from statloom.functions.special import (
        PPF_CENTRAL_DEN, PPF_CENTRAL_NUM, PPF_FAR_DEN, PPF_FAR_NUM, PPF_NEAR_DEN, PPF_NEAR_NUM,
    )

    def poly(coefs, x):
        out = f"cast({coefs[-1]!r} as double)"
        for c in reversed(coefs[:-1]):
            out = f"({out} * ({x}) + cast({c!r} as double))"
        return out

    q = f"({p} - 0.5)"
    mid = f"(0.180625 - {q} * {q})"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (
        f"(case when abs{q} <= 0.425 then {q} * {poly(PPF_CENTRAL_NUM, mid)} / {poly(PPF_CENTRAL_DEN, mid)} "
        f"when {r} <= 5 then sign{q} * {poly(PPF_NEAR_NUM, f'{r} - 1.6')} / {poly(PPF_NEAR_DEN, f'{r} - 1.6')} "
        f"else sign{q} * {poly(PPF_FAR_NUM, f'{r} - 5')} / {poly(PPF_FAR_DEN, f'{r} - 5')} end)"
    )
