"""Descriptive statistics, normality, correlation, group comparison, association."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from registry.base import (
    REG_SQL, norm_ppf, norm_upper, p_chi2, p_f, p_norm2, p_t, query, rd, reg_lines, rounded, table,
)
from registry.profiling import LINE_NUM
from statloom.operators import association, correlation, describe, groups, normality

# --- descriptives --------------------------------------------------------------


def _describe(source: str, c: str, group: str = "") -> str:
    x = f"cast({c} as double)"
    stats = [("mean", f"avg({x})"), ("median", f"quantile_cont({x}, 0.5)"), ("std", f"stddev_samp({x})"), ("min", f"min({x})"),
             ("max", f"max({x})"), ("skewness", f"skewness({x})"), ("kurtosis", f"kurtosis({x})")]
    head = f"{group}, " if group else ""
    return (f"select {head}'{c}' as variable, count({c}) as n, " + ", ".join(f"{rd(e, 4)} as {a}" for a, e in stats)
            + f" from {source}" + (f" group by {group}" if group else ""))


@query("descriptives", " union all ".join(_describe("lineitem", c) for c in LINE_NUM))
def descriptives(spark, sf):
    return rounded(describe.descriptives(table(spark, sf, "lineitem")), 4)


@query("descriptives_by_group", _describe("events", "value", "event_type"))
def descriptives_by_group(spark, sf):
    return rounded(describe.descriptives_by(table(spark, sf, "events"), "value", ["event_type"]), 4)


# --- normality -----------------------------------------------------------------

LAST = "0.221157 * u - 0.147981 * u*u - 2.071190 * u*u*u + 4.434685 * pow(u, 4) - 2.706056 * pow(u, 5)"
NEXT = "0.042981 * u - 0.293762 * u*u - 1.752461 * u*u*u + 5.682633 * pow(u, 4) - 3.582633 * pow(u, 5)"


def shapiro_sql(long: str) -> str:
    """CTEs that end in `sw(keys, n, statistic, z)` from rows (k, value) named `long`; 8 <= n < 5000."""
    return f"""
ordered as (select k, value, row_number() over (partition by k order by value) as i, count(*) over (partition by k) as n,
  value - avg(value) over (partition by k) as x from {long}),
placed as (select *, (i - 0.375) / (n + 0.25) as p from ordered),
scores as (select *, {norm_ppf('p')} as m from placed),
norms as (select k, n, sum(m * m) as mm, max(m) as m_n, 1 / sqrt(n) as u from scores group by k, n),
norms2 as (select s.k, max(s.m) as m_n1 from scores s where s.i = s.n - 1 group by s.k),
weights as (select norms.k, n, mm, m_n, m_n1, m_n / sqrt(mm) + {LAST} as a_n, m_n1 / sqrt(mm) + {NEXT} as a_n1
  from norms join norms2 using (k)),
weights2 as (select *, (mm - 2 * m_n * m_n - 2 * m_n1 * m_n1) / (1 - 2 * a_n * a_n - 2 * a_n1 * a_n1) as phi from weights),
terms as (select s.k, s.n, s.x, case when s.i = s.n then w.a_n when s.i = 1 then -w.a_n when s.i = s.n - 1 then w.a_n1
  when s.i = 2 then -w.a_n1 else s.m / sqrt(w.phi) end as a from scores s join weights2 w using (k)),
w_stat as (select k, n, pow(sum(a * x), 2) / sum(x * x) as statistic from terms group by k, n),
sw as (select k, n, statistic, case when n <= 11
  then (-ln(-2.273 + 0.459 * n - ln(1 - statistic)) - (0.5440 - 0.39978 * n + 0.025054 * n * n - 6.714e-4 * pow(n, 3)))
    / exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * pow(n, 3))
  else (ln(1 - statistic) - (-1.5861 - 0.31082 * ln(n) - 0.083751 * pow(ln(n), 2) + 0.0038915 * pow(ln(n), 3)))
    / exp(-0.4803 - 0.082676 * ln(n) + 0.0030302 * pow(ln(n), 2)) end as z from w_stat)"""


def omnibus_sql(long: str) -> str:
    """CTEs that end in `k2(k, n, statistic)` from rows (k, value) named `long`."""
    return f"""
centred as (select k, count(*) over (partition by k) as n, value - avg(value) over (partition by k) as x from {long}),
central as (select k, cast(n as double) as n, avg(x*x) as m2, avg(x*x*x) as m3, avg(pow(x, 4)) as m4 from centred group by k, n),
shape as (select k, n, m3 / pow(m2, 1.5) as g1, m4 / (m2 * m2) as b2 from central),
zs as (select k, n, g1, b2,
  g1 * sqrt((n+1)*(n+3)/(6*(n-2))) as y,
  -1 + sqrt(2 * (3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) - 1)) as w2,
  (b2 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) as xk,
  6*(n*n-5*n+2)/((n+7)*(n+9)) * sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) as bb from shape),
zs2 as (select *, asinh(y / sqrt(2/(w2-1))) / sqrt(0.5*ln(w2)) as z1, 6 + 8/bb*(2/bb + sqrt(1 + 4/(bb*bb))) as aa from zs),
zs3 as (select *, 1 + xk*sqrt(2/(aa-4)) as d from zs2),
k2 as (select k, cast(n as bigint) as n, pow(z1, 2) + pow((1 - 2/(9*aa) - sign(d)*pow((1-2/aa)/abs(d), 1/3.0)) / sqrt(2/(9*aa)), 2) as statistic from zs3)"""


SMALL = [("customer", "c_acctbal"), ("customer", "c_nationkey"), ("supplier", "s_acctbal"), ("part", "p_size"), ("part", "p_retailprice")]
SMALL_LONG = "small_long as (" + " union all ".join(
    f"select '{c}' as k, cast({c} as double) as value from {t}" for t, c in SMALL) + ")"


@query("shapiro_wilk", f"""
with {SMALL_LONG}, {shapiro_sql('small_long')}
select k as variable, n, 'Shapiro-Wilk' as test, {rd('statistic')} as statistic, {rd(norm_upper('z'))} as p_value from sw""")
def shapiro_wilk(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for t, c in SMALL]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return rounded(normality.shapiro(long, ["variable"]))


LARGE_LONG = """large_long as (select 'o_totalprice' as k, o_totalprice as value from orders
  union all select 'value', value from events union all select 'l_extendedprice', l_extendedprice from lineitem)"""


@query("omnibus_normality", f"""
with {LARGE_LONG}, {omnibus_sql('large_long')}
select k as variable, n, {rd('statistic / 1e3')} as statistic, {rd('exp(-statistic / 2)')} as p_value from k2""")
def omnibus_normality(spark, sf):
    parts = [describe.moments(table(spark, sf, t), [c]) for t, c in
             (("orders", "o_totalprice"), ("events", "value"), ("lineitem", "l_extendedprice"))]
    m = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = normality.omnibus(m, ["variable"]).drop("test").withColumn("statistic", F.col("statistic") / 1e3)
    return rounded(out)


@query("normality_of_columns", f"""
with small_long as (select 'p_size' as k, cast(p_size as double) as value from part
  union all select 'p_retailprice', p_retailprice from part),
{shapiro_sql('small_long')}
select k as variable, n, 'Shapiro-Wilk' as test, {rd('statistic')} as statistic, {rd(norm_upper('z'))} as p_value,
       {norm_upper('z')} > 0.05 as is_normal from sw
union all select 'empty', 0, 'skipped', null, null, false
""")
def normality_of_columns(spark, sf):
    df = table(spark, sf, "part").select("p_size", "p_retailprice", F.lit(None).cast("double").alias("empty"))
    return rounded(normality.normality(df, df.columns))


BY_SQL = "by_long as (select o_orderstatus || '/' || o_orderpriority as k, o_totalprice as value from orders)"


@query("normality_by_group", f"""
with {BY_SQL}, {shapiro_sql('by_long')}
select k as "group", 'o_totalprice' as variable, n, 'Shapiro-Wilk' as test, {rd('statistic')} as statistic,
       {rd(norm_upper('z'))} as p_value, {norm_upper('z')} > 0.05 as is_normal from sw""")
def normality_by_group(spark, sf):
    df = table(spark, sf, "orders").withColumn("kind", F.concat_ws("/", "o_orderstatus", "o_orderpriority"))
    return rounded(normality.normality_by(df, ["o_totalprice"], "kind"))


@query("normality_by_large_group", f"""
with by_long as (select l_returnflag as k, l_extendedprice as value from lineitem), {omnibus_sql('by_long')}
select k as "group", 'l_extendedprice' as variable, n, 'D''Agostino-Pearson' as test, {rd('statistic / 1e3')} as statistic,
       {rd('exp(-statistic / 2)')} as p_value, exp(-statistic / 2) > 0.05 as is_normal from k2""")
def normality_by_large_group(spark, sf):
    out = normality.normality_by(table(spark, sf, "lineitem"), ["l_extendedprice"], "l_returnflag")
    return rounded(out.withColumn("statistic", F.col("statistic") / 1e3))


# --- correlation -----------------------------------------------------------------


def _pairs_sql(source: str, pairs) -> str:
    return " union all ".join(f"select '{a}' as x, '{b}' as y, count(*) as n, corr({a}, {b}) as r from {source} "
                              f"where {a} is not null and {b} is not null" for a, b in pairs)


def _with_p(pairs: str) -> str:
    """CTEs ending in `tested(x, y, n, r, p_value)`."""
    return (f"pairs as ({pairs}), ts as (select *, r * sqrt((n - 2) / (1 - r * r)) as t from pairs), "
            f"tested as (select x, y, n, r, {p_t('t', 'n - 2')} as p_value from ts)")


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_tax")]


@query("pearson", f"with {_with_p(_pairs_sql('lineitem', PAIRS))} select x, y, n, {rd('r')} as r, {rd('p_value')} as p_value from tested")
def pearson(spark, sf):
    return rounded(correlation.pearson(table(spark, sf, "lineitem"), PAIRS))


ALL_PAIRS = list(combinations(LINE_NUM, 2))


@query("pearson_all_pairs", f"with {_with_p(_pairs_sql('lineitem', ALL_PAIRS))} select x, y, n, {rd('r')} as r, {rd('p_value')} as p_value from tested")
def pearson_all_pairs(spark, sf):
    return rounded(correlation.pearson(table(spark, sf, "lineitem"), ALL_PAIRS))


def ranks_sql(source: str, cols, where: str = "") -> str:
    """CTE `ranked` with average ranks under the column names."""
    each = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in cols)
    return f"ranked as (select {each} from {source}{' where ' + where if where else ''})"


SPEARMAN = [("l_quantity", "l_extendedprice"), ("l_tax", "l_discount")]


@query("spearman", f"""
with {ranks_sql('lineitem', ['l_quantity', 'l_extendedprice', 'l_tax', 'l_discount'])}, {_with_p(_pairs_sql('ranked', SPEARMAN))}
select x, y, n, {rd('r')} as r, {rd('p_value')} as p_value from tested""")
def spearman(spark, sf):
    return rounded(correlation.spearman(table(spark, sf, "lineitem"), SPEARMAN))


@query("spearman_salted_join", f"""
with {ranks_sql('lineitem', ['l_quantity', 'l_extendedprice', 'l_tax', 'l_discount'])}, {_with_p(_pairs_sql('ranked', SPEARMAN))}
select x, y, n, {rd('r')} as r, {rd('p_value')} as p_value from tested""")
def spearman_salted_join(spark, sf):
    """The path for large data: value buckets, salted shuffle join, no broadcast map."""
    df = table(spark, sf, "lineitem")
    return rounded(correlation.spearman(df, SPEARMAN, task_rows=5000, broadcast_ok=False))


GAPPY = """gappy as (select case when l_discount >= 0.02 then l_discount end as disc, case when l_tax <= 0.06 then l_tax end as tax,
  l_extendedprice as price from lineitem)"""
GAPPY_PAIRS = [("disc", "tax"), ("disc", "price"), ("tax", "price")]


def _gappy(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_discount") >= 0.02, F.col("l_discount")).alias("disc"),
        F.when(F.col("l_tax") <= 0.06, F.col("l_tax")).alias("tax"), F.col("l_extendedprice").alias("price"))


def _gappy_ranked() -> str:
    out = []
    for i, (a, b) in enumerate(GAPPY_PAIRS):
        each = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in (a, b))
        out.append(f"g{i} as (select {each} from gappy where {a} is not null and {b} is not null)")
    return ", ".join(out)


GAPPY_SPEARMAN = " union all ".join(f"select '{a}' as x, '{b}' as y, count(*) as n, corr({a}, {b}) as r from g{i}"
                                    for i, (a, b) in enumerate(GAPPY_PAIRS))


@query("pearson_with_gaps", f"with {GAPPY}, {_with_p(_pairs_sql('gappy', GAPPY_PAIRS))} select x, y, n, {rd('r')} as r, {rd('p_value')} as p_value from tested")
def pearson_with_gaps(spark, sf):
    return rounded(correlation.pearson(_gappy(spark, sf), GAPPY_PAIRS))


@query("spearman_with_gaps", f"with {GAPPY}, {_gappy_ranked()}, {_with_p(GAPPY_SPEARMAN)} select x, y, n, {rd('r')} as r, {rd('p_value')} as p_value from tested")
def spearman_with_gaps(spark, sf):
    return rounded(correlation.spearman(_gappy(spark, sf), GAPPY_PAIRS))


LABEL = """case when abs(r) >= 0.7 then 'strong' when abs(r) >= 0.4 then 'moderate' when abs(r) >= 0.2 then 'weak' else 'negligible' end"""
SIDE = "case when r > 0 then 'positive' else 'negative' end"


@query("auto_correlation", f"""
with {ranks_sql('part', ['p_partkey', 'p_size', 'p_retailprice'])},
{_with_p(_pairs_sql('ranked', list(combinations(['p_partkey', 'p_size', 'p_retailprice'], 2))))}
select 'Spearman Correlation' as test_name, x, y, n, {rd('r')} as r, {rd('p_value')} as p_value, p_value < 0.05 as significant,
  {LABEL} as strength, {SIDE} as direction,
  printf('%s %s correlation (r=%.3f, p=%.4f)', {LABEL}, {SIDE}, r, p_value) as interpretation
from tested""")
def auto_correlation(spark, sf):
    return rounded(correlation.auto_correlation(table(spark, sf, "part")))


WIDE = 40
_WIDE_EXPR = {i: f"((o_orderkey * {2 * i + 7} + o_custkey * {i + 3}) % {31 + 13 * i}) * 1.0 + o_totalprice * {i % 5} / 100000" for i in range(WIDE)}
_WIDE_GAP = {i: f"(o_orderkey + {i}) % {i % 7 + 5} = 0 or (o_custkey % 3 = {i % 3} and o_orderkey % 4 = 1)" for i in range(WIDE)}
_WIDE_COLS = ", ".join(f"case when {_WIDE_GAP[i]} then null else {_WIDE_EXPR[i]} end as w{i}" for i in range(WIDE))


@query("spearman_many_columns_with_gaps", f"""
with wide as (select o_orderkey, {_WIDE_COLS} from orders),
long as (select o_orderkey as id, unnest([{", ".join(str(i) for i in range(WIDE))}]) as k, unnest([{", ".join(f"w{i}" for i in range(WIDE))}]) as v from wide),
pairs as (
  select a.k as ka, b.k as kb, a.v as x, b.v as y from long a join long b on a.id = b.id and a.k < b.k where a.v is not null and b.v is not null),
ranked as (
  select ka, kb,
    rank() over (partition by ka, kb order by x) + (count(*) over (partition by ka, kb, x) - 1) / 2.0 as rx,
    rank() over (partition by ka, kb order by y) + (count(*) over (partition by ka, kb, y) - 1) / 2.0 as ry from pairs)
select 'w' || ka as x, 'w' || kb as y, count(*) as n, {rd('corr(rx, ry)')} as r from ranked group by ka, kb""")
def spearman_many_columns_with_gaps(spark, sf):
    wide = spark.sql(f"select {_WIDE_COLS} from {{orders}}", orders=table(spark, sf, "orders"))
    cols = [f"w{i}" for i in range(WIDE)]
    return correlation.spearman(wide, list(combinations(cols, 2))).select("x", "y", "n", F.round("r", 6).alias("r"))


@query("correlation_strength", f"""
with {REG_SQL}, {_with_p(_pairs_sql('reg_lines', [('disc_price', 'charge'), ('l_extendedprice', 'charge'), ('l_discount', 'disc_price')]))}
select x, y, n, {rd('r')} as r, {rd('p_value')} as p_value, p_value < 0.05 as significant, {LABEL} as strength, {SIDE} as direction,
  printf('%s %s correlation (r=%.3f, p=%.4f)', {LABEL}, {SIDE}, r, p_value) as interpretation
from tested""")
def correlation_strength(spark, sf):
    pairs = [("disc_price", "charge"), ("l_extendedprice", "charge"), ("l_discount", "disc_price")]
    return rounded(correlation.labelled(correlation.pearson(reg_lines(spark, sf), pairs)))


MATRIX = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "disc_price", "charge"]


@query("correlation_matrix", f"with {REG_SQL} " + " union all ".join(
    f"select '{a}' as x, '{b}' as y, count(*) as n, {rd(f'corr({a}, {b})') if a != b else '1.0::double'} as r from reg_lines"
    for a in MATRIX for b in MATRIX))
def correlation_matrix(spark, sf):
    return rounded(correlation.correlation_matrix(reg_lines(spark, sf), MATRIX))


@query("correlations_with_target", f"with {REG_SQL} " + " union all ".join(
    f"select '{a}' as variable, count(*) as n, {rd(f'corr({a}, charge)')} as r from reg_lines" for a in MATRIX[:-1]))
def correlations_with_target(spark, sf):
    return rounded(correlation.correlations_with(reg_lines(spark, sf), "charge", MATRIX))


REG_NUM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "disc_price", "charge"]


@query("significant_pairs", f"""
with {REG_SQL}, {_with_p(_pairs_sql('reg_lines', list(combinations(REG_NUM, 2))))}
select x, y, n, {rd('r')} as r, {rd('p_value')} as p_value, case when abs(r) > 0.7 then 'strong' else 'moderate' end as strength
from tested where n >= 10 and abs(r) > 0.3 and p_value < 0.05""")
def significant_pairs(spark, sf):
    return rounded(correlation.significant_pairs(reg_lines(spark, sf)))


# --- group comparison --------------------------------------------------------------


def _group_moments(source: str, pairs) -> str:
    return "gm as (" + " union all ".join(
        f"select '{c}' as category, '{v}' as variable, cast({c} as varchar) as g, count(*) as n, avg({v}) as m, var_samp({v}) as s2 "
        f"from {source} where {c} is not null and {v} is not null group by {c} having count(*) >= 3" for c, v in pairs) + ")"


T_PAIRS = [("l_linestatus", "l_extendedprice"), ("l_linestatus", "l_quantity"), ("l_linestatus", "l_tax")]
T_SQL = f"""
{_group_moments('lineitem', T_PAIRS)},
sides as (select category, variable, min(g) as ga, max(g) as gb from gm group by 1, 2),
two as (select s.category, s.variable, a.n as n1, a.m as m1, a.s2 as v1, b.n as n2, b.m as m2, b.s2 as v2 from sides s
  join gm a on a.category = s.category and a.variable = s.variable and a.g = s.ga
  join gm b on b.category = s.category and b.variable = s.variable and b.g = s.gb),
tt as (select category, variable, n1 + n2 as n, n1 + n2 - 2.0 as df,
  (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) as t from two)"""


@query("t_test", f"""with {T_SQL} select category, variable, 'Independent t-test' as test_name, cast(2 as bigint) as groups, n,
  {rd('t')} as statistic, cast(df as double) as df, {rd(p_t('t', 'df'))} as p_value from tt""")
def t_test(spark, sf):
    return rounded(groups.compare_groups(table(spark, sf, "lineitem"), "t", T_PAIRS))


A_PAIRS = [("o_orderpriority", "o_totalprice"), ("o_orderstatus", "o_totalprice"), ("o_orderpriority", "o_custkey")]


def _anova_sql(source, pairs) -> str:
    return f"""
{_group_moments(source, pairs)},
tot as (select category, variable, sum(n) as total, sum(n * m) / sum(n) as grand, count(*) as k from gm group by 1, 2),
fs as (select gm.category, gm.variable, k as groups, total, (sum(gm.n * pow(m - grand, 2)) / (k - 1)) / (sum((gm.n - 1) * s2) / (total - k)) as f,
  k - 1.0 as a, cast(total - k as double) as b from gm join tot using (category, variable) group by gm.category, gm.variable, k, total)"""


@query("anova", f"""with {_anova_sql('orders', A_PAIRS)} select category, variable, 'One-way ANOVA' as test_name, groups,
  cast(total as bigint) as n, {rd('f')} as statistic, cast(a as double) as df, {rd(p_f('f', 'a', 'b'))} as p_value from fs""")
def anova(spark, sf):
    return rounded(groups.compare_groups(table(spark, sf, "orders"), "anova", A_PAIRS))


def _rank_sql(source: str, pairs) -> str:
    """CTEs ending in `rs(category, variable, g, n, rank_sum)` and `tie(category, variable, total, ties)`."""
    long = " union all ".join(
        f"select '{c}' as category, '{v}' as variable, cast({c} as varchar) as g, cast({v} as double) as value from {source} "
        f"where {c} is not null and {v} is not null" for c, v in pairs)
    return f"""
raw_long as ({long}),
usable as (select category, variable, g from raw_long group by 1, 2, 3 having count(*) >= 3),
long as (select raw_long.* from raw_long semi join usable using (category, variable, g)),
rk as (select category, variable, g, rank() over (partition by category, variable order by value)
  + (count(*) over (partition by category, variable, value) - 1) / 2.0 as r from long),
rs as (select category, variable, g, count(*) as n, cast(sum(r) as double) as rank_sum from rk group by 1, 2, 3),
tc as (select category, variable, value, cast(count(*) as double) as t from long group by 1, 2, 3),
tie as (select category, variable, sum(t) as total, sum(t * t * t - t) as ties from tc group by 1, 2)"""


def _mw(pairs_source: str, pairs) -> str:
    return f"""{_rank_sql(pairs_source, pairs)},
sides as (select category, variable, min(g) as ga, max(g) as gb from rs group by 1, 2 having count(*) = 2),
two as (select s.category, s.variable, cast(a.n as double) as n1, cast(b.n as double) as n2, a.rank_sum - a.n * (a.n + 1) / 2.0 as u, total, ties from sides s
  join rs a on a.category = s.category and a.variable = s.variable and a.g = s.ga
  join rs b on b.category = s.category and b.variable = s.variable and b.g = s.gb
  join tie on tie.category = s.category and tie.variable = s.variable),
zz as (select *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((total + 1) - ties / (total * (total - 1)))) as z from two),
mw as (select category, variable, 'Mann-Whitney U' as test_name, cast(2 as bigint) as groups, cast(total as bigint) as n, u as statistic,
  cast(null as double) as df, case when z > 0 then {p_norm2('z')} else 1.0 end as p_value from zz)"""


def _kw(source: str, pairs) -> str:
    return f"""{_rank_sql(source, pairs)},
hh as (select rs.category, rs.variable, count(*) as k, total, (12 / (total * (total + 1)) * sum(rank_sum * rank_sum / n) - 3 * (total + 1))
  / (1 - ties / (total * total * total - total)) as kwh from rs join tie using (category, variable) group by rs.category, rs.variable, total, ties),
kw as (select category, variable, 'Kruskal-Wallis' as test_name, k as groups, cast(total as bigint) as n, kwh as statistic,
  cast(k - 1 as double) as df, {p_chi2('kwh', 'k - 1')} as p_value from hh)"""


MW_PAIRS = [("l_linestatus", "l_quantity"), ("l_linestatus", "l_extendedprice"), ("l_linestatus", "l_discount")]
FINAL = f"category, variable, test_name, groups, n, {rd('statistic / 1e6')} as statistic, df, {rd('p_value')} as p_value"


def _scaled(df):
    return rounded(df.withColumn("statistic", F.col("statistic") / 1e6))


@query("mann_whitney", f"with {_mw('lineitem', MW_PAIRS)} select {FINAL} from mw")
def mann_whitney(spark, sf):
    return _scaled(groups.compare_groups(table(spark, sf, "lineitem"), "mannwhitney", MW_PAIRS))


@query("mann_whitney_exact", f"""
with placed as (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) <= 2 as dear, row_number() over (order by o_orderkey) as r from orders),
u as (select cast(sum(r) filter (not dear) as double) - (count(*) - 2.0) * (count(*) - 1.0) / 2 as statistic, count(*) as n from placed),
t as (select *, cast(least(statistic, 2.0 * (n - 2) - statistic) as bigint) as tail from u),
places as (select unnest(range(tail // 2 + 1)) as a, tail, n from t),
ways as (select sum(least(n - 2, tail - a) - a + 1) as ways from places where a <= n - 2)
select 'dear' as category, 'o_orderkey' as variable, n, {rd('statistic / 1e6')} as statistic,
  {rd('least(1.0, 2.0 * ways / (n * (n - 1.0) / 2))')} as p_value, 'exact' as method from t, ways""")
def mann_whitney_exact(spark, sf):
    """The two dearest orders against all others: exact however many the others are."""
    orders = table(spark, sf, "orders")
    dear = {r["o_orderkey"] for r in orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2).collect()}
    marked = orders.select("o_orderkey", F.col("o_orderkey").isin(dear).alias("dear"))
    out = groups.mann_whitney_pairs(marked, [("dear", "o_orderkey")], min_group=2)
    return rounded(out.select("category", "variable", "n", (F.col("statistic") / 1e6).alias("statistic"), "p_value", "method"))


KW_PAIRS = [("event_type", "value"), ("event_type", "user_id")]


@query("kruskal_wallis", f"with {_kw('events', KW_PAIRS)} select category, variable, test_name, groups, n, {rd('statistic')} as statistic, df, {rd('p_value')} as p_value from kw")
def kruskal_wallis(spark, sf):
    return rounded(groups.compare_groups(table(spark, sf, "events"), "kruskal", KW_PAIRS))


MANY_GROUPS = [("l_orderkey", "l_quantity"), ("l_orderkey", "l_discount")]


@query("kruskal_wallis_many_groups", f"with {_kw('lineitem', MANY_GROUPS)} select category, variable, k as groups, cast(total as bigint) as n, {rd('kwh', 4)} as statistic, cast(k - 1 as double) as df from hh")
def kruskal_wallis_many_groups(spark, sf):
    """A group per order: the table of groups grows with the rows."""
    out = groups.compare_groups(table(spark, sf, "lineitem"), "kruskal", MANY_GROUPS)
    return rounded(out.select("category", "variable", "groups", "n", "statistic", "df"), 4)


@query("kruskal_wallis_bucketed", f"with {_kw('orders', A_PAIRS)} select category, variable, test_name, groups, n, {rd('statistic')} as statistic, df, {rd('p_value')} as p_value from kw")
def kruskal_wallis_bucketed(spark, sf):
    """The path for large data: ranks through value buckets."""
    return rounded(groups.compare_groups(table(spark, sf, "orders"), "kruskal", A_PAIRS, task_rows=2000))


def _auto(df):
    return rounded(df.drop("interpretation"))


AUTO_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("auto_group_tests", f"""
with a as (with {_mw('lineitem', [('l_linestatus', v) for v in AUTO_NUM])} select * from mw),
b as (with {_kw('lineitem', [('l_returnflag', v) for v in AUTO_NUM])} select * from kw)
select category, variable, test_name, groups, n, {rd('statistic / 1e6')} as statistic, df, {rd('p_value')} as p_value, p_value < 0.05 as significant
from (select * from a union all select * from b)""")
def auto_group_tests(spark, sf):
    df = table(spark, sf, "lineitem")
    out = groups.auto_group_tests(df, ["l_linestatus", "l_returnflag"], AUTO_NUM).drop("interpretation")
    return _scaled(out)


# Means over many lines per supplier are nearly normal, so the parametric tests are chosen.
SUPP = """supp as (select s_suppkey, s_nationkey % 2 as half, s_nationkey % 3 as third, avg(l_extendedprice) as mean_price, avg(l_quantity) as mean_qty
  from supplier join lineitem on l_suppkey = s_suppkey group by all),
supp2 as (select case when half = 0 then 'even' else 'odd' end as half, case third when 0 then 'a' when 1 then 'b' else 'c' end as third, mean_price, mean_qty from supp)"""


def _supp(spark, sf):
    lines, supplier = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    means = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.avg("l_extendedprice").alias("mean_price"), F.avg("l_quantity").alias("mean_qty"))
    third = F.when(F.col("s_nationkey") % 3 == 0, "a").when(F.col("s_nationkey") % 3 == 1, "b").otherwise("c")
    return supplier.join(means, "s_suppkey").select(
        F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("half"), third.alias("third"), "mean_price", "mean_qty")


SUPP_T = T_SQL.replace(_group_moments("lineitem", T_PAIRS), _group_moments("supp2", [("half", "mean_price"), ("half", "mean_qty")]))


@query("auto_group_tests_normal", f"""
with {SUPP}, t_all as (with {SUPP_T} select category, variable, 'Independent t-test' as test_name, cast(2 as bigint) as groups, n, t as statistic,
  cast(df as double) as df, {p_t('t', 'df')} as p_value from tt),
f_all as (with {_anova_sql('supp2', [('third', 'mean_price'), ('third', 'mean_qty')])} select category, variable, 'One-way ANOVA' as test_name, groups,
  cast(total as bigint) as n, f as statistic, cast(a as double) as df, {p_f('f', 'a', 'b')} as p_value from fs)
select category, variable, test_name, groups, n, {rd('statistic')} as statistic, df, {rd('p_value')} as p_value, p_value < 0.05 as significant
from (select * from t_all union all select * from f_all)""")
def auto_group_tests_normal(spark, sf):
    return _auto(groups.auto_group_tests(_supp(spark, sf)))


TYPED = "typed as (select event_type, case when event_type in ('click', 'view') then value + 5 else value end as shifted, value, user_id from events)"


@query("group_screen", f"""
with {TYPED}, k as (with {_kw('typed', [('event_type', 'shifted'), ('event_type', 'value'), ('event_type', 'user_id')])} select * from kw)
select category, variable, test_name, groups, n, {rd('statistic')} as statistic, df, {rd('p_value')} as p_value from k where p_value < 0.05""")
def group_screen(spark, sf):
    df = table(spark, sf, "events")
    shifted = F.when(F.col("event_type").isin("click", "view"), F.col("value") + 5).otherwise(F.col("value"))
    return rounded(groups.group_screen(df.select("event_type", shifted.alias("shifted"), "value", "user_id")))


# --- association ---------------------------------------------------------------------


def _chi(source: str, pairs) -> str:
    """CTEs ending in `chi(col_a, col_b, n, rows, cols, statistic, dof, p_value)`; every cell is built."""
    cells = " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, cast({a} as varchar) as a, cast({b} as varchar) as b, count(*) as o from {source} "
        f"where {a} is not null and {b} is not null group by {a}, {b}" for a, b in pairs)
    return f"""cells as ({cells}),
ra as (select col_a, col_b, a, sum(o) as ro from cells group by 1, 2, 3),
cb as (select col_a, col_b, b, sum(o) as co from cells group by 1, 2, 3),
tt as (select col_a, col_b, sum(o) as total, count(distinct a) as rows, count(distinct b) as cols from cells group by 1, 2),
full_cells as (select ra.col_a, ra.col_b, total, rows, cols, coalesce(o, 0) as o, ro * co / total as e,
  (rows - 1) * (cols - 1) as dof from ra join cb on ra.col_a = cb.col_a and ra.col_b = cb.col_b
  join tt on tt.col_a = ra.col_a and tt.col_b = ra.col_b
  left join cells c on c.col_a = ra.col_a and c.col_b = ra.col_b and c.a = ra.a and c.b = cb.b),
stat as (select col_a, col_b, cast(total as bigint) as n, rows, cols, cast(dof as double) as dof,
  sum(case when dof = 1 then pow(abs(o - e) - least(0.5, abs(o - e)), 2) else pow(o - e, 2) end / e) as statistic
  from full_cells where rows >= 2 and cols >= 2 group by col_a, col_b, total, rows, cols, dof),
chi as (select col_a, col_b, n, rows, cols, statistic, dof, {p_chi2('statistic', 'dof')} as p_value from stat)"""


@query("crosstab", """
select 'l_returnflag' as col_a, 'l_linestatus' as col_b, l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by 3, 4
union all
select 'l_linestatus', 'l_shipmode_like', l_linestatus, cast(l_linenumber as varchar), count(*) from lineitem group by 3, 4""")
def crosstab(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("l_shipmode_like", F.col("l_linenumber").cast("string"))
    return association.crosstab(df, [("l_returnflag", "l_linestatus"), ("l_linestatus", "l_shipmode_like")])


CHI_OUT = f"col_a, col_b, n, rows, cols, {rd('statistic')} as statistic, dof, {rd('p_value')} as p_value"


@query("chi_squared", f"with {_chi('conversations', [('role', 'turn')])} select {CHI_OUT} from chi")
def chi_squared(spark, sf):
    return rounded(association.chi_squared(association.crosstab(table(spark, sf, "conversations"), [("role", "turn")])))


# without the p-value: the numeric integral of the SQL does not reach so many degrees of freedom
@query("chi_squared_wide", f"with {_chi('lineitem', [('l_partkey', 'l_suppkey')])} select col_a, col_b, n, rows, cols, {rd('statistic')} as statistic, dof from stat")
def chi_squared_wide(spark, sf):
    """Two columns with so many levels that the cells are of the order of the rows."""
    return rounded(association.chi_squared(association.crosstab(table(spark, sf, "lineitem"), [("l_partkey", "l_suppkey")])).drop("p_value"))


@query("chi_squared_two_by_two", f"with {_chi('labels', [('quality', 'toxic')])} select {CHI_OUT} from chi")
def chi_squared_two_by_two(spark, sf):
    return rounded(association.chi_squared(association.crosstab(table(spark, sf, "labels"), [("quality", "toxic")])))


@query("auto_association", f"""with {_chi('orders', [('o_orderstatus', 'o_orderpriority')])}
select {CHI_OUT}, p_value < 0.05 as significant from chi""")
def auto_association(spark, sf):
    return rounded(association.auto_association(table(spark, sf, "orders")).drop("interpretation"))


TEXT = """kinds as (select role, case when length(text) < 80 then 'short' when length(text) < 200 then 'medium' else 'long' end as size_class,
  case when contains(text, '?') then 'question' else 'statement' end as form from conversations)"""


def _kinds(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select(
        "role", F.when(F.length(t) < 80, "short").when(F.length(t) < 200, "medium").otherwise("long").alias("size_class"),
        F.when(t.contains("?"), "question").otherwise("statement").alias("form"))


@query("association_screen", f"""
with {TEXT}, {_chi('kinds', [('role', 'size_class'), ('role', 'form'), ('size_class', 'form')])},
vs as (select *, sqrt(statistic / (n * (least(rows, cols) - 1))) as v from chi where p_value < 0.05)
select {CHI_OUT}, {rd('v')} as cramers_v, case when v > 0.3 then 'strong' when v > 0.1 then 'moderate' else 'weak' end as strength from vs""")
def association_screen(spark, sf):
    return rounded(association.association_screen(_kinds(spark, sf)))


@query("cramers_v", f"""
with {TEXT}, {_chi('kinds', [('role', 'size_class'), ('role', 'form'), ('size_class', 'form')])},
vs as (select *, sqrt(statistic / (n * (least(rows, cols) - 1))) as v from chi)
select {CHI_OUT}, {rd('v')} as cramers_v, case when v > 0.3 then 'strong' when v > 0.1 then 'moderate' else 'weak' end as strength from vs""")
def cramers_v(spark, sf):
    table_ = association.crosstab(_kinds(spark, sf), [("role", "size_class"), ("role", "form"), ("size_class", "form")])
    return rounded(association.cramers_v(association.chi_squared(table_)))


@query("row_percent", f"""
select l_returnflag as a, l_linestatus as b, count(*) as n, {rd('count(*) * 100.0 / sum(count(*)) over (partition by l_returnflag)')} as percent
from lineitem group by 1, 2""")
def row_percent(spark, sf):
    return rounded(association.row_percent(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@query("top_values", "select source as value, count(*) as n from documents group by 1 order by n desc, value limit 15")
def top_values(spark, sf):
    return association.top_values(table(spark, sf, "documents"), "source", 15)
