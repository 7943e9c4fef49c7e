"""Chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import REG_SQL, norm_ppf, query, rd, reg_lines, rounded, table
from registry.modelling import ACF, TWO, _ordered, _two
from statloom.operators import chartdata as cd
from statloom.operators import regression as reg
from statloom.operators.ranks import grouped_quantiles


def _hist(source: str, c: str, bins: str, name: str | None = None) -> str:
    return f"""select '{name or c}' as variable, cast(g.b as integer) as bin, {rd('lo + g.b * w', 4)} as low,
  {rd(f'case when g.b = k - 1 then hi else lo + (g.b + 1) * w end', 4)} as high, coalesce(c.n, 0) as n
from (select min({c}) as lo, max({c}) as hi, {bins} as k, (max({c}) - min({c})) / cast({bins} as double) as w from {source}) s,
  lateral (select unnest(range(cast(k as bigint))) as b) g
left join (select least(cast(floor(({c} - lo2) / w2) as bigint), k2 - 1) as b, count(*) as n
  from {source}, (select min({c}) as lo2, {bins} as k2, (max({c}) - min({c})) / cast({bins} as double) as w2 from {source}) where {c} is not null group by 1) c on c.b = g.b"""


@query("histogram", " union all ".join(_hist("lineitem", c, "30") for c in ("l_extendedprice", "l_orderkey")))
def histogram(spark, sf):
    return rounded(cd.histogram(table(spark, sf, "lineitem"), ["l_extendedprice", "l_orderkey"]), 4)


@query("histogram_auto_bins", _hist("customer", "c_acctbal", "least(50, greatest(10, count(*) // 20))")
       + " union all " + _hist("customer", "c_custkey", "least(50, greatest(10, count(*) // 20))"))
def histogram_auto_bins(spark, sf):
    return rounded(cd.histogram(table(spark, sf, "customer"), ["c_acctbal", "c_custkey"], bins=None), 4)


BOX = """q as (select event_type as grp, count(*) as n, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.75) as q3
  from events group by 1), f as (select *, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)"""


@query("box_summary", f"""
with {BOX} select grp, n, {rd('q1')} as q1, {rd('med')} as median, {rd('q3')} as q3,
  min(case when value between lo and hi then value end) as whisker_low, max(case when value between lo and hi then value end) as whisker_high,
  {rd('med - 1.57 * (q3 - q1) / sqrt(n)')} as notch_low, {rd('med + 1.57 * (q3 - q1) / sqrt(n)')} as notch_high,
  count(*) filter (value not between lo and hi) as outliers
from events join f on grp = event_type group by grp, n, q1, med, q3""")
def box_summary(spark, sf):
    return rounded(cd.box_summary(table(spark, sf, "events"), "value", "event_type"))


NARROW = """select case when l_orderkey % 3 = 0 then 'large' when l_orderkey % 3 = 1 then concat('g', cast(l_partkey % 1500 as {text})) end as grp,
       case when l_orderkey % 3 = 0 then 1000 + l_extendedprice / 1e9 else l_extendedprice end as value from {lineitem}"""


@query("quantiles_of_large_groups", f"""
with rows_of as ({NARROW.format(text='varchar', lineitem='lineitem')})
select grp, count(*) as n, round(quantile_cont(value, 0.25), 9) as q1, round(quantile_cont(value, 0.5), 9) as median, round(quantile_cont(value, 0.75), 9) as q3
from rows_of group by grp""")
def quantiles_of_large_groups(spark, sf):
    """A third of the rows in one group of a narrow range, a third without a group, the rest in very many."""
    rows = spark.sql(NARROW.format(text="string", lineitem="{lineitem}"), lineitem=table(spark, sf, "lineitem"))
    q = grouped_quantiles(rows, "value", ["grp"], [0.25, 0.5, 0.75], task_rows=2000)
    return q.select("grp", "n", *[F.round(F.col("q")[i], 9).alias(name) for i, name in enumerate(("q1", "median", "q3"))])


@query("box_summary_bucketed", f"""
with {BOX} select grp, n, {rd('q1')} as q1, {rd('med')} as median, {rd('q3')} as q3,
  min(case when value between lo and hi then value end) as whisker_low, max(case when value between lo and hi then value end) as whisker_high,
  {rd('med - 1.57 * (q3 - q1) / sqrt(n)')} as notch_low, {rd('med + 1.57 * (q3 - q1) / sqrt(n)')} as notch_high,
  count(*) filter (value not between lo and hi) as outliers
from events join f on grp = event_type group by grp, n, q1, med, q3""")
def box_summary_bucketed(spark, sf):
    """The path for large groups: exact quartiles through value buckets."""
    return rounded(cd.box_summary(table(spark, sf, "events"), "value", "event_type", task_rows=500))


@query("box_outliers", f"with {BOX} select grp, value from events join f on grp = event_type where value not between lo and hi")
def box_outliers(spark, sf):
    return cd.box_outliers(table(spark, sf, "events"), "value", "event_type")


@query("scatter_points", "select cast(p_size as double) as x, p_retailprice as y, p_type as grp from part")
def scatter_points(spark, sf):
    return cd.scatter_points(table(spark, sf, "part"), "p_size", "p_retailprice", "p_type")


@query("scatter_thinned", """
with points as (select l_returnflag as grp, l_extendedprice as x, l_quantity as y from lineitem),
ends as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from points),
cells as (select grp, cast(least(199, floor((x - x0) / (x1 - x0) * 200)) as integer) as cell_x,
  cast(least(199, floor((y - y0) / (y1 - y0) * 200)) as integer) as cell_y from points, ends)
select grp, cell_x, cell_y, count(*) as n, true as is_a_point from cells group by 1, 2, 3""")
def scatter_thinned(spark, sf):
    """A point per cell of the raster with the rows of its cell; the point is one of the table's."""
    lines = table(spark, sf, "lineitem")
    drawn = cd.scatter_thinned(lines, "l_extendedprice", "l_quantity", "l_returnflag")
    there = cd.scatter_points(lines, "l_extendedprice", "l_quantity", "l_returnflag").distinct().withColumn("there", F.lit(True))
    return drawn.join(there, ["grp", "x", "y"], "left").select("grp", "cell_x", "cell_y", "n", F.coalesce("there", F.lit(False)).alias("is_a_point"))


@query("scatter_trend", f"""
with {REG_SQL} select cast(l_linenumber as varchar) as grp, count(*) as n, {rd('regr_slope(charge, disc_price)')} as slope,
  {rd('regr_intercept(charge, disc_price)', 4)} as intercept, {rd('regr_r2(charge, disc_price)')} as r2,
  {rd('min(disc_price)', 4)} as x_min, {rd('max(disc_price)', 4)} as x_max from reg_lines group by 1""")
def scatter_trend(spark, sf):
    out = cd.trend_line(reg_lines(spark, sf), "disc_price", "charge", "l_linenumber")
    return rounded(out, 4, slope=6, r2=6)


HEAT = ["l_extendedprice", "disc_price", "charge", "l_discount"]


@query("heatmap", f"with {REG_SQL} " + " union all ".join(
    f"select '{a}' as x, '{b}' as y, {rd(f'corr({a}, {b})' if a != b else 'cast(count(*) > 0 as double)', 2)} as r from reg_lines" for a in HEAT for b in HEAT))
def heatmap(spark, sf):
    return cd.heatmap(reg_lines(spark, sf), HEAT)


@query("bar_counts", "select p_brand as value, count(*) as n from part group by 1 order by n desc, value limit 15")
def bar_counts(spark, sf):
    return cd.bar_counts(table(spark, sf, "part"), "p_brand")


@query("pie_shares", f"""
with top as (select p_brand as value, count(*) as n from part group by 1 order by n desc, value limit 10)
select value, n, {rd('n / sum(n) over ()')} as share from top""")
def pie_shares(spark, sf):
    return rounded(cd.pie_shares(table(spark, sf, "part"), "p_brand"))


@query("area_series", """
with placed as (select row_number() over (order by o_orderkey) - 1 as position, o_totalprice, cast(o_custkey as double) as o_custkey from orders)
select 'o_totalprice' as variable, position, o_totalprice as value from placed union all select 'o_custkey', position, o_custkey from placed""")
def area_series(spark, sf):
    return cd.area_series(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"]).withColumn(
        "position", F.col("position").cast("long"))


@query("area_series_partitioned", """
with placed as (select row_number() over (order by o_orderdate, o_totalprice) - 1 as position, o_totalprice from orders)
select 'o_totalprice' as variable, position, o_totalprice as value from placed""")
def area_series_partitioned(spark, sf):
    """The path for large data: range partitions numbered by offset."""
    return cd.area_series(table(spark, sf, "orders"), ["o_totalprice"], ["o_orderdate"], task_rows=1000)


@query("area_series_thinned", f"""
with placed as (select row_number() over (order by o_orderkey) - 1 as position, o_totalprice, (count(*) over () + 99) // 100 as per from orders)
select 'o_totalprice' as variable, cast(position // per as bigint) as position, {rd('avg(o_totalprice)', 4)} as value from placed group by 2""")
def area_series_thinned(spark, sf):
    return rounded(cd.area_series(table(spark, sf, "orders"), ["o_totalprice"], ["o_orderkey"], buckets=100), 4)


@query("hierarchy_counts", f"""
with r as (select o_orderstatus as level_1, o_orderpriority as level_2, cast(count(*) as double) as total,
  cast(2 - grouping(o_orderstatus) - grouping(o_orderpriority) as integer) as depth from orders group by rollup (o_orderstatus, o_orderpriority))
select r.depth, r.level_1, r.level_2, r.total, {rd('r.total / p.total * 100')} as percent_of_parent
from r left join r p on p.depth = r.depth - 1 and (p.depth = 0 or p.level_1 = r.level_1)""")
def hierarchy_counts(spark, sf):
    return rounded(cd.hierarchy(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("hierarchy_sums", f"""
with b as (select l_returnflag as a, l_linestatus as b, cast(l_linenumber as varchar) as c, l_quantity from lineitem),
r as (select a as level_1, b as level_2, c as level_3, sum(l_quantity) as total, cast(3 - grouping(a) - grouping(b) - grouping(c) as integer) as depth
  from b group by rollup (a, b, c))
select r.depth, r.level_1, r.level_2, r.level_3, r.total, {rd('r.total / p.total * 100')} as percent_of_parent
from r left join r p on p.depth = r.depth - 1 and (p.depth < 1 or p.level_1 = r.level_1) and (p.depth < 2 or p.level_2 = r.level_2)""")
def hierarchy_sums(spark, sf):
    return rounded(cd.hierarchy(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity"))


RADAR = ["o_totalprice", "o_custkey"]


@query("radar", "with m as (select o_orderpriority as category, avg(o_totalprice) as a, avg(o_custkey) as b from orders group by 1) "
       + f"select category, 'o_totalprice' as metric, {rd('a', 4)} as mean, {rd('a / max(a) over ()')} as scaled from m "
       + f"union all select category, 'o_custkey', {rd('b', 4)}, {rd('b / max(b) over ()')} from m")
def radar(spark, sf):
    return rounded(cd.radar(table(spark, sf, "orders"), "o_orderpriority", RADAR), 6, mean=4)


@query("violin_density", f"""
with g as (select event_type as grp, count(*) as n, min(value) as lo, max(value) as hi, stddev_samp(value) as sd,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from events group by 1),
s as (select grp, n, lo, (hi - lo) / 99 as step, 1.059 * least(sd, case when iqr > 0 then iqr / 1.349 else sd end) * pow(n, -0.2) as h from g),
grid as (select s.*, cast(i as integer) as point, lo + i * step as x from s, range(100) r(i))
select grid.grp, point, {rd('x')} as x, {rd('sum(exp(-pow((x - value) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi()))', 8)} as density
from grid join events on event_type = grid.grp group by grid.grp, point, x""")
def violin_density(spark, sf):
    return rounded(cd.violin_density(table(spark, sf, "events"), "value", "event_type"), 6, density=8)


VIOLIN = """
g as (select event_type as grp, count(*) as n, min(value) as lo, max(value) as hi, stddev_samp(value) as sd,
  quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from events group by 1),
shape as (
  select grp, n, lo, hi, (hi - lo) / 99 as step, 1.059 * least(sd, case when q3 > q1 then (q3 - q1) / 1.349 else sd end) * pow(n, -0.2) as h,
    q1, median, q3, q1 - 1.5 * (q3 - q1) as fence_low, q3 + 1.5 * (q3 - q1) as fence_high from g),
fine as (select *, greatest(1024, least(16384, cast(ceil(16 * (hi - lo) / h) as integer) + 1)) as bins from shape),
wide as (select *, (hi - lo) / (bins - 1) as w from fine),
shared as (
  select grp, least(bins - 2, cast(floor((value - lo) / w) as integer)) as bin, (value - lo) / w as place from events join wide on event_type = grp),
centres as (
  select grp, bin, sum(1 - (place - bin)) as weight from shared group by 1, 2
  union all select grp, bin + 1, sum(place - bin) from shared group by 1, 2),
density as (
  select s.grp, i as point, s.lo + i * s.step as x,
    sum(c.weight * exp(-pow((s.lo + i * s.step - (s.lo + c.bin * s.w)) / s.h, 2) / 2)) / (max(s.n) * max(s.h) * sqrt(2 * pi())) as density
  from wide s join centres c on c.grp = s.grp, range(100) r(i) group by s.grp, i, s.lo, s.step),
ends as (
  select s.grp, min(value) filter (value between fence_low and fence_high) as whisker_low, max(value) filter (value between fence_low and fence_high) as whisker_high
  from events join shape s on event_type = s.grp group by s.grp)"""


@query("violin", f"""
with {VIOLIN}
select grp, 'density' as part, cast(point as integer) as point, {rd('x')} as x, {rd('density', 8)} as density from density
union all select grp, unnest(['q1', 'median', 'q3']), null, unnest([{rd('q1')}, {rd('median')}, {rd('q3')}]), null from shape
union all select grp, unnest(['whisker_low', 'whisker_high']), null, unnest([{rd('whisker_low')}, {rd('whisker_high')}]), null from ends
union all select s.grp, 'outlier', null, {rd('value')}, null from events join shape s on event_type = s.grp where value < fence_low or value > fence_high""")
def violin(spark, sf):
    """Density from bins, box and outliers."""
    return rounded(cd.violin(table(spark, sf, "events"), "value", "event_type"), 6, density=8)


def _qq(rows: str) -> str:
    """CTE `qq(rank, n, theoretical, sample)` from a one-column relation `v(sample)`."""
    return f"""ranked as (select sample, row_number() over (order by sample) as rank, count(*) over () as n from ({rows})),
placed as (select *, case when rank = n then pow(0.5, 1.0 / n) when rank = 1 then 1 - pow(0.5, 1.0 / n) else (rank - 0.3175) / (n + 0.365) end as p from ranked),
qq as (select rank, n, {norm_ppf('p')} as theoretical, sample from placed)"""


@query("qq_points", f"with {_qq('select value as sample from events')} select rank, {rd('theoretical')} as theoretical, sample from qq")
def qq_points(spark, sf):
    return rounded(cd.qq_points(table(spark, sf, "events"), "value"))


@query("qq_thinned", f"""
with {_qq('select l_extendedprice as sample from lineitem')},
chosen as (select distinct unnest(list_concat(list_transform(range(500), lambda i: 1 + (i * (n - 1)) // 499), range(1, 21), range(n - 19, n + 1))) as rank
  from (select count(*) as n from lineitem))
select rank, {rd('theoretical')} as theoretical, sample from qq semi join chosen using (rank)""")
def qq_thinned(spark, sf):
    """Five hundred even ranks and the outermost twenty of either side, out of all lines."""
    return rounded(cd.qq_thinned(table(spark, sf, "lineitem"), "l_extendedprice", points=500, ends=20, task_rows=5000))


QQ_OUT = """select max(n) as n, {slope} as slope, {intercept} as intercept, {r} as r from qq""".format(
    slope=rd("regr_slope(sample, theoretical)", 4), intercept=rd("regr_intercept(sample, theoretical)", 3), r=rd("corr(sample, theoretical)"))


@query("qq_line", f"with {_qq('select o_totalprice as sample from orders')} {QQ_OUT}")
def qq_line(spark, sf):
    return rounded(cd.qq_line(table(spark, sf, "orders"), "o_totalprice"), 4, r=6, intercept=3)


@query("qq_line_bucketed", f"with {_qq('select l_quantity as sample from lineitem')} {QQ_OUT}")
def qq_line_bucketed(spark, sf):
    """Fifty distinct values over all lines: long runs of equal values, ranked through buckets."""
    return rounded(cd.qq_line(table(spark, sf, "lineitem"), "l_quantity", task_rows=5000), 4, r=6, intercept=3)


@query("stacked_percent", f"""
select role as a, lang as b, count(*) as n, {rd('count(*) * 100.0 / sum(count(*)) over (partition by role)')} as percent
from (select source as role, lang from documents) group by 1, 2""")
def stacked_percent(spark, sf):
    return rounded(cd.stacked_percent(table(spark, sf, "documents"), "source", "lang"))


@query("actual_vs_predicted", f"with {TWO} select {rd('y')} as actual, {rd('f', 3)} as predicted from res")
def actual_vs_predicted(spark, sf):
    return rounded(cd.actual_vs_predicted(_two(spark, sf)), 3, actual=6)


@query("residuals_vs_fitted", f"with {TWO} select {rd('f', 3)} as predicted, {rd('e', 3)} as residual from res")
def residuals_vs_fitted(spark, sf):
    return rounded(cd.residuals_vs_fitted(_two(spark, sf)), 3)


@query("prediction_range", f"with {TWO} select {rd('least(min(y), min(f))', 4)} as low, {rd('greatest(max(y), max(f))', 4)} as high from res")
def prediction_range(spark, sf):
    return rounded(cd.prediction_range(_two(spark, sf)), 4)


@query("residual_histogram", f"with {TWO} " + _hist("res", "e", "least(50, greatest(10, count(*) // 15))", "residual"))
def residual_histogram(spark, sf):
    return rounded(cd.residual_histogram(_two(spark, sf)), 4)


@query("residual_qq_line", f"with {TWO}, {_qq('select e as sample from res')} {QQ_OUT}")
def residual_qq_line(spark, sf):
    return rounded(cd.residual_qq_line(_two(spark, sf)), 4, r=6, intercept=3)


@query("acf_bars", f"""
with {ACF} select 'acf' as kind, lag, {rd('acf')} as value, {rd('1.96 / sqrt(n)')} as band, lag > 0 and abs(acf) > 1.96 / sqrt(n) as outside from ac, base1""")
def acf_bars(spark, sf):
    return rounded(cd.lag_bars(_ordered(spark, sf)).where("kind = 'acf'"))


@query("vif_bars", f"""
with {REG_SQL}, v as (select 1 / (1 - pow(corr(disc_price, l_extendedprice), 2)) as v from reg_lines)
select name as variable, {rd('v', 2)} as vif, case when v > 10 then 'severe' when v > 5 then 'moderate' else 'low' end as band
from v, (values ('disc_price'), ('l_extendedprice')) n(name)""")
def vif_bars(spark, sf):
    return cd.vif_bars(reg.fit_ols(reg_lines(spark, sf), "charge", ["disc_price", "l_extendedprice"]))


@query("coefficient_bars", f"""
with {TWO}, se as (select *, sqrt(s2 * sbb / det) as e1, sqrt(s2 * saa / det) as e2,
  (1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4 * (n - 3))) as q from full_fit)
select 'disc_price' as variable, {rd('b1', 4)} as coefficient, {rd('q*e1', 4)} as arm_low, {rd('q*e1', 4)} as arm_high, abs(b1/e1) > q as significant from se
union all select 'l_tax', {rd('b2', 4)}, {rd('q*e2', 4)}, {rd('q*e2', 4)}, abs(b2/e2) > q from se""")
def coefficient_bars(spark, sf):
    return rounded(cd.coefficient_bars(_two(spark, sf)), 4)


REQUESTS = [
    {"type": "histogram", "columns": ["o_totalprice"], "title": "Totals"},
    {"type": "boxplot", "column": "o_totalprice", "group_by": "o_orderpriority", "title": "Totals by priority"},
    {"type": "scatter", "x": "o_custkey", "y": "o_totalprice", "hue": "o_orderstatus"},
    {"type": "heatmap", "title": "Correlation"},
    {"type": "bar", "column": "no_such_column", "title": "Missing"},
    {"type": "area", "columns": ["o_totalprice"], "title": "Over time"},
    {"type": "sunburst", "path": ["o_orderstatus", "o_orderpriority"], "title": "Tree"},
    {"type": "treemap", "path": ["o_orderstatus"], "values": "o_totalprice", "title": "Map"},
    {"type": "radar", "categories": "o_orderpriority", "metrics": ["o_totalprice"], "title": "Radar"},
    {"type": "violin", "column": "o_totalprice", "title": "Violin"},
    {"type": "donut", "column": "o_orderstatus", "title": "Donut"},
    {"type": "qq", "column": "o_orderstatus", "title": "QQ of text"},
    {"type": "sparkline", "column": "o_totalprice", "title": "Unknown"},
]


@query("chart_requests", """
with n as (select count(*) as rows from orders)
select cast(position as integer) as position, chart_type, title, error from n, (values
  (1, 'histogram', 'Totals', null), (2, 'boxplot', 'Totals by priority', null), (3, 'scatter', 'Chart 3', null),
  (4, 'heatmap', 'Correlation', null), (5, 'bar', 'Missing', 'Insufficient data for this chart type'), (6, 'area', 'Over time', null),
  (7, 'sunburst', 'Tree', null), (8, 'treemap', 'Map', null), (9, 'radar', 'Radar', null), (10, 'violin', 'Violin', null),
  (11, 'donut', 'Donut', null), (12, 'qq', 'QQ of text', 'Insufficient data for this chart type')) v(position, chart_type, title, error)
where rows > 0""")
def chart_requests(spark, sf):
    return cd.run_requests(table(spark, sf, "orders"), REQUESTS, ["o_orderkey"])[1]
