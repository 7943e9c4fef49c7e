"""Linear regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import DIRTY_SQL, REG_SQL, dirty_orders, p_chi2, p_f, p_t, query, rd, reg_lines, rounded, table
from registry.testing import REG_NUM, omnibus_sql
from statloom.operators import regression as reg
from statloom.plans.full import regression_run

SCORES = " union all ".join(
    f"select '{a}' as variable, {i} as position, (" + " + ".join(f"abs(corr({a}, {b}))" for b in REG_NUM if b != a)
    + f") / {len(REG_NUM) - 1} as s from reg_lines" for i, a in enumerate(REG_NUM))


@query("target_scores", f"""
with {REG_SQL}, scores as ({SCORES})
select variable, position, {rd('s')} as mean_abs_r, row_number() over (order by s desc, position) = 1 as chosen from scores""")
def target_scores(spark, sf):
    return rounded(reg.target_scores(reg_lines(spark, sf)))


@query("complete_rows", f"""
with {DIRTY_SQL}, gaps as (select o_orderkey, o_totalprice, try_cast(custkey_text as double) as custkey from dirty_orders)
select * from gaps where o_totalprice is not null and custkey is not null""")
def complete_rows(spark, sf):
    df = dirty_orders(spark, sf).select("o_orderkey", "o_totalprice", F.expr("try_cast(custkey_text as double)").alias("custkey"))
    return reg.complete_rows(df, ["o_totalprice", "custkey"])


# --- two predictors: charge on disc_price and l_tax ---------------------------------

# Closed form from centred sums; y, a, b are the target and the predictors.
CLOSED_FORM = """mm as (select cast(count(*) as double) as n, avg(y) as my, avg(a) as ma, avg(b) as mb from src),
ss as (select sum((y-my)*(y-my)) as syy, sum((a-ma)*(a-ma)) as saa, sum((b-mb)*(b-mb)) as sbb, sum((a-ma)*(b-mb)) as sab,
  sum((a-ma)*(y-my)) as say, sum((b-mb)*(y-my)) as sby from src, mm),
bb as (select *, saa*sbb - sab*sab as det, (say*sbb - sby*sab) / (saa*sbb - sab*sab) as b1, (sby*saa - say*sab) / (saa*sbb - sab*sab) as b2 from ss),
fit as (select bb.*, mm.*, my - b1*ma - b2*mb as b0 from bb, mm),
res as (select y, b0 + b1*a + b2*b as f, y - (b0 + b1*a + b2*b) as e, a, b from src, fit),
rr as (select sum(e*e) as ssr, avg(e) as me, min(e) as lo, max(e) as hi from res),
full_fit as (select fit.*, rr.*, ssr / (n - 3) as s2 from fit, rr)"""
TWO = f"""{REG_SQL},
src as (select charge as y, disc_price as a, l_tax as b from reg_lines),
{CLOSED_FORM}"""


def _two(spark, sf):
    return reg.fit_ols(reg_lines(spark, sf), "charge", ["disc_price", "l_tax"])


@query("ols_coefficients", f"""
with {TWO}, se as (select *, sqrt(s2 * (1/n + (ma*ma*sbb - 2*ma*mb*sab + mb*mb*saa) / det)) as e0, sqrt(s2 * sbb / det) as e1, sqrt(s2 * saa / det) as e2 from full_fit),
rows as (select 0 as position, 'const' as variable, b0 as c, e0 as se, n from se union all select 1, 'disc_price', b1, e1, n from se
  union all select 2, 'l_tax', b2, e2, n from se),
ts as (select *, c / se as t, n - 3 as df from rows)
select position, variable, {rd('c', 4)} as coefficient, {rd('se', 4)} as std_error, {rd('t', 4)} as t_statistic,
  {rd(p_t('t', 'df'))} as p_value, {p_t('t', 'df')} < 0.05 as significant from ts""")
def ols_coefficients(spark, sf):
    out = _two(spark, sf).coefficients().drop("ci_lower", "ci_upper")
    return rounded(out, 4, p_value=6)


# 97.5 % t quantile by the Cornish-Fisher series (Abramowitz & Stegun 26.7.5), exact to 1e-9 for these degrees of freedom.
T975 = ("(1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4 * (n - 3)) "
        "+ (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / (96 * pow(n - 3, 2)))")


@query("ols_confidence_intervals", f"""
with {TWO}, se as (select *, sqrt(s2 * sbb / det) as e1, sqrt(s2 * saa / det) as e2, {T975} as q from full_fit)
select 'disc_price' as variable, {rd('b1 - q*e1')} as ci_lower, {rd('b1 + q*e1')} as ci_upper from se
union all select 'l_tax', {rd('b2 - q*e2', 4)}, {rd('b2 + q*e2', 4)} from se""")
def ols_confidence_intervals(spark, sf):
    out = _two(spark, sf).coefficients().where("variable <> 'const'").select("variable", "ci_lower", "ci_upper")
    tax = F.col("variable") == "l_tax"
    return out.withColumns({c: F.when(tax, F.round(c, 4)).otherwise(F.round(c, 6)) for c in ("ci_lower", "ci_upper")})


@query("ols_summary", f"""
with {TWO}, r as (select *, 1 - ssr / syy as r2, ((syy - ssr) / 2) / (ssr / (n - 3)) as f, -n/2 * (ln(2*pi()) + ln(ssr/n) + 1) as llf,
  2.0 as fa, n - 3 as fb from full_fit)
select 'charge' as target, cast(n as bigint) as n_observations, 2 as n_predictors, {rd('r2')} as r_squared,
  {rd('1 - (n - 1) / (n - 3) * (1 - r2)')} as adj_r_squared, {rd('f / 1e6', 4)} as f_statistic, {rd(p_f('f', 'fa', 'fb'))} as f_pvalue,
  {rd('-2*llf + 6', 3)} as aic, {rd('-2*llf + 3*ln(n)', 3)} as bic, {rd('llf', 3)} as log_likelihood from r""")
def ols_summary(spark, sf):
    s = _two(spark, sf).model_summary().drop("omnibus", "omnibus_pvalue", "condition_number")
    s = s.withColumn("f_statistic", F.col("f_statistic") / 1e6)
    return rounded(s, 6, f_statistic=4, aic=3, bic=3, log_likelihood=3)


@query("vif", f"""
with {REG_SQL}, r as (select corr(disc_price, l_extendedprice) as r from reg_lines),
v as (select 1 / (1 - r * r) as v from r)
select name as variable, {rd('v', 4)} as vif, case when v > 10 then 'severe' when v > 5 then 'moderate' else 'low' end as multicollinearity
from v, (values ('disc_price'), ('l_extendedprice')) n(name)""")
def vif(spark, sf):
    return rounded(reg.fit_ols(reg_lines(spark, sf), "charge", ["disc_price", "l_extendedprice"]).vif(), 4)


@query("collinear_fit", f"""
with {REG_SQL}, f as (select regr_slope(charge, disc_price) as b, regr_intercept(charge, disc_price) as a, count(*) as n from reg_lines)
select 'disc_price' as variable, {rd('b / 5')} as coefficient, true as collinear from f
union all select 'twice', {rd('2 * b / 5')}, true from f""")
def collinear_fit(spark, sf):
    """Exactly collinear predictors share the effect: the minimum-norm solution."""
    df = reg_lines(spark, sf).withColumn("twice", F.col("disc_price") * 2)
    fit = reg.fit_ols(df, "charge", ["disc_price", "twice"])
    return fit.coefficients().where("variable <> 'const'").join(fit.vif(), "variable").select(
        "variable", F.round("coefficient", 6).alias("coefficient"), F.col("vif").isNull().alias("collinear"))


@query("predictions", f"""
with {TWO} select {rd('y')} as actual, {rd('f', 3)} as predicted, {rd('e', 3)} as residual from res""")
def predictions(spark, sf):
    return rounded(_two(spark, sf).predictions(), 3, actual=6)


@query("residual_stats", f"""
with {TWO} select {rd('max(me)')} as mean, {rd('sqrt(avg((e-me)*(e-me)))', 4)} as std, {rd('min(e)', 4)} as min, {rd('max(e)', 4)} as max,
  {rd('avg(pow(e-me, 3)) / pow(avg(pow(e-me, 2)), 1.5)', 4)} as skewness, {rd('avg(pow(e-me, 4)) / pow(avg(pow(e-me, 2)), 2)', 4)} as kurtosis
from res, rr""")
def residual_stats(spark, sf):
    return rounded(_two(spark, sf).residual_stats(), 4, mean=6)


MOMENTS = """sh as (select count(*) as cnt, avg(pow(e-me, 3)) / pow(avg(pow(e-me, 2)), 1.5) as s,
  avg(pow(e-me, 4)) / pow(avg(pow(e-me, 2)), 2) as k from res, rr),
jb as (select cnt / 6.0 * (s*s + (k-3)*(k-3)/4) as j from sh)"""
JB = f"{TWO}, {MOMENTS}"
BP = f"""g as (select e*e as y, a, b from res),
gm as (select avg(y) as my2, avg(a) as ma2, avg(b) as mb2 from g),
gs as (select sum((y-my2)*(y-my2)) as gyy, sum((a-ma2)*(a-ma2)) as gaa, sum((b-mb2)*(b-mb2)) as gbb, sum((a-ma2)*(b-mb2)) as gab,
  sum((a-ma2)*(y-my2)) as gay, sum((b-mb2)*(y-my2)) as gby, count(*) as cnt2 from g, gm),
bp as (select cnt2 * (gay*(gay*gbb - gby*gab) + gby*(gby*gaa - gay*gab)) / (gaa*gbb - gab*gab) / gyy as lm, 2.0 as k2 from gs)"""


@query("jarque_bera", f"""
with {JB} select 'Jarque-Bera' as test, {rd('j', 4)} as statistic, {rd('exp(-j/2)')} as p_value,
  case when exp(-j/2) > 0.05 then 'normal' else 'not normal' end as verdict from jb""")
def jarque_bera(spark, sf):
    return rounded(_two(spark, sf).residual_diagnostics().where("test = 'Jarque-Bera'"), 4, p_value=6)


@query("breusch_pagan", f"""
with {TWO}, {BP} select 'Breusch-Pagan' as test, {rd('lm')} as statistic, {rd(p_chi2('lm', 'k2'))} as p_value,
  case when {p_chi2('lm', 'k2')} > 0.05 then 'homoscedastic' else 'heteroscedastic' end as verdict from bp""")
def breusch_pagan(spark, sf):
    return rounded(_two(spark, sf).residual_diagnostics().where("test = 'Breusch-Pagan'"))


# --- ordered residuals: o_totalprice on o_custkey in o_orderkey order ------------------

ORDERED = """fit1 as (select regr_slope(o_totalprice, o_custkey) as b, regr_intercept(o_totalprice, o_custkey) as a from orders),
res1 as (select o_orderkey, o_totalprice - (a + b * o_custkey) as e from orders, fit1),
base1 as (select count(*) as n, avg(e) as me, sum(e*e) as ee from res1)"""


def _ordered(spark, sf):
    return reg.fit_ols(table(spark, sf, "orders"), "o_totalprice", ["o_custkey"], order_by=["o_orderkey"])


@query("ols_omnibus_and_condition", f"""
with {ORDERED}, long as (select 'e' as k, e as value from res1), {omnibus_sql('long')},
x as (select cast(count(*) as double) as n, sum(cast(o_custkey as double)) as s, sum(cast(o_custkey as double) * o_custkey) as q from orders),
lam as (select (n + q + sqrt(pow(n - q, 2) + 4 * s * s)) / 2 as big, n * q - s * s as det from x)
select 'o_totalprice' as target, {rd('statistic / 1e3', 4)} as omnibus, {rd('exp(-statistic / 2)')} as omnibus_pvalue,
  {rd('big / sqrt(det)', 4)} as condition_number from k2, lam""")
def ols_omnibus_and_condition(spark, sf):
    out = _ordered(spark, sf).model_summary().select("target", F.col("omnibus") / 1e3, "omnibus_pvalue", "condition_number")
    return rounded(out.toDF("target", "omnibus", "omnibus_pvalue", "condition_number"), 4)


@query("durbin_watson", f"""
with {ORDERED}, steps as (select e - lag(e) over (order by o_orderkey) as d from res1),
dw as (select sum(d*d) / max(ee) as dw from steps, base1)
select 'Durbin-Watson' as test, {rd('dw')} as statistic, cast(null as double) as p_value,
  case when dw < 1.5 then 'positive autocorrelation' when dw <= 2.5 then 'no autocorrelation' else 'negative autocorrelation' end as verdict from dw""")
def durbin_watson(spark, sf):
    return rounded(_ordered(spark, sf).residual_diagnostics().where("test = 'Durbin-Watson'"))


LAGS = ", ".join(f"lead(z, {k}) over (order by o_orderkey) as z{k}" for k in range(1, 21))
ACF = f"""{ORDERED}, zz as (select o_orderkey, e - me as z from res1, base1), shifted as (select z, {LAGS} from zz),
sums as (select sum(z*z) as c0, """ + ", ".join(f"sum(z * z{k}) as c{k}" for k in range(1, 21)) + """ from shifted),
ac as (""" + " union all ".join(f"select {k} as lag, c{k} / c0 as acf from sums" for k in range(21)) + ")"


@query("autocorrelation", f"""
with {ACF} select lag, {rd('acf')} as acf, {rd('1.96 / sqrt(n)')} as band, lag > 0 and abs(acf) > 1.96 / sqrt(n) as acf_outside from ac, base1""")
def autocorrelation(spark, sf):
    return rounded(_ordered(spark, sf).acf_pacf().select("lag", "acf", "band", "acf_outside"))


@query("partial_autocorrelation", f"""
with {ACF}, r as (select max(case when lag = 1 then acf end) as r1, max(case when lag = 2 then acf end) as r2, max(case when lag = 3 then acf end) as r3 from ac)
select 0 as lag, 1.0::double as pacf from r union all select 1, {rd('r1')} from r
union all select 2, {rd('(r2 - r1*r1) / (1 - r1*r1)')} from r
union all select 3, {rd('(r1*r1*r1 - 2*r1*r2 + r3 + r1*r2*r2 - r1*r1*r3) / (1 + 2*r1*r1*r2 - r2*r2 - 2*r1*r1)')} from r""")
def partial_autocorrelation(spark, sf):
    """Lags 0 to 3 against their closed forms; `acf_pacf_table` has them all, by recursion."""
    return rounded(_ordered(spark, sf).acf_pacf().where("lag <= 3").select("lag", "pacf"))


def _recursion(lags: int) -> str:
    """Durbin-Levinson, one step per lag; r, phi and pacf are lists, r[1] is lag 0."""
    steps = ["p0 as (select list(acf order by lag) as r, cast([] as double[]) as phi, [cast(1 as double)] as pacf from ac)"]
    for k in range(1, lags + 1):
        top = " + ".join([f"r[{k + 1}]", *[f"-phi[{j}] * r[{k - j + 1}]" for j in range(1, k)]])
        bottom = " - ".join(["1", *[f"phi[{j}] * r[{j + 1}]" for j in range(1, k)]])
        phi = ", ".join([*[f"phi[{j}] - last * phi[{k - j}]" for j in range(1, k)], "last"])
        steps.append(f"p{k} as (select r, [{phi}] as phi, list_append(pacf, last) as pacf from (select *, ({top}) / ({bottom}) as last from p{k - 1}))")
    return ",\n".join(steps)


@query("acf_pacf_table", f"""
with {ACF}, {_recursion(20)}, rows as (select unnest(range(21)) as lag, unnest(r) as acf, unnest(pacf) as pacf from p20)
select lag, {rd('acf')} as acf, {rd('pacf')} as pacf, {rd('1.96 / sqrt(n)')} as band,
  lag > 0 and abs(acf) > 1.96 / sqrt(n) as acf_outside, lag > 0 and abs(pacf) > 1.96 / sqrt(n) as pacf_outside from rows, base1""")
def acf_pacf_table(spark, sf):
    return rounded(_ordered(spark, sf).acf_pacf())


@query("assumption_table", f"""
with {JB}, {BP}, lin as (select corr(e, (f - my) * (f - my)) as c from res, fit),
col as (select 1 / (1 - pow(corr(disc_price, l_tax), 2)) as v from reg_lines)
select 'linearity' as assumption, 'corr(residual, squared fitted)' as measure, {rd('c')} as value, abs(c) <= 0.1 as met,
  case when abs(c) <= 0.1 then null else 'transform variables or try a non-linear model' end as suggestion from lin
union all select 'normality', 'Jarque-Bera p', {rd('exp(-j/2)')}, exp(-j/2) > 0.05, case when exp(-j/2) > 0.05 then null else 'transform the target' end from jb
union all select 'homoscedasticity', 'Breusch-Pagan p', {rd(p_chi2('lm', 'k2'))}, {p_chi2('lm', 'k2')} > 0.05,
  case when {p_chi2('lm', 'k2')} > 0.05 then null else 'use robust errors or transform the target' end from bp
union all select 'multicollinearity', 'largest VIF', {rd('v')}, v <= 10, case when v <= 10 then null else 'remove high-VIF predictors' end from col""")
def assumption_table(spark, sf):
    return rounded(_two(spark, sf).assumptions())


def _sweep(names: list[str]) -> str:
    """Sweep every column but the last out of the correlation matrix: slopes, residual share and inverse."""
    p, last = len(names), len(names) - 1
    steps = ["w0 as (select " + ", ".join(
        f"{'cast(1 as double)' if i == j else f'corr({a}, {b})'} as a{i}{j}" for i, a in enumerate(names) for j, b in enumerate(names)) + " from reg_lines)"]
    for k in range(last):
        d = f"a{k}{k}"

        def cell(i, j):
            if i == k and j == k:
                return f"-1 / {d}"
            return f"a{i}{j} / {d}" if k in (i, j) else f"a{i}{j} - a{i}{k} * a{k}{j} / {d}"

        steps.append(f"w{k + 1} as (select " + ", ".join(f"{cell(i, j)} as a{i}{j}" for i in range(p) for j in range(p)) + f" from w{k})")
    return ",\n".join(steps)


def _sweep_fit(names: list[str]) -> str:
    """(position, variable, c, se, df) of the regression of the last column on the others."""
    last = len(names) - 1
    spread = ", ".join(f"avg({v}) as m{i}, stddev_pop({v}) as s{i}" for i, v in enumerate(names))
    slope = [f"a{i}{last} * s{last} / s{i}" for i in range(last)]
    const = " - ".join([f"m{last}", *[f"{b} * m{i}" for i, b in enumerate(slope)]])
    lever = " + ".join(f"(m{i} / s{i}) * (m{j} / s{j}) * -a{i}{j}" for i in range(last) for j in range(last))
    noise = f"a{last}{last} * s{last} * s{last} / df"
    rows = [f"select 0 as position, 'const' as variable, {const} as c, sqrt({noise} * (1 + {lever})) as se, df from spread, w{last}"]
    rows += [f"select {i + 1}, '{names[i]}', {slope[i]}, sqrt({noise} * -a{i}{i}) / s{i}, df from spread, w{last}" for i in range(last)]
    return (f"{_sweep(names)}, spread as (select cast(count(*) - {last + 1} as double) as df, {spread} from reg_lines), "
            f"rows as ({' union all '.join(rows)})")


RUN_COLS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "disc_price", "charge"]


@query("regression_run", f"""
with {REG_SQL}, scores as ({SCORES}), best as (select variable as target from scores order by s desc, position limit 1),
{_sweep_fit(RUN_COLS)},
ts as (select *, c / se as t, {T975.replace('(n - 3)', 'df').replace('n - 3', 'df')} as q from rows)
select position, variable, {rd('c', 4)} as coefficient, {rd('se', 4)} as std_error, {rd('t', 4)} as t_statistic,
  {rd(p_t('t', 'df'), 4)} as p_value, {rd('c - q * se', 4)} as ci_lower, {rd('c + q * se', 4)} as ci_upper,
  {p_t('t', 'df')} < 0.05 as significant from ts, best where target = 'charge'""")
def regression_run_tables(spark, sf):
    """The whole analysis with automatic target; its coefficient table."""
    df = reg_lines(spark, sf).drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    run = regression_run(df)
    return rounded(run.tables["coefficients"], 4)


NEARLY = "l_linenumber / 8.0D as u, l_linenumber / 8.0D + (l_partkey % 17 - 8) / 2147483648.0D as w, l_extendedprice / 1000 as y"


@query("ols_nearly_collinear", """
with rows_of as (select l_linenumber / 8.0 as u, cast(l_partkey % 17 - 8 as double) as v, l_extendedprice / 1000 as y from lineitem),
s as (select covar_pop(u, u) as uu, covar_pop(v, v) as vv, covar_pop(u, v) as uv, covar_pop(u, y) as uy, covar_pop(v, y) as vy,
  avg(u) as mu, avg(v) as mv, avg(y) as my from rows_of),
b as (select (uy * vv - vy * uv) / (uu * vv - uv * uv) as bu, (vy * uu - uy * uv) / (uu * vv - uv * uv) as bv, mu, mv, my from s)
select 'const' as variable, round(my - bu * mu - bv * mv, 4) as coefficient from b
union all select 'u', round(bu / 2147483648 - bv, 6) from b union all select 'w', round(bv, 6) from b""")
def ols_nearly_collinear(spark, sf):
    """Two predictors that differ by billionths: the condition is about 1e9, its square beyond double precision."""
    rows = spark.sql(f"select {NEARLY} from {{lineitem}}", lineitem=table(spark, sf, "lineitem"))
    c = reg.fit_ols(rows, "y", ["u", "w"]).coefficients()
    scaled = F.when(F.col("variable") == "const", F.round("coefficient", 4)).otherwise(F.round(F.col("coefficient") / 2147483648, 6))
    return c.select("variable", scaled.alias("coefficient"))
