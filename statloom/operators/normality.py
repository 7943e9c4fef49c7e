"""Normality tests per column and per group.

Shapiro-Wilk needs the sorted sample but only runs on groups below 5000 rows;
the omnibus test for larger groups is a closed form over four moments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.frames import col, pin, settle, union_all, unpivot_numeric
from statloom.functions.special import horner, norm_upper, with_norm_ppf
from statloom.operators.describe import moments

MIN_ROWS = 8
LARGE_ROWS = 5000
ALPHA = 0.05


def _sgn(c: Column) -> Column:
    return F.when(c < 0, -1.0).otherwise(1.0)


def omnibus_columns(n: Column, g1: Column, g2: Column) -> tuple[Column, Column, Column]:
    """(Z of skewness, Z of kurtosis, K2) from count and population moments (n >= 8)."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1.0 + F.sqrt(2.0 * (beta - 1))
    alpha = F.sqrt(2.0 / (w2 - 1))
    z1 = F.asinh(y / alpha) / F.sqrt(0.5 * F.log(w2))
    b2 = g2 + 3.0
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    root_b = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root_b * (2.0 / root_b + F.sqrt(1.0 + 4.0 / (root_b * root_b)))
    d = 1.0 + x * F.sqrt(2.0 / (a - 4.0))
    cube = F.when(d != 0, _sgn(d) * F.pow((1.0 - 2.0 / a) / F.abs(F.when(d != 0, d)), F.lit(1.0 / 3.0)))
    z2 = (1.0 - 2.0 / (9.0 * a) - cube) / F.sqrt(2.0 / (9.0 * a))
    return z1, z2, z1 * z1 + z2 * z2


def omnibus(moment_table: DataFrame, keys: list[str]) -> DataFrame:
    """D'Agostino-Pearson K2 over a moments table with at least 8 rows per key."""
    _, _, k2 = omnibus_columns(F.col("n"), F.col("g1"), F.col("g2"))
    return moment_table.where(F.col("n") >= MIN_ROWS).select(*keys, "n", k2.alias("statistic")).select(
        *keys, "n", F.lit("D'Agostino-Pearson").alias("test"), "statistic",
        F.exp(-F.col("statistic") / 2.0).alias("p_value"),
    )


# AS R94 polynomial coefficients (Royston 1995), lowest order first.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_GAMMA = [-2.273, 0.459]
SMALL_MEAN = [0.5440, -0.39978, 0.025054, -6.714e-4]
SMALL_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_SD = [-0.4803, -0.082676, 0.0030302]


def shapiro(long: DataFrame, keys: list[str]) -> DataFrame:
    """Shapiro-Wilk on a long frame (keys..., value); groups of 8 to 4999 rows.

    One window over (keys) and one aggregate on the same partitioning.  The
    caller passes only groups it knows to be below 5000 rows.
    """
    group = Window.partitionBy(*keys)
    ranked = long.select(
        *keys, "value",
        F.row_number().over(group.orderBy("value")).alias("i"),
        F.count(F.lit(1)).over(group).cast("double").alias("n"),
        F.avg("value").over(group).alias("centre"),
    ).where((F.col("n") >= MIN_ROWS) & (F.col("n") < LARGE_ROWS))
    scored = with_norm_ppf(
        ranked.withColumn("x", F.col("value") - F.col("centre")), (F.col("i") - 0.375) / (F.col("n") + 0.25), "m"
    )
    inner = (F.col("i") > 2) & (F.col("i") < F.col("n") - 1)
    at = lambda pos, what: F.max(F.when(F.col("i") == pos, F.col(what)))
    n = F.col("n")
    sums = scored.groupBy(*keys, "n").agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum(F.when(inner, F.col("m") * F.col("x"))).alias("mx"),
        F.sum(F.col("x") * F.col("x")).alias("ss"),
        (F.max("x") - F.min("x")).alias("span"),
        (at(n, "x") - at(F.lit(1), "x")).alias("outer_gap"),
        (at(n - 1, "x") - at(F.lit(2), "x")).alias("next_gap"),
        at(n, "m").alias("m_last"), at(n - 1, "m").alias("m_next"),
    )
    u = 1.0 / F.sqrt(n)
    last = F.col("m_last") / F.sqrt("mm") + horner(LAST_WEIGHT, u)
    nxt = F.col("m_next") / F.sqrt("mm") + horner(NEXT_WEIGHT, u)
    weighted = sums.withColumns({"a_last": last, "a_next": nxt}).withColumn(
        "phi",
        (F.col("mm") - 2 * F.col("m_last") ** 2 - 2 * F.col("m_next") ** 2)
        / (1.0 - 2 * F.col("a_last") ** 2 - 2 * F.col("a_next") ** 2),
    )
    top = F.col("mx") / F.sqrt("phi") + F.col("a_last") * F.col("outer_gap") + F.col("a_next") * F.col("next_gap")
    flat = F.col("span") == 0
    w = F.when(flat, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * top / F.when(~flat, F.col("ss"))))
    stat = weighted.select(*keys, n.cast("long").alias("n"), flat.alias("flat"), w.alias("statistic"))
    return stat.select(
        *keys, "n", F.lit("Shapiro-Wilk").alias("test"), "statistic",
        F.when(F.col("flat"), F.lit(1.0)).otherwise(norm_upper(shapiro_z(F.col("n"), F.col("statistic")))).alias("p_value"),
    )


def shapiro_z(n: Column, w: Column) -> Column:
    n = n.cast("double")
    left = F.log(F.greatest(1.0 - w, F.lit(1e-300)))
    gamma = horner(SMALL_GAMMA, n)
    room = F.when(gamma > left, gamma - left)
    small = F.when(room.isNotNull(), (-F.log(room) - horner(SMALL_MEAN, n)) / F.exp(horner(SMALL_SD, n))).otherwise(40.0)
    ln = F.log(n)
    large = (left - horner(LARGE_MEAN, ln)) / F.exp(horner(LARGE_SD, ln))
    return F.when(n <= 11, small).otherwise(large)


def _verdict(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys, "n", "test", "statistic", "p_value",
        F.coalesce(F.col("p_value") > ALPHA, F.lit(False)).alias("is_normal"),
    )


def _skipped(moment_table: DataFrame, keys: list[str]) -> DataFrame:
    none = F.lit(None).cast("double")
    return moment_table.where(F.col("n") < MIN_ROWS).select(
        *keys, "n", F.lit("skipped").alias("test"), none.alias("statistic"), none.alias("p_value")
    )


def _parts(long, moment_table: DataFrame, keys: list[str], sizes: list[int] | None) -> DataFrame:
    """Union of the tests that apply; `sizes` are the group sizes when they are known."""
    n = F.col("n")
    some = lambda lo, hi: sizes is None or any(lo <= k < hi for k in sizes)
    parts = []
    if some(LARGE_ROWS, float("inf")):
        parts.append(omnibus(moment_table.where(n >= LARGE_ROWS), keys))
    if some(MIN_ROWS, LARGE_ROWS):
        small = moment_table.where(n.between(MIN_ROWS, LARGE_ROWS - 1)).select(*keys)
        parts.append(shapiro(long(small), keys))
    if not parts or some(0, MIN_ROWS):
        parts.append(_skipped(moment_table, keys))
    return _verdict(union_all(parts), keys)


def normality(df: DataFrame, cols: list[str], moment_table: DataFrame | None = None) -> DataFrame:
    """(variable, n, test, statistic, p_value, is_normal), one row per column.

    Fewer than 8 values: skipped, not normal.  Below 5000: Shapiro-Wilk.  Else K2.
    A pinned moments table of the same columns saves a scan.
    """
    m = pin(moments(df, cols)) if moment_table is None else moment_table.where(F.col("variable").isin(cols))
    sizes = {r["variable"]: r["n"] for r in m.select("variable", "n").collect()}
    small = [c for c, n in sizes.items() if MIN_ROWS <= n < LARGE_ROWS]
    return _parts(lambda _: unpivot_numeric(df, small), m, ["variable"], list(sizes.values()))


def grouped_normality(long: DataFrame, moment_table: DataFrame, keys: list[str], pinned: bool = False) -> DataFrame:
    """Normality per key over a long frame (keys..., value) and its moments table.

    Only the rows of groups below 5000 are sorted; larger groups never leave
    the moments aggregate.  `pinned` tells that the moments are a local table.
    """
    sizes = [r["n"] for r in moment_table.select("n").collect()] if pinned else None

    def rows(small: DataFrame) -> DataFrame:
        return long.join(small if pinned else settle(small), keys, "left_semi")

    return _parts(rows, moment_table, keys, sizes)


def normality_by(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """(group, variable, n, test, statistic, p_value, is_normal) per column and group."""
    source = df.where(col(by).isNotNull())
    keyed = source.withColumn("_group", col(by).cast("string"))
    m = moments(keyed, cols, ["_group"]).withColumnRenamed("_group", "group").where(F.col("n") > 0)
    long = unpivot_numeric(source, cols, keep=(col(by).cast("string").alias("group"),))
    return grouped_normality(long, m, ["group", "variable"])
