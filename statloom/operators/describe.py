"""Descriptive statistics: one moments aggregate for all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.frames import as_double, col, local_table
from statloom.operators.ranks import grouped_quantiles, quantiles
from statloom.operators.roles import columns_of


def sample_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness from the population skewness."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis from the population excess kurtosis."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def moment_aggs(x: Column) -> list[Column]:
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"),
        F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"), F.min(x).alias("min"), F.max(x).alias("max"),
    ]


def moments(df: DataFrame, cols: list[str], by: list[str] | None = None, name="variable") -> DataFrame:
    """(by..., variable, n, mean, var, g1, g2, min, max) with population g1 and g2.

    One scan; the columns become rows, so the aggregate code stays small enough
    for the JVM to optimise whatever the number of columns.
    """
    by = by or []
    entries = [F.struct(F.lit(c).alias(name), as_double(df, c).alias("value")) for c in cols]
    long = df.select(*[col(b) for b in by], F.inline(F.array(*entries)))
    out = long.groupBy(*[col(b) for b in by], name).agg(*moment_aggs(F.col("value")))
    return out.withColumns({"var": finite(F.col("var")), "g1": finite(F.col("g1")), "g2": finite(F.col("g2"))})


def descriptives(df: DataFrame, cols: list[str] | None = None, moment_table: DataFrame | None = None) -> DataFrame:
    """(variable, n, mean, median, std, min, max, skewness, kurtosis) of non-empty columns."""
    cols = columns_of(df, "numeric") if cols is None else cols
    table = moments(df, cols) if moment_table is None else moment_table
    medians = local_table(df.sparkSession, [(c, v[0]) for c, v in quantiles(df, cols, [0.5]).items()],
                          "variable string, median double")
    return table.join(F.broadcast(medians), "variable").where(F.col("n") > 0).select(
        "variable", "n", "mean", "median", F.sqrt("var").alias("std"), "min", "max",
        sample_skewness(F.col("n"), F.col("g1")).alias("skewness"),
        sample_kurtosis(F.col("n"), F.col("g2")).alias("kurtosis"),
    )


def descriptives_by(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Descriptives of one column per group."""
    m = moments(df, [value], by).where(F.col("n") > 0)
    medians = grouped_quantiles(df, value, by, [0.5]).select(
        *[col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("q")[0].alias("median")
    )
    match = [col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)]
    return m.join(medians, match).select(
        *[col(b) for b in by], "variable", "n", "mean", "median", F.sqrt("var").alias("std"), "min", "max",
        sample_skewness(F.col("n"), F.col("g1")).alias("skewness"),
        sample_kurtosis(F.col("n"), F.col("g2")).alias("kurtosis"),
    )
