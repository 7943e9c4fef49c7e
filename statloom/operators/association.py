"""Categorical association: contingency counts, chi-squared, Cramer's V, top values."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.frames import broadcast_if_small, col, div, empty, pin
from statloom.functions.special import chi2_pvalue
from statloom.operators.roles import columns_of, level_counts

ALPHA = 0.05
PAIR = ["col_a", "col_b"]


def crosstab(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, a, b, n): counts of value pairs, null pairs dropped.

    Each task counts its own rows before the shuffle, so a cell that holds most
    of the rows is one partial count per task.
    """
    entries = [
        F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"),
                 col(x).cast("string").alias("a"), col(y).cast("string").alias("b"))
        for x, y in pairs
    ]
    return (
        df.select(F.inline(F.array(*entries))).where("a is not null and b is not null")
        .groupBy(*PAIR, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    )


def chi_squared(table: DataFrame) -> DataFrame:
    """(col_a, col_b, n, rows, cols, statistic, dof, p_value) from crosstab counts.

    Empty cells need no rows: sum over filled cells of (O-E)^2/E plus the
    expected mass of the empty ones.  With one degree of freedom all four cells
    share |O-E|, which gives the continuity-corrected form directly.  The
    margins are tables of their own, joined to the cells, so the cells of a
    wide pair, or of a value that meets very many others, are never in one task.
    """
    table = pin(table)
    row_sums = table.groupBy(*PAIR, "a").agg(F.sum("n").alias("row_n"))
    col_sums = table.groupBy(*PAIR, "b").agg(F.sum("n").alias("col_n"))
    sides = row_sums.groupBy(*PAIR).agg(
        F.sum("row_n").alias("total"), F.count(F.lit(1)).alias("rows"), F.sum(1.0 / F.col("row_n")).alias("inv_rows"))
    sides = pin(sides.join(col_sums.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("cols"), F.sum(1.0 / F.col("col_n")).alias("inv_cols")), PAIR))
    cells = (
        table.join(broadcast_if_small(row_sums, table), [*PAIR, "a"]).join(broadcast_if_small(col_sums, table), [*PAIR, "b"])
        .join(broadcast_if_small(sides), PAIR)
    )
    expected = F.col("row_n") * (F.col("col_n") / F.col("total"))
    gap = F.col("n") - expected
    sums = cells.groupBy(*PAIR, "total", "rows", "cols", "inv_rows", "inv_cols").agg(
        F.sum(gap * gap / expected).alias("filled"), F.sum(expected).alias("covered"),
        F.max(F.abs(gap)).alias("shift"),
    ).where("rows >= 2 and cols >= 2")
    dof = ((F.col("rows") - 1) * (F.col("cols") - 1)).cast("double")
    kept = F.col("shift") - F.least(F.lit(0.5), F.col("shift"))
    corrected = kept * kept * F.col("total") * F.col("inv_rows") * F.col("inv_cols")
    plain = F.col("filled") + (F.col("total") - F.col("covered"))
    stat = sums.select(
        *PAIR, F.col("total").alias("n"), "rows", "cols",
        F.when(dof == 1, corrected).otherwise(plain).alias("statistic"), dof.alias("dof"),
    )
    return stat.withColumn("p_value", chi2_pvalue("statistic", "dof"))


def cramers_v(chi: DataFrame) -> DataFrame:
    """Add V and its strength label to a chi-squared table."""
    v = F.sqrt(div(F.col("statistic"), F.col("n") * (F.least("rows", "cols") - 1)))
    return chi.withColumn("cramers_v", v).withColumn(
        "strength", F.when(F.col("cramers_v") > 0.3, "strong").when(F.col("cramers_v") > 0.1, "moderate").otherwise("weak")
    )


CHI_SCHEMA = ("col_a string, col_b string, n long, rows long, cols long, statistic double, dof double, p_value double")


def _pairs(df: DataFrame, cols, lo: int, hi: int, max_cols=None, levels=None):
    cols = columns_of(df, "categorical") if cols is None else cols
    levels = level_counts(df, cols, hi) if levels is None else levels
    near = [c for c in cols if levels.get(c) is not None and lo <= levels[c] <= hi]
    return list(combinations(near[:max_cols], 2))


def auto_association(df: DataFrame, cols: list[str] | None = None, max_levels: int = 20,
                     levels: dict | None = None) -> DataFrame:
    """Chi-squared test of every pair of text columns with at most 20 levels."""
    pairs = _pairs(df, cols, 1, max_levels, levels=levels)
    if not pairs:
        return empty(df.sparkSession, CHI_SCHEMA + ", significant boolean, interpretation string")
    table = chi_squared(crosstab(df, pairs))
    significant = F.coalesce(F.col("p_value") < ALPHA, F.lit(False))
    text = F.format_string(
        "Chi-squared: %s association between %s and %s (chi2=%.3f, p=%.4f, dof=%d)",
        F.when(significant, "significant").otherwise("not significant"), F.col("col_a"), F.col("col_b"),
        F.col("statistic"), F.col("p_value"), F.col("dof").cast("int"),
    )
    return table.withColumns({"significant": significant, "interpretation": text})


def association_screen(df: DataFrame, cols: list[str] | None = None, max_levels: int = 20,
                       max_cols: int | None = None, levels: dict | None = None) -> DataFrame:
    """Significant associations with Cramer's V, smallest p first."""
    pairs = _pairs(df, cols, 2, max_levels, max_cols, levels)
    if not pairs:
        return empty(df.sparkSession, CHI_SCHEMA + ", cramers_v double, strength string")
    return cramers_v(chi_squared(crosstab(df, pairs))).where(F.col("p_value") < ALPHA).orderBy("p_value", *PAIR)


def row_percent(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, percent): share of each b within its a."""
    table = pin(crosstab(df, [(a, b)]))
    within = table.groupBy("a").agg(F.sum("n").alias("within"))
    joined = table.join(broadcast_if_small(within, table), "a")
    return joined.select("a", "b", "n", (F.col("n") / F.col("within") * 100.0).alias("percent"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, n): the k most frequent values; ties go to the smaller value."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)
