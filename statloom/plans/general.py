"""The general test run and the findings run over a cleaned table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.frames import empty, pin, union_all
from statloom.operators import association, correlation, groups
from statloom.operators.association import top_values
from statloom.operators.describe import descriptives, moments
from statloom.operators.normality import normality
from statloom.operators.roles import analysis_roles, columns_of

TEST_RESULTS = ("test_name string, columns_tested array<string>, statistic double, p_value double, df double, "
                "n long, significant boolean, interpretation string")


@dataclass
class GeneralRun:
    classification: str
    numeric: list[str]
    categorical: list[str]
    normality: DataFrame
    descriptives: DataFrame
    test_results: DataFrame

    def totals(self) -> DataFrame:
        """One row: classification, tests run, significant findings."""
        return self.test_results.agg(
            F.lit(self.classification).alias("classification"), F.count(F.lit(1)).alias("total_tests_run"),
            F.count_if("significant").alias("significant_findings"),
        )


def _moments_once(df: DataFrame) -> tuple[DataFrame | None, list[str]]:
    """Moments of all numeric columns (one row each, pinned) and the columns that vary.

    One scan feeds role selection, normality, correlation and descriptives.
    """
    cols = columns_of(df, "numeric")
    if not cols:
        return None, []
    m = pin(moments(df, cols))
    varying = {r["variable"] for r in m.where(F.col("min") < F.col("max")).select("variable").collect()}
    return m, [c for c in cols if c in varying]


def general_tests(df: DataFrame, max_levels: int = 50, max_groups: int = 20) -> GeneralRun:
    """Normality, correlations, group comparisons, associations and descriptives."""
    if df.limit(2).count() < 2:
        raise ValueError("Need at least 2 rows for statistical analysis.")
    m, varying = _moments_once(df)
    roles = analysis_roles(df, max_levels, numeric=varying)
    label = roles.classification
    parts = []
    if len(roles.numeric) > 1:
        c = correlation.auto_correlation(df, roles.numeric, moment_table=m)
        parts.append(c.select(
            "test_name", F.array("x", "y").alias("columns_tested"), F.col("r").alias("statistic"), "p_value",
            (F.col("n") - 2).cast("double").alias("df"), "n", "significant", "interpretation"))
    if roles.numeric and roles.categorical:
        g = groups.auto_group_tests(df, roles.categorical, roles.numeric, max_groups, levels=roles.levels)
        parts.append(g.select(
            "test_name", F.array("category", "variable").alias("columns_tested"), "statistic", "p_value", "df", "n",
            "significant", "interpretation"))
    if len(roles.categorical) > 1:
        a = association.auto_association(df, roles.categorical, levels=roles.levels)
        parts.append(a.select(
            F.lit("Chi-squared test").alias("test_name"), F.array("col_a", "col_b").alias("columns_tested"),
            "statistic", "p_value", F.col("dof").alias("df"), "n", "significant", "interpretation"))
    results = union_all(parts) if parts else empty(df.sparkSession, TEST_RESULTS)
    spark = df.sparkSession
    if roles.numeric:
        normal, described = normality(df, roles.numeric, m), descriptives(df, roles.numeric, m)
    else:
        normal = empty(spark, "variable string, n long, test string, statistic double, p_value double, is_normal boolean")
        described = empty(spark, "variable string, n long, mean double, median double, std double, min double, "
                                 "max double, skewness double, kurtosis double")
    return GeneralRun(label, roles.numeric, roles.categorical, normal, described, results)


@dataclass
class Findings:
    numeric: list[str]
    categories: list[str]
    normality: DataFrame
    correlations: DataFrame
    group_comparisons: DataFrame
    associations: DataFrame
    distributions: DataFrame
    category_counts: DataFrame


# How many columns each screen looks at; None is all of them.
CAPS = dict.fromkeys(("normality", "correlation", "group_cats", "group_nums", "association", "distributions", "counts"))


def findings(df: DataFrame, caps: dict | None = None) -> Findings:
    """The evidence that chart selection works from."""
    caps = {**CAPS, **(caps or {})}
    spark = df.sparkSession
    m, varying = _moments_once(df)
    roles = analysis_roles(df, max_levels=20, min_levels=2, numeric=varying)
    nums, cats = roles.numeric, roles.categorical
    normal_cols, dist_cols, count_cols = nums[: caps["normality"]], nums[: caps["distributions"]], cats[: caps["counts"]]
    normal = (
        normality(df, normal_cols, m).where("test <> 'skipped'") if normal_cols
        else empty(spark, "variable string, n long, test string, statistic double, p_value double, is_normal boolean")
    )
    dist = (
        descriptives(df, dist_cols, m).where("n >= 5") if dist_cols
        else empty(spark, "variable string, n long, mean double, median double, std double, min double, max double, "
                          "skewness double, kurtosis double")
    )
    counts = [
        top_values(df, c, 15).select(
            F.lit(c).alias("variable"), F.lit(roles.levels[c]).cast("long").alias("n_unique"), "value", "n")
        for c in count_cols
    ]
    return Findings(
        nums, cats, normal,
        correlation.significant_pairs(df, nums, max_cols=caps["correlation"]),
        groups.group_screen(df, cats, nums, max_cats=caps["group_cats"], max_nums=caps["group_nums"], levels=roles.levels),
        association.association_screen(df, cats, max_cols=caps["association"], levels=roles.levels),
        dist,
        union_all(counts) if counts else empty(spark, "variable string, n_unique long, value string, n long"),
    )
