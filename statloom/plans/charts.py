"""Chart selection from findings, and the data of each selected chart."""

from __future__ import annotations

from pyspark.sql import DataFrame

from statloom.functions.frames import local_table
from statloom.operators import chartdata
from statloom.operators.regression import OLSFit
from statloom.plans.general import Findings

PLAN = "position int, kind string, columns array<string>, title string"


#: How many charts of a kind a plan has, how many columns share one chart, and how many categories a radar shows; None is all.
LIMITS = dict.fromkeys(("scatter", "violin", "stacked", "histogram_columns", "qq", "radar_metrics", "radar_categories"))
#: The limits of a plan that fits one page.
ONE_PAGE = {"scatter": 3, "violin": 3, "stacked": 2, "histogram_columns": 4, "qq": 1, "radar_metrics": 5, "radar_categories": 6}


def select_charts(found: Findings, limits: dict | None = None) -> list[tuple[str, list[str], str]]:
    """(kind, columns, title) in display order; findings are a row per tested pair of columns, already ranked."""
    most = {**LIMITS, **(limits or {})}
    corr = found.correlations.collect()[: most["scatter"]]
    group = found.group_comparisons.collect()
    assoc = found.associations.collect()[: most["stacked"]]
    normal = {r["variable"]: r["is_normal"] for r in found.normality.collect()}
    dist = [r["variable"] for r in found.distributions.collect()]
    dist = [c for c in found.numeric if c in dist]
    order = [c for c in found.numeric if c in normal]
    first_cat = found.categories[0] if found.categories else None
    plan = [("scatter", [r["x"], r["y"], *([first_cat] if first_cat else [])], f"Correlation: {r['x']} vs {r['y']}")
            for r in corr]
    plan += [("violin", [r["variable"], r["category"]], f"Group Test: {r['variable']} by {r['category']}")
             for r in group[: most["violin"]]]
    plan += [("stacked", [r["col_a"], r["col_b"]], f"Association: {r['col_a']} vs {r['col_b']}") for r in assoc]
    if dist:
        plan.append(("histogram", dist[: most["histogram_columns"]], "Distributions & Normality"))
    odd = [c for c in order if not normal[c]]
    plan += [("qq", [c], f"QQ Plot: {c}") for c in odd[: most["qq"]]]
    if len(found.numeric) >= 3:
        plan.append(("heatmap", found.numeric, "Correlation Matrix"))
    if first_cat:
        plan.append(("donut", [first_cat], f"{first_cat} Breakdown"))
    if group and len(found.numeric) >= 3:
        # the category of the strongest difference, with the columns it tells apart; too few of them: any columns
        best = group[0]["category"]
        apart = [r["variable"] for r in group if r["category"] == best]
        shown = apart if len(apart) >= 3 else found.numeric[: most["radar_metrics"]]
        plan.append(("radar", [best, *shown], f"Radar: {best} Comparison"))
    if assoc:
        a, b = assoc[0]["col_a"], assoc[0]["col_b"]
        plan.append(("sunburst", [a, b], f"Sunburst: {a} -> {b}"))
    return plan


def chart_plan(found: Findings, spark, limits: dict | None = None) -> DataFrame:
    """(position, kind, columns, title): what to draw, in order."""
    return local_table(spark, [(i + 1, k, c, t) for i, (k, c, t) in enumerate(select_charts(found, limits))], PLAN)


def chart_tables(df: DataFrame, found: Findings, limits: dict | None = None) -> dict[str, DataFrame]:
    """{title: data} of every selected chart."""
    out = {}
    for kind, cols, title in select_charts(found, limits):
        if kind == "scatter":
            out[title] = chartdata.scatter(df, cols[0], cols[1], cols[2] if len(cols) > 2 else None)
        elif kind == "violin":
            out[title] = chartdata.violin(df, cols[0], cols[1])
        elif kind == "stacked":
            out[title] = chartdata.stacked_percent(df, *cols)
        elif kind == "histogram":
            out[title] = chartdata.histogram(df, cols, bins=None)
        elif kind == "qq":
            out[title] = chartdata.qq(df, cols[0], min_rows=11)
        elif kind == "heatmap":
            out[title] = chartdata.heatmap(df, cols)
        elif kind == "donut":
            out[title] = chartdata.pie_shares(df, cols[0])
        elif kind == "radar":
            out[title] = chartdata.radar(df, cols[0], cols[1:], k=(limits or {}).get("radar_categories"))
        else:
            out[title] = chartdata.hierarchy(df, cols)
    return out


def regression_tables(fit: OLSFit) -> dict[str, DataFrame]:
    """{title: data} of the regression charts; lag charts need an ordered fit."""
    out = {
        f"Actual vs Predicted: {fit.target}": chartdata.actual_vs_predicted(fit),
        "Residuals vs Fitted": chartdata.residuals_vs_fitted(fit),
        "Residual Distribution": chartdata.residual_histogram(fit),
        "Coefficient Plot": chartdata.coefficient_bars(fit),
    }
    if fit.n > 5:
        out["QQ Plot: Residuals"] = chartdata.residual_qq_line(fit)
    if fit.order_by is not None and fit.n_lags >= 2:
        out["ACF / PACF: Residuals"] = chartdata.lag_bars(fit)
    if len(fit.predictors) > 1:
        out["VIF: Multicollinearity"] = chartdata.vif_bars(fit)
        out["Correlation Matrix"] = chartdata.heatmap(fit.source, [fit.target, *fit.predictors])
    return out
