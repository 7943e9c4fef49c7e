"""The full run: profile, clean, mask and load, test or regress, chart data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from statloom.functions.frames import cut
from statloom.operators import profile as prof
from statloom.operators.clean import Cleaned, clean
from statloom.operators.correlation import correlations_with
from statloom.operators.describe import descriptives
from statloom.operators.pii import masking_summary, pii_map
from statloom.operators.regression import OLSFit, fit_ols
from statloom.operators.roles import analysis_roles
from statloom.plans.charts import chart_tables, regression_tables
from statloom.plans.general import Findings, GeneralRun, findings, general_tests
from statloom.sources.writers import load_tables, write_cleaned, write_masked


@dataclass
class RegressionRun:
    fit: OLSFit
    tables: dict[str, DataFrame]
    categorical: list[str]


def regression_run(df: DataFrame, target: str | None = None, order_by: list[str] | None = None,
                   written: bool = False) -> RegressionRun:
    """Fit, diagnostics, descriptives and target correlations over the complete rows.

    Every diagnostic is a scan, so the frame is written once, unless it is `written` already.
    """
    df = df if written else cut(df, "to-regress")
    fit = fit_ols(df, target, order_by=order_by)
    used = [fit.target, *fit.predictors]
    tables = {
        "model_summary": fit.model_summary(), "coefficients": fit.coefficients(), "vif": fit.vif(),
        "residual_diagnostics": fit.residual_diagnostics(), "residual_stats": fit.residual_stats(),
        "assumptions": fit.assumptions(), "descriptives": descriptives(fit.source, used),
        "correlations_with_target": correlations_with(fit.source, fit.target, used),
    }
    if order_by is not None:
        tables["acf_pacf"] = fit.acf_pacf()
    return RegressionRun(fit, tables, analysis_roles(df).categorical)


@dataclass
class FullRun:
    profile: dict[str, DataFrame]
    cleaned: Cleaned
    pii: dict[str, str]
    general: GeneralRun | None = None
    findings: Findings | None = None
    regression: RegressionRun | None = None
    manifest: DataFrame | None = None
    charts: dict[str, DataFrame] = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)


def analyse(df: DataFrame, mode: str = "general", cleaning: dict | None = None, target: str | None = None,
            order_by: list[str] | None = None, load_as: str | None = None, design: dict | None = None,
            write_to: str | None = None, name: str = "table", fmt: str = "parquet", salt: str | None = None,
            chart_limits: dict | None = None) -> FullRun:
    """Run everything on one table.

    mode "general" runs the test battery and chart selection, "regression" the
    OLS analysis.  `load_as` is the file name that a database load is named
    after; without it nothing is loaded.  Sample rows need `order_by`.  `write_to`
    is the folder for the cleaned and, where personal data was found, the masked
    file; `files` holds their paths.  `chart_limits` bounds the charts of a kind
    (see `charts.LIMITS`).
    """
    if mode not in ("general", "regression"):
        raise ValueError(f"unknown mode {mode!r}")
    pii = pii_map(df)
    tables = {
        "columns": prof.column_profile(df, pii), "summary": prof.table_summary(df, pii),
        "describe": prof.describe(df, pii), "categories": prof.top_categories(df, pii=pii),
        "quality": prof.quality_issues(df), "masking": masking_summary(df, pii),
    }
    if order_by:
        tables["samples"] = prof.sample_values(df, order_by, pii=pii)
    done = clean(df, cleaning)
    # every later operator scans this table, so it is written once
    done = Cleaned(cut(done.df, "cleaned"), done.report)
    run = FullRun(tables, done, pii_map(done.df))
    if write_to:
        run.files["cleaned"] = write_cleaned(done.df, write_to, name, fmt)
        masked = write_masked(done.df, write_to, name, fmt, run.pii, salt)
        if masked:
            run.files["masked"] = masked
    if load_as:
        run.manifest = load_tables(done.df, load_as, design, pii=run.pii, salt=salt)
    if mode == "regression":
        run.regression = regression_run(done.df, target, order_by, written=True)
        run.charts = regression_tables(run.regression.fit)
    else:
        run.general = general_tests(done.df)
        run.findings = findings(done.df)
        run.charts = chart_tables(done.df, run.findings, chart_limits)
    return run
