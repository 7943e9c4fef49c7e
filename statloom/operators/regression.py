"""Ordinary least squares with diagnostics.

Four scans whatever the row count: column centres, a QR factor, residual sums,
and (when an order is given) lag products.  The p x p algebra runs on the driver; predictions and residuals are column expressions over the source rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import special
from statloom.functions.frames import as_double, chunks, col, local_table
from statloom.operators.correlation import pair_aggregate
from statloom.operators.gram import column_means
from statloom.operators.ordered import LagSums, lag_sums, partial_autocorrelation
from statloom.operators.roles import varying_numeric
from statloom.operators.tallskinny import triangular_factor

ALPHA = 0.05
MAX_LAGS = 20
# Singular values of the scaled predictors (and, for VIF, shares left unexplained) below this, times p, count as
# exact collinearity.
RANK_TOLERANCE = 1e-12


def target_scores(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(variable, position, mean_abs_r, chosen): which column the others explain best."""
    cols = varying_numeric(df) if cols is None else cols
    if len(cols) < 2:
        raise ValueError(f"Need at least 2 numeric columns for regression analysis, got {cols}.")
    half = pair_aggregate(df, list(combinations(cols, 2)))
    sides = half.select(F.inline(F.array(
        F.struct(F.col("x").alias("variable"), F.col("r")), F.struct(F.col("y").alias("variable"), F.col("r")),
    )))
    place = local_table(df.sparkSession, [(c, i) for i, c in enumerate(cols)], "variable string, position int")
    scores = sides.groupBy("variable").agg(F.avg(F.abs("r")).alias("mean_abs_r")).join(F.broadcast(place), "variable")
    # one row per column; equal scores go to the earlier column
    first = Window.orderBy(F.desc_nulls_last(F.round("mean_abs_r", 12)), "position")
    return scores.select("variable", "position", "mean_abs_r", (F.row_number().over(first) == 1).alias("chosen"))


def choose_target(df: DataFrame, cols: list[str] | None = None) -> str:
    return target_scores(df, cols).where("chosen").first()["variable"]


def _or_none(v):
    return None if v is None or not math.isfinite(v) else float(v)


@dataclass
class OLSFit:
    """A fitted model: small arrays on the driver, rows still in `source`."""

    source: DataFrame  # complete rows: target, predictors and any carried columns
    target: str
    predictors: list[str]
    n: int
    means: np.ndarray  # target first
    centred: np.ndarray  # centred cross products, target first
    beta: np.ndarray  # intercept first
    unscaled_cov: np.ndarray  # (X'X)^+, intercept first
    rank: int  # including the intercept
    factor: np.ndarray  # triangular factor of the centred predictors
    order_by: list[str] | None = None
    _lags: dict = field(default_factory=dict)

    # --- row-level expressions ---

    def predicted(self) -> Column:
        # centred form keeps digits when predictors are large
        x = self.means[1:]
        base = float(self.beta[0] + x @ self.beta[1:])
        out = F.lit(base)
        for name, b, m in zip(self.predictors, self.beta[1:], x):
            out = out + F.lit(float(b)) * (as_double(self.source, name) - F.lit(float(m)))
        return out

    def residual(self) -> Column:
        return as_double(self.source, self.target) - self.predicted()

    def predictions(self, keep: list[str] | None = None) -> DataFrame:
        """(keep..., actual, predicted, residual), lazily."""
        actual = as_double(self.source, self.target)
        rows = self.source.select(
            *[col(c) for c in keep or []], actual.alias("actual"), self.predicted().alias("predicted")
        )
        return rows.withColumn("residual", F.col("actual") - F.col("predicted"))

    # --- residual sums: one scan ---

    @cached_property
    def sums(self) -> dict:
        e, f = F.col("e"), F.col("f")
        xs = [(as_double(self.source, c) - F.lit(float(m))).alias(f"z{i}")
              for i, (c, m) in enumerate(zip(self.predictors, self.means[1:]))]
        rows = self.source.select(self.residual().alias("e"), self.predicted().alias("f"), *xs)
        bend = (f - F.lit(float(self.means[0]))) * (f - F.lit(float(self.means[0])))
        aggs = {
            "s1": F.sum(e), "s2": F.sum(e * e), "s3": F.sum(e * e * e), "s4": F.sum(e * e * e * e),
            "low": F.min(e), "high": F.max(e), "g1": F.sum(bend), "g2": F.sum(bend * bend), "eg": F.sum(e * bend),
        }
        out = dict(rows.agg(*[a.alias(k) for k, a in aggs.items()]).first().asDict())
        for part in chunks(range(len(self.predictors)), 20):
            row = rows.agg(*[F.sum(e * e * F.col(f"z{i}")).alias(f"ez{i}") for i in part]).first()
            out.update(row.asDict())
        return out

    @cached_property
    def residual_moments(self) -> dict:
        s, n = self.sums, self.n
        mean = s["s1"] / n
        m2 = max(0.0, s["s2"] / n - mean**2)
        m3 = s["s3"] / n - 3 * mean * s["s2"] / n + 2 * mean**3
        m4 = s["s4"] / n - 4 * mean * s["s3"] / n + 6 * mean**2 * s["s2"] / n - 3 * mean**4
        skew = m3 / m2**1.5 if m2 > 0 else math.nan
        kurt = m4 / m2**2 if m2 > 0 else math.nan
        return {"mean": mean, "std": math.sqrt(m2), "skewness": skew, "kurtosis": kurt,
                "min": s["low"], "max": s["high"]}

    @property
    def ssr(self) -> float:
        return self.sums["s2"]

    @property
    def sst(self) -> float:
        return float(self.centred[0, 0])

    @property
    def df_resid(self) -> int:
        return self.n - self.rank

    @property
    def spark(self):
        return self.source.sparkSession

    # --- result tables ---

    def model_summary(self) -> DataFrame:
        n, k = self.n, self.rank
        r2 = 1.0 - self.ssr / self.sst if self.sst > 0 else math.nan  # a constant target has nothing to explain
        df_model = k - 1
        adj = 1.0 - (n - 1) / self.df_resid * (1.0 - r2) if self.df_resid > 0 else math.nan
        f = (max(0.0, self.sst - self.ssr) / df_model) / (self.ssr / self.df_resid) if (
            df_model > 0 and self.df_resid > 0 and self.ssr > 0) else math.nan
        llf = -n / 2 * (math.log(2 * math.pi) + math.log(self.ssr / n) + 1) if self.ssr > 0 else math.nan
        fp = special._f_upper(f, df_model, self.df_resid)
        z = self._omnibus()
        return local_table(
            self.spark, [(self.target, n, len(self.predictors), *map(_or_none, (
                r2, adj, f, fp, -2 * llf + 2 * k, -2 * llf + k * math.log(n), llf, *z, self.condition_number())))],
            "target string, n_observations long, n_predictors int, r_squared double, adj_r_squared double, "
            "f_statistic double, f_pvalue double, aic double, bic double, log_likelihood double, "
            "omnibus double, omnibus_pvalue double, condition_number double",
        )

    def _omnibus(self) -> tuple[float, float]:
        m, n = self.residual_moments, float(self.n)
        if n < 8 or not math.isfinite(m["skewness"]):
            return math.nan, math.nan
        return special.omnibus(n, m["skewness"], m["kurtosis"])

    def condition_number(self) -> float:
        """Ratio of extreme singular values of the design matrix, from a triangular factor."""
        x = self.means[1:]
        if self.rank < len(x) + 1:
            return math.inf
        top = np.concatenate([[1.0], x]) * math.sqrt(self.n)
        factor = np.vstack([top, np.column_stack([np.zeros(len(x)), self.factor])])
        values = np.linalg.svd(factor, compute_uv=False)
        return float(values[0] / values[-1])

    def coefficients(self) -> DataFrame:
        """(position, variable, coefficient, std_error, t_statistic, p_value, ci_lower, ci_upper, significant)."""
        scale = self.ssr / self.df_resid if self.df_resid > 0 else math.nan
        quantile = special.t_quantile(1 - ALPHA / 2, self.df_resid) if self.df_resid > 0 else math.nan
        rows = []
        for i, name in enumerate(["const", *self.predictors]):
            b = float(self.beta[i])
            se = math.sqrt(max(0.0, scale * self.unscaled_cov[i, i]))
            t = b / se if se > 0 else math.nan
            p = special._t_two_sided(t, self.df_resid)
            rows.append((i, name, b, _or_none(se), _or_none(t), _or_none(p),
                         _or_none(b - quantile * se), _or_none(b + quantile * se), bool(p < ALPHA)))
        return local_table(
            self.spark, rows, "position int, variable string, coefficient double, std_error double, t_statistic double, "
                  "p_value double, ci_lower double, ci_upper double, significant boolean")

    def vif(self) -> DataFrame:
        """(variable, vif, multicollinearity); an exactly collinear predictor has null and 'severe'."""
        rows = []
        if len(self.predictors) > 1:
            s = self.centred[1:, 1:]
            scale = np.sqrt(np.diag(s))
            r = s / np.outer(np.where(scale > 0, scale, 1.0), np.where(scale > 0, scale, 1.0))
            for i, name in enumerate(self.predictors):
                if not scale[i] > 0:  # constant on the complete rows: no figure, and no say in the others'
                    rows.append((name, None, "constant"))
                    continue
                others = [j for j in range(len(r)) if j != i and scale[j] > 0]
                if not others:
                    rows.append((name, 1.0, "low"))
                    continue
                sub, cross = r[np.ix_(others, others)], r[others, i]
                left = 1.0 - cross @ np.linalg.pinv(sub, rcond=RANK_TOLERANCE, hermitian=True) @ cross
                v = 1.0 / left if left > RANK_TOLERANCE * len(r) else math.inf
                rows.append((name, _or_none(v), "severe" if v > 10 else "moderate" if v > 5 else "low"))
        return local_table(self.spark, rows, "variable string, vif double, multicollinearity string")

    def _lag(self, lags: int) -> LagSums:
        if self.order_by is None:
            raise ValueError("this diagnostic depends on row order: fit with order_by=[...]")
        if lags not in self._lags:
            mean = self.sums["s1"] / self.n
            self._lags[lags] = lag_sums(self.source, self.residual() - F.lit(mean), self.order_by, lags, self.n)
        return self._lags[lags]

    @property
    def n_lags(self) -> int:
        return min(MAX_LAGS, self.n // 3)

    def durbin_watson(self) -> float:
        return self._lag(max(1, self.n_lags)).squared_steps / self.ssr if self.ssr > 0 else math.nan

    def jarque_bera(self) -> tuple[float, float]:
        m = self.residual_moments
        jb = self.n / 6.0 * (m["skewness"] ** 2 + (m["kurtosis"] - 3) ** 2 / 4)
        return jb, math.exp(-jb / 2)

    def breusch_pagan(self) -> tuple[float, float]:
        """n * R2 of the squared residuals on the predictors; (0, 1) when undefined."""
        p = len(self.predictors)
        cross = np.array([self.sums[f"ez{i}"] for i in range(p)])
        spread = self.sums["s4"] - self.sums["s2"] ** 2 / self.n
        s = self.centred[1:, 1:]
        scale = np.sqrt(np.diag(s))
        spread_out = scale > 0  # predictors that are constant on the complete rows have no part in it
        if spread <= 0 or not spread_out.any():
            return 0.0, 1.0
        p = int(spread_out.sum())
        scale, cross, s = scale[spread_out], cross[spread_out], s[np.ix_(spread_out, spread_out)]
        c = cross / scale
        r = s / np.outer(scale, scale)
        stat = self.n * float(c @ np.linalg.pinv(r, rcond=RANK_TOLERANCE, hermitian=True) @ c) / spread
        return stat, special._chi2_upper(stat, p)

    def residual_diagnostics(self) -> DataFrame:
        """(test, statistic, p_value, verdict); Durbin-Watson only when an order is known."""
        rows = []
        if self.order_by is not None:
            dw = self.durbin_watson()
            rows.append(("Durbin-Watson", _or_none(dw), None,
                         "positive autocorrelation" if dw < 1.5 else "no autocorrelation" if dw <= 2.5
                         else "negative autocorrelation"))
        jb, p = self.jarque_bera()
        rows.append(("Jarque-Bera", _or_none(jb), _or_none(p), "normal" if p > ALPHA else "not normal"))
        bp, p = self.breusch_pagan()
        rows.append(("Breusch-Pagan", _or_none(bp), _or_none(p),
                     "homoscedastic" if p > ALPHA else "heteroscedastic"))
        return local_table(self.spark, rows, "test string, statistic double, p_value double, verdict string")

    def residual_stats(self) -> DataFrame:
        """mean, population std, min, max, skewness and (non-excess) kurtosis of the residuals."""
        m = self.residual_moments
        return local_table(
            self.spark, [tuple(_or_none(m[k]) for k in ("mean", "std", "min", "max", "skewness", "kurtosis"))],
            "mean double, std double, min double, max double, skewness double, kurtosis double")

    def acf_pacf(self) -> DataFrame:
        """(lag, acf, pacf, band, acf_outside, pacf_outside); empty below 2 lags."""
        rows = []
        if self.n_lags >= 2:
            acf = self._lag(self.n_lags).acf
            pacf = partial_autocorrelation(acf)
            band = 1.96 / math.sqrt(self.n)
            rows = [(k, _or_none(a), _or_none(b), band, k > 0 and abs(a) > band, k > 0 and abs(b) > band)
                    for k, (a, b) in enumerate(zip(map(float, acf), map(float, pacf)))]
        return local_table(
            self.spark, rows, "lag int, acf double, pacf double, band double, acf_outside boolean, pacf_outside boolean")

    def assumptions(self) -> DataFrame:
        """(assumption, measure, value, met, suggestion) from fixed rules over the diagnostics."""
        s, n = self.sums, self.n
        cov = s["eg"] - s["s1"] * s["g1"] / n
        spread = (s["s2"] - s["s1"] ** 2 / n) * (s["g2"] - s["g1"] ** 2 / n)
        bend = cov / math.sqrt(spread) if spread > 0 else 0.0
        rows = [("linearity", "corr(residual, squared fitted)", bend, abs(bend) <= 0.1,
                 "transform variables or try a non-linear model")]
        if self.order_by is not None:
            dw = self.durbin_watson()
            rows.append(("independence", "Durbin-Watson", dw, 1.5 <= dw <= 2.5, "model the serial dependence"))
        _, p = self.jarque_bera()
        rows.append(("normality", "Jarque-Bera p", p, p > ALPHA, "transform the target"))
        _, p = self.breusch_pagan()
        rows.append(("homoscedasticity", "Breusch-Pagan p", p, p > ALPHA, "use robust errors or transform the target"))
        vifs = [r["vif"] for r in self.vif().collect()]
        worst = math.inf if any(v is None for v in vifs) else max(vifs, default=1.0)
        rows.append(("multicollinearity", "largest VIF", worst, worst <= 10, "remove high-VIF predictors"))
        return local_table(
            self.spark, [(a, m, _or_none(v), bool(ok), None if ok else tip) for a, m, v, ok, tip in rows],
            "assumption string, measure string, value double, met boolean, suggestion string")


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows where every listed column has a value (listwise deletion)."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & as_double(df, c).isNotNull()
    return df.where(keep)


def fit_ols(df: DataFrame, target: str | None = None, predictors: list[str] | None = None,
            order_by: list[str] | None = None) -> OLSFit:
    """Fit target on predictors with intercept; collinear input gets the minimum-norm solution.

    Without a (known) target the best-explained column is taken; predictors
    default to all other varying numeric columns.  `order_by` names the columns
    that give row order, needed for Durbin-Watson and ACF/PACF only.
    """
    if predictors is None or not target or target not in df.columns:
        numeric = varying_numeric(df)
        if len(numeric) < 2:
            raise ValueError(f"Need at least 2 numeric columns for regression analysis, got {numeric}.")
        target = (target or "").strip()
        if target not in numeric:
            target = choose_target(df, numeric)
        predictors = [c for c in predictors or numeric if c != target]
    names = [target, *predictors]
    source = complete_rows(df, names)
    p = len(predictors)
    centres = column_means(source, names)
    # predictors first: the last column of the factor is the target's
    n, factor = triangular_factor(source, [*predictors, target], [*centres[1:], centres[0]])
    if n < p + 2:
        raise ValueError(f"Not enough complete rows ({n}) for {p} predictors.")
    shift = factor[0, 1:] / factor[0, 0]
    means = np.array(centres) + np.concatenate([shift[-1:], shift[:-1]])
    below = factor[1:, 1:]  # the factor of the columns less their means
    order = [p, *range(p)]
    centred = (below.T @ below)[np.ix_(order, order)]
    beta, cov, rank = _solve(below[:p, :p], below[:p, p], means, n)
    return OLSFit(source, target, predictors, n, means, centred, beta, cov, rank, below[:p, :p], order_by)


def _solve(factor: np.ndarray, target: np.ndarray, means: np.ndarray, n: int):
    """Slopes, intercept and (X'X)^+ from the triangular factor of the centred predictors; target first in `means`."""
    x = means[1:]
    p = len(x)
    scale = np.linalg.norm(factor, axis=0)
    noise = math.sqrt(n) * 1e-13 * np.maximum(np.abs(x), 1e-300)
    flat = scale <= noise
    unit = np.where(flat, 1.0, scale)
    left, values, right = np.linalg.svd(np.where(flat, 0.0, factor / unit))
    # values that rounding alone can make: of the sums, and of columns that lie far from zero
    rounding = 8 * np.finfo(float).eps * math.sqrt(n) * float(np.max(np.abs(x) / unit, initial=0.0))
    keep = values > max(RANK_TOLERANCE * p, rounding)
    vectors = right.T
    inv = (vectors[:, keep] / values[keep] ** 2) @ vectors[:, keep].T
    g = inv / np.outer(unit, unit)
    slopes = (vectors[:, keep] / values[keep]) @ (left[:, keep].T @ target) / unit
    beta = np.concatenate([[means[0] - x @ slopes], slopes])
    gx = g @ x
    cov = np.empty((p + 1, p + 1))
    cov[1:, 1:] = g
    cov[0, 1:] = cov[1:, 0] = -gx
    cov[0, 0] = 1.0 / n + x @ gx
    rank = 1 + int(keep.sum())
    if rank < p + 1:
        loose = vectors[:, ~keep] / unit[:, None]  # directions X cannot see
        null = np.vstack([-(x @ loose), loose])
        basis, _ = np.linalg.qr(null / np.linalg.norm(null, axis=0))
        seen = np.eye(p + 1) - basis @ basis.T
        beta = seen @ beta
        cov = seen @ cov @ seen
    return beta, cov, rank
