"""Distribution tails on NumPy arrays, and their Arrow-batched Spark wrappers.

Tails are evaluated on result tables (one row per test), never on data rows.
The one function needed per data row, the normal quantile, is made of plain
column expressions (`with_norm_ppf`) and stays inside generated JVM code.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Coefficients of Wichura's AS 241 (1988), lowest order first.
PPF_CENTRAL_NUM = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
]
PPF_CENTRAL_DEN = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
]
PPF_NEAR_NUM = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
PPF_NEAR_DEN = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
]
PPF_FAR_NUM = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
PPF_FAR_DEN = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
]


def horner(coefs, x):
    """Polynomial with the lowest-order coefficient first; works for floats and Columns."""
    acc = coefs[-1]
    for c in reversed(coefs[:-1]):
        acc = acc * x + c
    return acc


def _horner_sql(coefs: list[float], x: str) -> str:
    text = f"{coefs[-1]!r}D"
    for c in reversed(coefs[:-1]):
        text = f"({text} * {x} + {c!r}D)"
    return text


def with_norm_ppf(df: DataFrame, p: Column, name: str) -> DataFrame:
    """Add the normal quantile of `p` (about 16 digits), null outside (0, 1).

    Stepwise columns: each root and logarithm is computed once per row, and the
    expressions stay small enough to plan and compile quickly.
    """
    steps = df.withColumn("_p", F.when((p > 0) & (p < 1), p)).withColumn("_q", F.expr("_p - 0.5D"))
    steps = steps.withColumn("_r", F.expr("sqrt(-ln(least(_p, 1D - _p)))"))
    steps = steps.withColumns({"_c": F.expr("0.180625D - _q * _q"), "_n": F.expr("_r - 1.6D"), "_f": F.expr("_r - 5D")})
    ratio = lambda num, den, x: f"{_horner_sql(num, x)} / {_horner_sql(den, x)}"
    value = (
        f"CASE WHEN abs(_q) <= 0.425D THEN _q * {ratio(PPF_CENTRAL_NUM, PPF_CENTRAL_DEN, '_c')} "
        f"WHEN _r <= 5D THEN signum(_q) * {ratio(PPF_NEAR_NUM, PPF_NEAR_DEN, '_n')} "
        f"ELSE signum(_q) * {ratio(PPF_FAR_NUM, PPF_FAR_DEN, '_f')} END"
    )
    return steps.withColumn(name, F.expr(value)).drop("_p", "_q", "_r", "_c", "_n", "_f")


def norm_sf(z):
    z = np.asarray(z, dtype=float)
    return np.vectorize(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)), otypes=[float])(z)


def _stirling_tail(x: float) -> float:
    return 1.0 / (12.0 * x) - 1.0 / (360.0 * x**3) + 1.0 / (1260.0 * x**5)


def log_gamma_step(a: float, b: float) -> float:
    """lgamma(a + b) - lgamma(a) without cancellation when `a` is large."""
    if a < 50.0:
        return math.lgamma(a + b) - math.lgamma(a)
    return (
        (a - 0.5) * math.log1p(b / a)
        + b * math.log(a + b)
        - b
        + _stirling_tail(a + b)
        - _stirling_tail(a)
    )


def log_beta(a: float, b: float) -> float:
    big, small = (a, b) if a >= b else (b, a)
    return math.lgamma(small) - log_gamma_step(big, small)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 200_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised I_x(a, b); pass y = 1 - x when it is known more exactly."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    front = math.exp(a * log_x + b * log_y - log_beta(a, b))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


# Above this many degrees of freedom t and F use their second-order limit forms
# (error below 1e-13); the continued fraction would lose digits there.
LARGE_DF = 1e7


def _usable(*values) -> bool:
    return all(v is not None and not math.isnan(v) for v in values)


def _t_two_sided(t: float, df: float) -> float:
    if not _usable(t, df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    t2 = t * t
    if df > LARGE_DF:
        z = abs(t) * (1.0 - 0.25 / df) / math.sqrt(1.0 + 0.5 * t2 / df)
        return math.erfc(z / math.sqrt(2.0))
    return beta_inc(df / 2.0, 0.5, df / (df + t2), t2 / (df + t2))


def _f_upper(f: float, a: float, b: float) -> float:
    if not _usable(f, a, b) or a <= 0 or b <= 0:
        return math.nan
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    if b > LARGE_DF:
        return _chi2_upper((b + 0.5 * a - 1.0) * math.log1p(a * f / b), a)
    den = b + a * f
    return beta_inc(b / 2.0, a / 2.0, b / den, a * f / den)


def _chi2_upper(x: float, k: float) -> float:
    if not _usable(x, k) or k <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a, z = k / 2.0, x / 2.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1.0
            term *= z / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = z + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 200_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def _vector(fn):
    return np.vectorize(fn, otypes=[float])


t_two_sided = _vector(_t_two_sided)
f_upper = _vector(_f_upper)
chi2_upper = _vector(_chi2_upper)


def t_quantile(p: float, df: float) -> float:
    """Upper-half quantile of Student's t (p >= 0.5), by bisection on the tail."""
    target = 2.0 * (1.0 - p)
    lo, hi = 0.0, 2.0
    while _t_two_sided(hi, df) > target:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if _t_two_sided(mid, df) > target:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-14 * hi:
            break
    return 0.5 * (lo + hi)


#: Up to this many values on the smaller side the exact U is a closed form, at any size of the other side.
FEW = 8


@lru_cache(maxsize=FEW)
def _at_most(m: int) -> tuple[int, list[int]]:
    """Period and numerator of the series that counts multisets of parts 1, 1, 2, ..., m by their sum.

    1 / ((1 - q) (1 - q) (1 - q^2) ... (1 - q^m)) is brought over (1 - q^period)^(m + 1): each factor 1 - q^i is
    filled up with 1 + q^i + ... + q^(period - i), so the numerator is a polynomial that depends on m alone.
    """
    period = math.lcm(*range(1, m + 1))
    numerator = [1]
    for part in (1, *range(1, m + 1)):
        grown = [0] * (len(numerator) + period - part)
        for k in range(period // part):
            for j, c in enumerate(numerator):
                grown[j + k * part] += c
        numerator = grown
    return period, numerator


def _fillings(m: int, total: int) -> int:
    """Number of multisets of the parts 1, 1, 2, ..., m with the given sum."""
    period, numerator = _at_most(m)
    return sum(numerator[r] * math.comb((total - r) // period + m, m) for r in range(total % period, min(total, len(numerator) - 1) + 1, period))


@lru_cache(maxsize=FEW)
def _signed_sums(m: int) -> list[tuple[int, int, int]]:
    """(size, sum, signed number) of the subsets of 1..m."""
    counts = {(0, 0): 1}
    for i in range(1, m + 1):
        for (k, s), c in list(counts.items()):
            counts[k + 1, s + i] = counts.get((k + 1, s + i), 0) - c
    return [(k, s, c) for (k, s), c in counts.items()]


def arrangements_up_to(tail: int, n1: int, n2: int) -> int:
    """Number of rank arrangements of n1 and n2 untied values whose U is at most `tail`.

    The Gaussian binomial is the product of (1 - q^(n + i)) / (1 - q^i) for i up to the smaller side m.  For m up to
    FEW the numerator is multiplied out, at most 2^m signed powers, and each of them needs one value of the series
    of `_at_most`: the work depends on m alone.  Larger sides take a table of tail + 1 counts.
    """
    m, n = sorted((n1, n2))
    if tail < 0:
        return 0
    if m <= FEW:
        return sum(c * _fillings(m, tail - k * n - s) for k, s, c in _signed_sums(m) if k * n + s <= tail)
    counts = [0] * (tail + 1)
    counts[0] = 1
    for i in range(1, m + 1):
        for j in range(tail, n + i - 1, -1):
            counts[j] -= counts[j - n - i]
        for j in range(i, tail + 1):
            counts[j] += counts[j - i]
    return sum(counts)


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of a U without ties, by counting rank arrangements."""
    tail = int(round(min(u, n1 * n2 - u)))
    return min(1.0, float(Fraction(2 * arrangements_up_to(tail, n1, n2), math.comb(n1 + n2, min(n1, n2)))))


def omnibus(n: float, skew: float, kurt: float) -> tuple[float, float]:
    """D'Agostino-Pearson K2 and p from n, population skewness and (non-excess) kurtosis."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt - 3 * (n - 1) / (n + 1)) / math.sqrt(var)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + math.sqrt(1 + 4 / b**2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - math.copysign(((1 - 2 / a) / abs(d)) ** (1 / 3), d)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, math.exp(-k2 / 2)


def _column(series: pd.Series) -> np.ndarray:
    return series.to_numpy(dtype=float, na_value=np.nan)


def _series(values: np.ndarray) -> pd.Series:
    values = np.clip(values, 0.0, 1.0)
    return pd.Series(values).astype(object).where(~np.isnan(values), None).astype("Float64")


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_two_sided(_column(t), _column(df)))


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return _series(f_upper(_column(f), _column(a), _column(b)))


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, k: pd.Series) -> pd.Series:
    return _series(chi2_upper(_column(x), _column(k)))


@F.pandas_udf(DoubleType())
def norm_upper(z: pd.Series) -> pd.Series:
    return _series(norm_sf(_column(z)))


@F.pandas_udf(DoubleType())
def mann_whitney_exact_pvalue(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series(
        [
            mann_whitney_exact(a, int(b), int(c)) if a is not None and not math.isnan(a) else None
            for a, b, c in zip(u, n1, n2)
        ],
        dtype="Float64",
    )
