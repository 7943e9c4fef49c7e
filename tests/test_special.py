import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import special as sp


def test_normal_tail_and_quantile(spark):
    norm = statistics.NormalDist()
    assert sp.norm_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    ps = [1e-12, 1e-5, 0.01, 0.07, 0.3, 0.5, 0.7, 0.9251, 0.999, 1 - 1e-9]
    df = sp.with_norm_ppf(spark.createDataFrame([(p,) for p in ps], "p double"), F.col("p"), "z")
    for r in df.collect():
        assert r["z"] == pytest.approx(norm.inv_cdf(r["p"]), rel=1e-12, abs=1e-13)
    edge = sp.with_norm_ppf(spark.createDataFrame([(0.0,), (1.0,)], "p double"), F.col("p"), "z")
    assert [r["z"] for r in edge.collect()] == [None, None]


@pytest.mark.parametrize("x,k,p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05)])
def test_chi2(x, k, p):
    assert sp._chi2_upper(x, k) == pytest.approx(p, abs=1e-12)


@pytest.mark.parametrize("df", [1, 3, 10, 1000, 9_999_999, 10_000_001, 10**12])
def test_t_agrees_with_f_and_its_quantile(df):
    t = sp.t_quantile(0.975, df)
    assert sp._t_two_sided(t, df) == pytest.approx(0.05, abs=1e-12)
    assert sp._f_upper(t * t, 1, df) == pytest.approx(0.05, abs=1e-10)


def test_t_tabulated():
    assert sp.t_quantile(0.975, 1) == pytest.approx(12.7062047361747, rel=1e-10)
    assert sp.t_quantile(0.975, 10) == pytest.approx(2.2281388519862, rel=1e-10)
    assert sp._f_upper(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-9)


def test_tails_have_no_value_for_missing_input():
    assert math.isnan(sp._t_two_sided(math.nan, 3))
    assert math.isnan(sp._f_upper(1.0, 0, 3))
    assert sp._chi2_upper(math.inf, 2) == 0.0


@pytest.mark.parametrize("n1,n2", [(1, 4), (3, 3), (2, 5), (4, 4)])
def test_exact_u_counts_every_arrangement(n1, n2):
    us = []
    for first in itertools.combinations(range(n1 + n2), n1):
        us.append(sum(first) + n1 - n1 * (n1 + 1) / 2)
    us = np.array(us)
    for u in range(n1 * n2 + 1):
        big = max(u, n1 * n2 - u)
        want = min(1.0, 2 * np.mean(us >= big))
        assert sp.mann_whitney_exact(big, n1, n2) == pytest.approx(want, abs=1e-12)


def _table_of_arrangements(m, n):
    """Arrangements by U: U grows by the number of second-side values under the last first-side value."""
    rows = {(0, k): np.array([1.0]) for k in range(n + 1)}
    for i in range(1, m + 1):
        rows[i, 0] = np.array([1.0])
        for k in range(1, n + 1):
            out = np.zeros(i * k + 1)
            out[k : k + len(rows[i - 1, k])] += rows[i - 1, k]
            out[: len(rows[i, k - 1])] += rows[i, k - 1]
            rows[i, k] = out
    return np.cumsum(rows[m, n])


@pytest.mark.parametrize("m,n", [(1, 30), (2, 25), (3, 17), (5, 12), (6, 40), (8, 8), (8, 33), (9, 11)])
def test_exact_u_is_the_sum_of_the_counted_table(m, n):
    want = _table_of_arrangements(m, n)
    for tail in {0, 1, 2, n, m * n // 3, m * n // 2, m * n - 1, m * n}:
        assert sp.arrangements_up_to(tail, m, n) == sp.arrangements_up_to(tail, n, m) == want[tail]
    assert sp.arrangements_up_to(m * n, m, n) == math.comb(m + n, m) and sp.arrangements_up_to(-1, m, n) == 0


def test_exact_u_of_eight_against_a_million_values():
    n = 1_000_000
    assert sp.arrangements_up_to(8 * n, 8, n) == math.comb(n + 8, 8)
    # symmetric: below the middle lies half of what is not in the middle
    below, upto = sp.arrangements_up_to(4 * n - 1, 8, n), sp.arrangements_up_to(4 * n, 8, n)
    assert below + upto == math.comb(n + 8, 8)
    # far from the middle the normal approximation is wrong, near it it is close
    u = 4.0 * n + 1.5 * math.sqrt(8 * n / 12 * (n + 9))
    assert sp.mann_whitney_exact(u, 8, n) == pytest.approx(2 * float(sp.norm_sf(np.array([1.5]))[0]), rel=0.05)
    assert sp.mann_whitney_exact(8.0 * n, n, 8) == pytest.approx(2 / math.comb(n + 8, 8), rel=1e-12)
