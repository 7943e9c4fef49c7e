"""Correlations of columns with gaps against numpy, pair by pair."""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from statloom.operators import correlation, normality
from statloom.operators import gappy as coder
from statloom.operators.gappy import gappy_spearman, present_moments
from statloom.operators.ranks import Splits


@pytest.fixture(scope="module")
def gappy(spark):
    """A third of all rows share a value and a pattern; ties, both zeros, infinities, a constant and an empty column."""
    rng = np.random.default_rng(9)
    n = 3000
    frame = pd.DataFrame({
        "a": rng.normal(0, 1, n).round(2), "b": rng.integers(0, 4, n) * 1.0, "c": rng.exponential(2, n), "d": np.where(rng.random(n) < 0.5, 0.0, -0.0),
        "e": np.full(n, 7.0), "f": rng.normal(5, 2, n), "g.h": rng.integers(0, 10**6, n) * 1.0})
    frame.loc[: n // 3, ["a", "c"]] = [1.5, 2.5]
    frame.loc[5:9, "c"] = [np.inf, -np.inf, np.inf, 3.0, 3.0]
    for k, name in enumerate(frame.columns):
        frame.loc[rng.random(n) < 0.05 * (k + 1), name] = np.nan
    frame.loc[rng.random(n) < 0.3, "d"] = rng.normal()
    frame["empty"] = np.nan
    return frame, spark.createDataFrame(frame).repartition(5)


def ranks(x):
    _, place, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2.0)[place]


def expected(frame, a, b):
    both = frame[[a, b]].dropna()
    if not len(both):
        return 0, None
    x, y = ranks(both[a].to_numpy() + 0.0), ranks(both[b].to_numpy() + 0.0)
    return len(both), (np.corrcoef(x, y)[0, 1] if x.std() and y.std() else None)


@pytest.mark.parametrize(("task_rows", "broadcast_bytes"), [(10**6, 32 << 20), (300, 0)])
def test_spearman_of_every_pair(gappy, task_rows, broadcast_bytes):
    frame, df = gappy
    pairs = list(combinations(frame.columns, 2))
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in gappy_spearman(df, pairs, task_rows, broadcast_bytes).collect()}
    assert list(got) == pairs
    for a, b in pairs:
        n, r = expected(frame, a, b)
        assert got[a, b][0] == n and (got[a, b][1] is None) == (r is None) and (r is None or got[a, b][1] == pytest.approx(r, abs=1e-10)), (a, b)


def test_more_columns_than_one_pattern_holds(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({f"k{i}": np.where(rng.random(40) < 0.2, np.nan, rng.integers(0, 9, 40)) for i in range(66)})
    pairs = [("k0", "k65"), ("k64", "k1"), ("k30", "k31"), ("k3", "k2")]
    pairs += [(f"k{i}", f"k{i + 1}") for i in range(32, 64)] + [(f"k{i}", f"k{i + 33}") for i in range(4, 30)]
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in gappy_spearman(spark.createDataFrame(frame), pairs).collect()}
    assert list(got) == pairs
    for a, b in pairs:
        n, r = expected(frame, a, b)
        assert got[a, b] == (n, pytest.approx(r, abs=1e-10))


def test_both_ways_of_ranking_agree(gappy):
    frame, df = gappy
    few = [("a", "b"), ("c", "f")]
    alone = correlation.spearman(df, few).collect()
    shared = {(r["x"], r["y"]): r for r in correlation.spearman(df, list(combinations(frame.columns[:6], 2))).collect()}
    for r in alone:
        assert shared[r["x"], r["y"]]["r"] == pytest.approx(r["r"], abs=1e-10) and shared[r["x"], r["y"]]["n"] == r["n"]


def test_empty_tables(gappy):
    frame, df = gappy
    got = gappy_spearman(df.where("false"), [("a", "b"), ("b", "c"), ("a", "c"), ("a", "f")]).collect()
    assert [(r["n"], r["r"]) for r in got] == [(0, None)] * 4


def test_moments_within_pairs(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"a": rng.normal(1e6, 3, 900), "b": rng.exponential(1, 900), "c": np.full(900, 4.0)})
    for name in ("a", "b"):
        frame.loc[rng.random(900) < 0.2, name] = np.nan
    got = {(r["i"], r["j"]): r for r in present_moments(spark.createDataFrame(frame), ["a", "b", "c"]).collect()}
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            x = frame[a][frame[[a, b]].notna().all(axis=1)].to_numpy()
            z = x - x.mean()
            r = got[i, j]
            assert r["n"] == len(x) and r["mean"] == pytest.approx(x.mean())
            if a == "c":
                assert r["g1"] is None and r["g2"] is None
            else:
                assert r["g1"] == pytest.approx((z**3).mean() / (z**2).mean() ** 1.5, abs=1e-6)
                assert r["g2"] == pytest.approx((z**4).mean() / (z**2).mean() ** 2 - 3, abs=1e-6)


def test_the_test_is_chosen_on_the_complete_rows_of_each_pair(spark):
    rng = np.random.default_rng(5)
    n = 9000
    frame = pd.DataFrame({"p": rng.normal(0, 1, n), "q": rng.normal(0, 1, n), "r": rng.exponential(1, n), "s": rng.normal(3, 1, n)})
    frame.loc[rng.random(n) < 0.1, "q"] = np.nan
    frame.loc[8000:, "s"] = np.nan
    frame.loc[300:, "r"] = np.where(rng.random(n - 300) < 0.7, np.nan, frame["r"][300:])
    df = spark.createDataFrame(frame)
    got = {(r["x"], r["y"]): r for r in correlation.auto_correlation(df, list("pqrs")).collect()}
    for a, b in combinations("pqrs", 2):
        both = df.where(" and ".join(f"not isnan({c}) and {c} is not null" for c in (a, b)))
        sides = normality.normality(both, [a, b]).collect()
        assert got[a, b]["n"] == sides[0]["n"]
        assert got[a, b]["test_name"].startswith("Pearson" if all(s["is_normal"] for s in sides) else "Spearman"), (a, b)


def test_rows_travel_as_coded_differences_of_ranks(spark):
    """A cell costs a few bytes of shuffle, not eight for every other column; so does a value of a third of the rows."""
    codes = np.array([[0, -1, 5], [2**30, -(2**30), 7]], dtype=np.int32)
    assert (coder._decoded(coder._coded(codes), 2, 3, codes.dtype) == codes).all()
    rng = np.random.default_rng(3)
    n, p = 20_000, 12
    rows = pa.RecordBatch.from_arrays([
        pa.array(np.zeros(n), pa.int32()), pa.array(np.ones(n), pa.int32()), pa.array(np.sort(rng.normal(0, 1, n))),
        pa.array(np.full(n, (1 << p) - 1)), pa.array(rng.permutation(n))], coder.SORTED)
    messages = list(coder._rank_messages(p, np.full((p, p), float(n)), 12, np.dtype(np.int32))(iter([rows])))
    assert sum(b.nbytes for b in messages) < 8 * n
    frame = pd.DataFrame({f"m{i}": np.where(rng.random(n) < 0.2, np.nan, rng.normal(0, 1, n)) for i in range(p)})
    frame.loc[: n // 3, "m4"] = 0.25
    pairs = list(combinations(frame.columns, 2))
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in gappy_spearman(spark.createDataFrame(frame), pairs, 1000).collect()}
    for a, b in pairs:
        rows_of_both, r = expected(frame, a, b)
        assert got[a, b] == (rows_of_both, pytest.approx(r, abs=1e-10))


@pytest.mark.parametrize(("task_rows", "round_bytes"), [(10**6, 100_000), (300, 100_000), (300, 1), (2, 100_000)])
def test_columns_are_taken_in_rounds_that_leave_no_shuffle_files(gappy, spark, task_rows, round_bytes):
    """The ranks of all pairs need not lie on disk together: any size of round gives the same result, and clears up behind it."""
    frame, df = gappy
    pairs = list(combinations(frame.columns, 2))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(setting), []
    parts = coder._groups(len(frame.columns), int(frame.notna().to_numpy().sum()), round_bytes)
    assert len(parts) > 1 and sorted(sum(parts, [])) == list(range(len(frame.columns)))
    dealt = coder._dealt
    coder._dealt = lambda *a: seen.append(spark.conf.get(setting)) or dealt(*a)
    try:
        got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in gappy_spearman(df, pairs, task_rows, 1 << 20, round_bytes).collect()}
    finally:
        coder._dealt = dealt
    assert len(seen) > len(parts) and set(seen) == {"true"} and spark.conf.get(setting) == before
    assert list(got) == pairs
    for a, b in pairs:
        n, r = expected(frame, a, b)
        assert got[a, b][0] == n and (got[a, b][1] is None) == (r is None) and (r is None or got[a, b][1] == pytest.approx(r, abs=1e-10)), (a, b)


def test_buckets_follow_the_values():
    points = [-2.0, 0.0, 1.5, np.inf]
    value = np.sort(np.concatenate([np.random.default_rng(4).normal(0, 2, 500), points, points, [-np.inf, -9.0, 9.0]]))
    for splits in (Splits([]), Splits(points, -9.0, np.inf), Splits(points, -9.0, np.inf, 5), Splits(points[:3], -np.inf, 9.0, 5)):
        bucket = coder._buckets(value, splits)
        assert (np.diff(bucket) >= 0).all()
        assert ((bucket % 2 == 0) == np.isin(value, splits.points)).all()
        assert all(len(set(value[bucket == b])) == 1 for b in np.unique(bucket[bucket % 2 == 0]))
