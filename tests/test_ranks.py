import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.operators import ordered, ranks, selection

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("task_rows", [10_000, 500, 37])
def test_quantiles_are_exact_at_any_size(skewed, task_rows):
    frame, df = skewed
    got = ranks.quantiles(df, ["x", "y", "z"], PROBS, task_rows=task_rows)
    for c in ("x", "y", "z"):
        assert got[c] == pytest.approx(frame[c].quantile(PROBS).tolist(), rel=1e-12)


def test_quantiles_do_not_depend_on_the_sample(skewed, monkeypatch):
    frame, df = skewed
    monkeypatch.setattr(ranks, "SAMPLE_ROWS", 60)
    got = ranks.quantiles(df, ["x", "y"], PROBS, task_rows=200)
    for c in ("x", "y"):
        assert got[c] == pytest.approx(frame[c].quantile(PROBS).tolist(), rel=1e-12)


def test_quantiles_of_empty_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "a double, b double")
    assert ranks.quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}


def test_infinities_take_part(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in [inf] * 40 + [-inf] * 40 + [float(i) for i in range(21)]], "v double").repartition(4)
    assert ranks.quantiles(df, ["v"], [0.0, 0.5, 1.0], task_rows=5)["v"] == [-inf, 10.0, inf]
    got = ranks.attach_ranks(df, ["v"], task_rows=5, broadcast_ok=False).toPandas()
    assert (got["rank_0"] == got["v"].rank()).all()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_rank_sum_is_fixed(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for options in ({}, {"task_rows": 7, "broadcast_ok": False}):
        got = ranks.attach_ranks(df, ["v"], **options).toPandas()
        n = len(values)
        assert got["rank_0"].sum() == pytest.approx(n * (n + 1) / 2)
        assert (got["rank_0"] - got["v"].rank()).abs().max() == 0


@pytest.mark.parametrize("options", [
    {}, {"task_rows": 500, "broadcast_ok": False}, {"task_rows": 40, "broadcast_ok": False},
])
def test_ranks_with_a_hot_value(skewed, options):
    frame, df = skewed
    got = ranks.attach_ranks(df.select("id", "x", "z"), ["x", "z"], **options).toPandas().sort_values("id")
    want = frame.sort_values("id")
    assert np.array_equal(got["rank_0"], want["x"].rank())
    assert np.array_equal(got["rank_1"], want["z"].rank())


def test_slices_keep_the_order(skewed, monkeypatch):
    frame, df = skewed
    monkeypatch.setattr(ranks, "MAX_BUCKETS", 4)
    table = ranks.value_ranks(df, ["y"], task_rows=100).toPandas()
    assert table["bucket"].nunique() > 20
    want = pd.Series(frame["y"].rank().to_numpy(), index=frame["y"]).groupby(level=0).first()
    got = table.set_index("value")["rank"].sort_index()
    assert np.array_equal(got.to_numpy(), want.to_numpy())


def test_hot_rows_are_spread_over_partitions(skewed):
    _, df = skewed
    out = ranks.attach_ranks(df.select("id", "x"), ["x"], task_rows=500, broadcast_ok=False)
    spread = out.withColumn("part", F.spark_partition_id()).where("x = 77.7").groupBy("part").count()
    assert spread.count() > 1


@pytest.mark.parametrize("task_rows", [10_000, 100])
def test_grouped_quantiles(skewed, task_rows):
    frame, df = skewed
    got = ranks.grouped_quantiles(df, "x", ["group"], [0.25, 0.5, 0.9], task_rows).toPandas().set_index("group")
    for g, part in frame.groupby("group"):
        assert list(got.loc[g, "q"]) == pytest.approx(part["x"].quantile([0.25, 0.5, 0.9]).tolist(), rel=1e-12)


@pytest.mark.parametrize("task_rows", [10_000, 100])
def test_row_index(skewed, task_rows):
    frame, df = skewed
    got = ranks.row_index(df.select("x", "id"), ["x"], task_rows=task_rows).toPandas().sort_values("row_index")
    assert got["row_index"].tolist() == list(range(len(frame)))
    assert got["id"].tolist() == frame.sort_values(["x", "id"])["id"].tolist()


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_lag_sums_across_seams(spark, partitions):
    x = np.random.default_rng(3).normal(size=90)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t long, v double")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.lag_sums(df, F.col("v"), ["t"], 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got.n == 90
    for k in range(21):
        assert got.products[k] == pytest.approx(x[k:] @ x[: len(x) - k], abs=1e-10)
    assert got.squared_steps == pytest.approx((np.diff(x) ** 2).sum())


def test_lag_sums_need_an_order(spark):
    with pytest.raises(ValueError):
        ordered.lag_sums(spark.range(3).selectExpr("cast(id as double) v"), F.col("v"), [], 2)


def test_partial_autocorrelation_solves_yule_walker():
    acf = np.array([1.0, 0.6, 0.3, 0.25, -0.1])
    pacf = ordered.partial_autocorrelation(acf)
    for k in range(1, 5):
        matrix = np.array([[acf[abs(i - j)] for j in range(k)] for i in range(k)])
        assert pacf[k] == pytest.approx(np.linalg.solve(matrix, acf[1 : k + 1])[-1])


def test_many_groups_one_of_which_is_large_and_narrow(spark, monkeypatch):
    rng = np.random.default_rng(21)
    n = 24_000
    group = np.where(rng.random(n) < 1 / 3, -1, rng.integers(0, 900, n))
    x = np.where(group == -1, 50 + rng.normal(0, 1e-7, n), rng.lognormal(0, 4, n))
    x[(group == -1) & (rng.random(n) < 0.4)] = 50.0
    x[(group == -1) & (rng.random(n) < 0.01)] = np.inf
    group = np.where(group == 7, -2, group)
    group[: n // 10] = -2
    x[: n // 20] = -0.0
    frame = pd.DataFrame({"k": [None if v == -2 else f"g{v}" for v in group], "z": group % 2, "x": x})
    df = spark.createDataFrame(frame).repartition(7)
    largest = []
    plain = selection._sorted_picks
    monkeypatch.setattr(selection, "_sorted_picks", lambda rows, spots: (
        largest.append(spots.agg(F.max("size")).first()[0]), plain(rows, spots))[1])
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    rows = ranks.grouped_quantiles(df, "x", ["k", "z"], probs, task_rows=300).collect()
    got = {(r["k"], r["z"]): (r["n"], list(r["q"])) for r in rows}
    want = frame.groupby(["k", "z"], dropna=False)["x"]
    assert len(rows) == len(got) == want.ngroups
    for (k, z), part in want:
        key = (None if not isinstance(k, str) else k, z)
        assert got[key][0] == len(part)
        ordered_values = np.sort(part.to_numpy())
        for p, q in zip(probs, got[key][1]):
            h = (len(part) - 1) * p
            a, b = ordered_values[int(h)], ordered_values[min(len(part) - 1, int(h) + 1)]
            assert q == (a if a == b else pytest.approx(a + (b - a) * (h - int(h)), rel=1e-12))
    assert largest and largest[0] <= 300
