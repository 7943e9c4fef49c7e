import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import association, correlation, describe, groups, normality

# Shapiro and Wilk's 1965 example
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def test_shapiro_published_example(spark):
    df = spark.createDataFrame([(float(v),) for v in WEIGHTS], "w double")
    r = normality.normality(df, ["w"]).first()
    assert r["test"] == "Shapiro-Wilk"
    assert r["statistic"] == pytest.approx(0.7888, abs=1e-4) and r["p_value"] == pytest.approx(0.0067, abs=1e-4)


def test_normality_edges(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"normal": rng.normal(size=4000), "flat": 1.0, "none": np.nan, "few": np.nan})
    frame.loc[:4, "few"] = [1.0, 2, 3, 4, 5]
    got = {r["variable"]: r for r in normality.normality(spark.createDataFrame(frame), list(frame)).collect()}
    assert got["normal"]["is_normal"] and not got["none"]["is_normal"]
    assert (got["few"]["test"], got["few"]["n"]) == ("skipped", 5)
    assert got["flat"]["statistic"] == 1.0 and got["flat"]["is_normal"]


def test_test_switches_at_5000_rows_per_group(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": ["big"] * 5000 + ["small"] * 4999 + ["tiny"] * 7, "v": rng.normal(size=10006)})
    got = {r["group"]: r["test"] for r in normality.normality_by(spark.createDataFrame(frame), ["v"], "g").collect()}
    assert got == {"big": "D'Agostino-Pearson", "small": "Shapiro-Wilk", "tiny": "skipped"}


def test_descriptives_match_pandas(skewed):
    frame, df = skewed
    got = describe.descriptives(df, ["x", "y"]).toPandas().set_index("variable")
    for c in ("x", "y"):
        s = frame[c]
        want = [s.mean(), s.median(), s.std(), s.min(), s.max(), s.skew(), s.kurt()]
        have = got.loc[c, ["mean", "median", "std", "min", "max", "skewness", "kurtosis"]].astype(float).tolist()
        assert have == pytest.approx(want, rel=1e-9)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 0.1, 2.0), (2.0, 0.1, None), (3.0, 0.1, 5.0)], "a double, c double, g double")
    got = {(r["x"], r["y"]): r for r in correlation.pearson(df, [("a", "c"), ("a", "g")]).collect()}
    assert got[("a", "c")]["r"] is None and got[("a", "c")]["p_value"] is None
    assert got[("a", "g")]["n"] == 2 and got[("a", "g")]["p_value"] == 1.0


def test_many_pairs_match_pandas(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(1e6, 3, size=(400, 6)), columns=list("abcdef"))
    frame["f"] = 7.0
    frame["e"] = frame["a"] * 2 + 1
    frame.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(frame).repartition(5)
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in correlation.correlation_matrix(df, list(frame)).collect()}
    want = frame.corr()
    for a in frame:
        for b in frame:
            n, r = got[(a, b)]
            assert n == frame[[a, b]].dropna().shape[0]
            if a == b:
                assert r == 1.0
            elif "f" in (a, b):
                assert r is None
            else:
                assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_spearman_paths_agree_with_pandas(skewed):
    frame, df = skewed
    want = frame["x"].rank().corr(frame["y"].rank())
    for options in ({}, {"task_rows": 300, "broadcast_ok": False}):
        got = correlation.spearman(df, [("x", "y")], **options).first()
        assert got["r"] == pytest.approx(want, abs=1e-12)


def test_pearson_only_for_normal_pairs(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=300)
    frame = pd.DataFrame({"a": a, "b": a + rng.normal(size=300), "c": rng.exponential(size=300)})
    got = {(r["x"], r["y"]): r["test_name"] for r in correlation.auto_correlation(spark.createDataFrame(frame)).collect()}
    assert got == {("a", "b"): "Pearson Correlation", ("a", "c"): "Spearman Correlation", ("b", "c"): "Spearman Correlation"}


def test_anova_of_two_groups_is_t_squared(skewed):
    _, df = skewed
    t = groups.compare_groups(df, "t", [("half", "x")]).first()
    f = groups.compare_groups(df, "anova", [("half", "x")]).first()
    assert f["statistic"] == pytest.approx(t["statistic"] ** 2) and f["p_value"] == pytest.approx(t["p_value"])


@pytest.mark.parametrize("task_rows", [10_000, 300])
def test_rank_tests_match_pandas(skewed, task_rows):
    frame, df = skewed
    r = frame["x"].rank()
    n1 = (frame["half"] == "l").sum()
    u1 = r[frame["half"] == "l"].sum() - n1 * (n1 + 1) / 2
    got = groups.compare_groups(df, "mannwhitney", [("half", "x")], task_rows=task_rows).first()
    assert got["statistic"] == u1
    n = len(frame)
    sums = r.groupby(frame["group"]).agg(["sum", "size"])
    h = 12 / (n * (n + 1)) * (sums["sum"] ** 2 / sums["size"]).sum() - 3 * (n + 1)
    ties = frame["x"].value_counts()
    h /= 1 - (ties**3 - ties).sum() / (n**3 - n)
    got = groups.compare_groups(df, "kruskal", [("group", "x")], task_rows=task_rows).first()
    assert got["statistic"] == pytest.approx(h, rel=1e-9) and got["df"] == 2


def test_exact_mann_whitney_for_small_untied_sides(spark):
    rows = [("a", float(v)) for v in (1, 2, 3)] + [("b", float(v)) for v in (4, 5, 6, 7)]
    got = groups.compare_groups(spark.createDataFrame(rows, "g string, v double"), "mannwhitney", [("g", "v")]).first()
    assert got["statistic"] == 0.0 and got["p_value"] == pytest.approx(2 / 35)


def test_all_values_tied(spark):
    df = spark.createDataFrame([(g, 1.0) for g in "aaabbbccc"], "g string, v double")
    assert groups.compare_groups(df, "kruskal", [("g", "v")]).first()["statistic"] is None
    two = df.where("g <> 'c'")
    assert groups.compare_groups(two, "mannwhitney", [("g", "v")]).first()["p_value"] == 1.0
    assert groups.compare_groups(two, "t", [("g", "v")]).first()["statistic"] is None


def test_small_groups_are_dropped(spark):
    rows = [("a", float(i)) for i in range(9)] + [("b", float(i) * 2) for i in range(9)] + [("c", 1.0), ("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = groups.auto_group_tests(df).first()
    assert got["groups"] == 2 and got["n"] == 18 and got["test_name"] == "Independent t-test"
    assert groups.auto_group_tests(df.where("g = 'a'")).count() == 0


def test_group_level_cap(spark):
    df = spark.range(400).selectExpr("cast(id % 21 as string) as many", "cast(id % 20 as string) as fit", "cast(id as double) v")
    assert {r["category"] for r in groups.auto_group_tests(df).collect()} == {"fit"}


def test_u_values_of_both_sides_add_up(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"g": rng.choice(["a", "b"], 200), "v": rng.integers(0, 9, 200).astype(float)})
    flipped = frame.assign(g=frame["g"].map({"a": "b", "b": "a"}))
    u = [groups.compare_groups(spark.createDataFrame(f), "mannwhitney", [("g", "v")]).first() for f in (frame, flipped)]
    n1 = (frame["g"] == "a").sum()
    assert u[0]["statistic"] + u[1]["statistic"] == n1 * (200 - n1)
    assert u[0]["p_value"] == pytest.approx(u[1]["p_value"])


def _chi(counts, yates):
    o = np.array(counts, float)
    e = o.sum(1, keepdims=True) @ o.sum(0, keepdims=True) / o.sum()
    d = np.abs(o - e)
    return ((d - (np.minimum(0.5, d) if yates else 0)) ** 2 / e).sum()


@pytest.mark.parametrize("counts", [[[10, 0], [4, 9]], [[5, 6], [6, 5]], [[3, 0, 2], [0, 4, 1]], [[1, 0, 0], [0, 1, 0], [0, 0, 9]]])
def test_chi_squared_with_empty_cells(spark, counts):
    rows = [(f"r{i}", f"c{j}") for i, line in enumerate(counts) for j, n in enumerate(line) for _ in range(n)]
    df = spark.createDataFrame(rows + [(None, "c0"), ("r0", None)], "a string, b string")
    got = association.cramers_v(association.chi_squared(association.crosstab(df, [("a", "b")]))).first()
    yates = np.shape(counts) == (2, 2)
    want = _chi(counts, yates)
    assert got["statistic"] == pytest.approx(want) and got["n"] == len(rows)
    assert got["cramers_v"] == pytest.approx((want / (len(rows) * (min(np.shape(counts)) - 1))) ** 0.5)


def test_association_needs_two_levels(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q")], "a string, b string")
    assert association.chi_squared(association.crosstab(df, [("a", "b")])).count() == 0
    assert association.top_values(df, "b", 1).first()["value"] == "p"
