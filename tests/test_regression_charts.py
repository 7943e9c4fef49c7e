import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import chartdata as cd
from statloom.operators import regression as reg
from statloom.plans import charts, full, general


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(8)
    n = 500
    frame = pd.DataFrame({"t": np.arange(n), "a": rng.normal(1e5, 3, n), "b": rng.exponential(2, n)})
    frame["y"] = 4 + 0.5 * frame["a"] - 2 * frame["b"] + rng.normal(0, 1 + frame["b"], n)
    frame.loc[3, "b"] = np.nan
    df = spark.createDataFrame(frame).repartition(5)
    full_rows = frame.dropna().sort_values("t")
    x = np.column_stack([np.ones(len(full_rows)), full_rows["a"], full_rows["b"]])
    return full_rows, x, reg.fit_ols(df, "y", ["a", "b"], order_by=["t"])


def test_coefficients_match_least_squares(model):
    rows, x, fit = model
    beta = np.linalg.lstsq(x, rows["y"], rcond=None)[0]
    e = rows["y"] - x @ beta
    centred = x.copy()
    centred[:, 1] -= 1e5  # same slopes, better conditioned
    s2 = e @ e / (len(rows) - 3)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(centred.T @ centred)))
    got = fit.coefficients().toPandas()
    assert got["coefficient"].tolist() == pytest.approx(beta.tolist(), rel=1e-6)
    assert got["std_error"].tolist()[1:] == pytest.approx(se.tolist()[1:], rel=1e-6)
    summary = fit.model_summary().first()
    assert summary["n_observations"] == 499
    assert summary["r_squared"] == pytest.approx(1 - e @ e / ((rows["y"] - rows["y"].mean()) ** 2).sum())
    assert summary["condition_number"] == pytest.approx(np.linalg.cond(x), rel=1e-6)


def test_residual_diagnostics_match_numpy(model):
    rows, x, fit = model
    y = rows["y"].to_numpy()
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = {r["test"]: r for r in fit.residual_diagnostics().collect()}
    assert got["Durbin-Watson"]["statistic"] == pytest.approx((np.diff(e) ** 2).sum() / (e @ e), rel=1e-6)
    g = e**2
    hat = x @ np.linalg.lstsq(x, g, rcond=None)[0]
    r2 = 1 - ((g - hat) ** 2).sum() / ((g - g.mean()) ** 2).sum()
    assert got["Breusch-Pagan"]["statistic"] == pytest.approx(len(e) * r2, rel=1e-5)
    assert got["Breusch-Pagan"]["verdict"] == "heteroscedastic"
    z = e - e.mean()
    acf = fit.acf_pacf().toPandas()
    assert len(acf) == 21 and not acf["acf_outside"][0]
    for k in range(21):
        assert acf["acf"][k] == pytest.approx(z[k:] @ z[: len(z) - k] / (z @ z), abs=1e-7)
    p = fit.predictions(["t"]).toPandas()
    assert abs(p["residual"].sum()) < 1e-4
    assert (p["actual"] - p["predicted"] - p["residual"]).abs().max() < 1e-9


def test_wide_design(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 25))
    y = x @ np.arange(25) + rng.normal(size=300)
    frame = pd.DataFrame(x, columns=[f"x{i}" for i in range(25)]).assign(y=y)
    fit = reg.fit_ols(spark.createDataFrame(frame).repartition(4), "y", [f"x{i}" for i in range(25)])
    design = np.column_stack([np.ones(300), x])
    assert fit.beta.tolist() == pytest.approx(np.linalg.lstsq(design, y, rcond=None)[0].tolist(), abs=1e-9)
    inv = np.linalg.inv(np.corrcoef(x.T))
    assert [r["vif"] for r in fit.vif().collect()] == pytest.approx(np.diag(inv).tolist())


def test_collinear_input_gets_the_minimum_norm(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=80), rng.normal(size=80)
    frame = pd.DataFrame({"a": a, "b": b, "c": 2 * a + 3, "y": a - b + rng.normal(size=80)})
    fit = reg.fit_ols(spark.createDataFrame(frame), "y", ["a", "b", "c"])
    x = np.column_stack([np.ones(80), a, b, frame["c"]])
    assert fit.beta.tolist() == pytest.approx((np.linalg.pinv(x) @ frame["y"]).tolist(), abs=1e-8)
    assert fit.rank == 3
    assert {r["variable"]: r["multicollinearity"] for r in fit.vif().collect()} == {"a": "severe", "b": "low", "c": "severe"}
    assert {r["assumption"]: r["met"] for r in fit.assumptions().collect()}["multicollinearity"] is False


def test_regression_guards(spark):
    with pytest.raises(ValueError):
        reg.fit_ols(spark.createDataFrame([(1.0, "x")], "a double, t string"))
    with pytest.raises(ValueError):
        reg.fit_ols(spark.createDataFrame([(1.0, 2.0), (2.0, None)], "a double, b double"), "a", ["b"])
    fit = reg.fit_ols(spark.range(30).selectExpr("cast(id as double) a", "rand(1) b"), "b", ["a"])
    with pytest.raises(ValueError):
        fit.acf_pacf()
    assert "Durbin-Watson" not in [r["test"] for r in fit.residual_diagnostics().collect()]


def test_target_is_the_best_explained_column(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=100)
    frame = pd.DataFrame({"u": rng.normal(size=100), "a": a, "b": a + rng.normal(size=100) * 0.1, "k": 1.0})
    df = spark.createDataFrame(frame)
    corr = frame.drop(columns="k").corr().abs()
    want = max(corr, key=lambda c: corr[c].drop(c).mean())
    assert reg.choose_target(df) == want
    assert reg.fit_ols(df, " nonsense ").target == want


def test_histogram_keeps_every_row(skewed):
    frame, df = skewed
    got = cd.histogram(df, ["x", "z"], bins=7).toPandas()
    assert got.groupby("variable")["n"].sum().tolist() == [len(frame)] * 2
    want = np.histogram(frame["x"], bins=7)[0]
    assert got[got["variable"] == "x"].sort_values("bin")["n"].tolist() == want.tolist()
    assert cd.auto_bins(100) == 10 and cd.auto_bins(500) == 25 and cd.auto_bins(10**6) == 50


def test_hierarchy_conserves_totals(skewed):
    frame, df = skewed
    got = cd.hierarchy(df, ["group", "half"], "x").toPandas()
    for d in (0, 1, 2):
        assert got[got["depth"] == d]["total"].sum() == pytest.approx(frame["x"].sum())
    assert got[got["depth"] == 2].groupby("level_1")["percent_of_parent"].sum().tolist() == pytest.approx([100.0] * 3)


@pytest.mark.parametrize("task_rows", [10_000, 200])
def test_box_and_violin(skewed, task_rows):
    frame, df = skewed
    got = cd.box_summary(df, "y", "group", task_rows).toPandas().set_index("grp")
    for g, part in frame.groupby("group"):
        q1, q2, q3 = part["y"].quantile([0.25, 0.5, 0.75])
        ok = part["y"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        assert got.loc[g, "whisker_high"] == part["y"][ok].max() and got.loc[g, "outliers"] == (~ok).sum()
    assert cd.box_outliers(df, "y", "group", task_rows).count() == got["outliers"].sum()
    kde = cd.violin_density(df, "y", "group", 50, task_rows).toPandas()
    one = kde[kde["grp"] == "a"].sort_values("point")
    v = frame[frame["group"] == "a"]["y"].to_numpy()
    iqr = np.subtract(*np.percentile(v, [75, 25]))
    h = 1.059 * min(v.std(ddof=1), iqr / 1.349) * len(v) ** -0.2
    want = [np.exp(-(((x - v) / h) ** 2) / 2).sum() / (len(v) * h * np.sqrt(2 * np.pi)) for x in one["x"]]
    assert one["density"].tolist() == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("task_rows,piece", [(10_000, 100_000), (300, 50)])
def test_qq_points_of_tied_values(skewed, monkeypatch, task_rows, piece):
    frame, df = skewed
    monkeypatch.setattr(cd, "RUN_PIECE", piece)
    got = cd.qq_points(df, "x", task_rows).toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(1, len(frame) + 1))
    assert np.array_equal(got["sample"], np.sort(frame["x"]))
    slope, intercept = np.polyfit(got["theoretical"], got["sample"], 1)
    line = cd.qq_line(df, "x", task_rows).first()
    assert (line["slope"], line["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))


@pytest.mark.parametrize("tail", [0.0, 1e4])
def test_binned_density_is_within_its_bound(spark, tail):
    rng = np.random.default_rng(17)
    x = np.concatenate([rng.normal(0, 1, 1500), rng.exponential(3, 500), [tail]])
    x[:300] = 0.25
    frame = pd.DataFrame({"g": ["a"] * 2001 + ["b"] * 40 + ["flat"] * 3, "x": np.concatenate([x, rng.uniform(0, 1, 40), [2.0] * 3])})
    df = spark.createDataFrame(frame)
    exact = cd.violin_density(df, "x", "g").toPandas().set_index(["grp", "point"])
    binned = cd.violin_binned(df, "x", "g").toPandas().set_index(["grp", "point"])
    assert set(exact.index) == set(binned.index) and len(exact) == 200
    off = (binned["density"] - exact["density"].reindex(binned.index)).abs()
    assert (off <= binned["error_bound"] * (1 + 1e-9) + 1e-15).all() and off.max() > 0
    parts = cd.violin(df, "x", "g").toPandas()
    box = cd.box_summary(df, "x", "g").toPandas().set_index("grp")
    for name in ("q1", "median", "q3", "whisker_low", "whisker_high"):
        assert parts[parts["part"] == name].set_index("grp")["x"].to_dict() == box[name].to_dict()
    assert parts[parts["part"] == "outlier"].groupby("grp").size().to_dict() == {g: n for g, n in box["outliers"].items() if n}
    assert cd.violin(df.where("false"), "x", "g").count() == 0


def test_a_chart_that_fails_on_its_rows_shows_in_the_status(spark):
    df = spark.range(10).selectExpr("cast(id as double) as ok", "case when id < 9 then 1.0D else raise_error('broken row') end as bad")
    made, status = cd.run_requests(df, [{"type": "histogram", "columns": ["ok"], "title": "a"}, {"type": "bar", "column": "bad", "title": "b"}])
    rows = {r["title"]: r["error"] for r in status.collect()}
    assert set(made) == {"a"} and rows["a"] is None and "broken row" in rows["b"]


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_nearly_collinear_predictors_keep_their_digits(spark, parts):
    rng = np.random.default_rng(31)
    n = 4000
    a = rng.normal(0, 1, n)
    u, v = rng.integers(-8, 9, n) / 8.0, rng.integers(-8, 9, n) * 2.0**-31  # exact in floating point
    frame = pd.DataFrame({"a": a, "u": u, "w": u + v})  # condition about 1e9
    frame["y"] = 3.0 + 2.0 * frame["a"] + 2.0**31 * v + 5.0 * u
    fit = reg.fit_ols(spark.createDataFrame(frame).repartition(parts), "y", ["a", "u", "w"])
    assert fit.rank == 4 and fit.condition_number() > 5e8
    assert fit.beta == pytest.approx([3.0, 2.0, 5.0 - 2.0**31, 2.0**31], rel=1e-6)
    copies = reg.fit_ols(spark.createDataFrame(frame.assign(w=frame["u"])).repartition(parts), "y", ["a", "u", "w"])
    assert copies.rank == 3 and copies.condition_number() == np.inf and copies.beta[2] == pytest.approx(copies.beta[3])


def test_radar_scales_by_the_largest_mean(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 4.0, 0.0), ("c", 2.0, 0.0)], "g string, v double, zero double")
    got = {(r["category"], r["metric"]): r["scaled"] for r in cd.radar(df, "g", ["v", "zero"], k=2).collect()}
    assert got == {("a", "v"): 0.25, ("b", "v"): 1.0, ("a", "zero"): 0.0, ("b", "zero"): 0.0}


def test_requests_survive_a_bad_one(skewed):
    _, df = skewed
    made, status = cd.run_requests(df, [
        {"type": "histogram", "columns": ["x"], "title": "h"}, {"type": "area", "columns": ["x"], "title": "a"},
        {"type": "what"}, {"type": "PIE", "column": "group", "title": "p"}, {"type": "qq", "column": "group"}])
    errors = {r["position"]: r["error"] for r in status.collect()}
    assert set(made) == {"h", "p"} and set(errors) == {1, 2, 4, 5}
    assert errors[1] is None and errors[2] and errors[5] == "Insufficient data for this chart type"


def test_general_run_guards(spark):
    with pytest.raises(ValueError):
        general.general_tests(spark.createDataFrame([(1.0,)], "a double"))
    with pytest.raises(ValueError):
        full.analyse(spark.range(3), mode="other")


def test_findings_select_charts(spark):
    rng = np.random.default_rng(6)
    n = 400
    g = rng.choice(["p", "q", "r"], n)
    a = rng.normal(size=n) + (g == "p") * 2
    frame = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(size=n), "c": rng.exponential(size=n), "g": g,
                          "h": np.where(rng.random(n) < np.where(g == "p", 0.8, 0.2), "yes", "no")})
    df = spark.createDataFrame(frame)
    found = general.findings(df)
    kinds = [r["kind"] for r in charts.chart_plan(found, spark).collect()]
    assert kinds[0] == "scatter" and {"violin", "stacked", "histogram", "qq", "heatmap", "donut", "radar", "sunburst"} <= set(kinds)
    tables = charts.chart_tables(df, found)
    assert len(tables) == len(kinds) and all(t.count() > 0 for t in tables.values())


def test_full_runs(spark, tmp_path):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"id": range(60), "email": [f"u{i}@x.org" for i in range(60)], "v": rng.normal(size=60),
                          "w": rng.normal(size=60), "g": rng.choice(["a", "b"], 60)})
    df = spark.createDataFrame(frame)
    run = full.analyse(df, load_as="sixty.csv", order_by=["id"], write_to=str(tmp_path), name="sixty")
    assert spark.read.parquet(run.files["cleaned"]).count() == spark.read.parquet(run.files["masked"]).count() == 60
    assert spark.read.parquet(run.files["masked"]).where("email like 'u%@x.org'").count() == 0
    assert run.pii == {"email": "email"} and run.manifest.first()["row_count"] == 60
    assert run.general.totals().first()["total_tests_run"] >= 3
    run = full.analyse(df, "regression", target="v", order_by=["id"])
    assert run.regression.fit.target == "v" and "ACF / PACF: Residuals" in run.charts
    assert {"model_summary", "coefficients", "acf_pacf", "assumptions"} <= set(run.regression.tables)


def test_thinned_points_keep_outliers_and_copies_in_count(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, 4000), rng.normal(0, 1, 4000)
    x[:1500] = y[:1500] = 0.25  # a hot point
    x[3999], y[3999] = 50.0, -50.0
    df = spark.createDataFrame(pd.DataFrame({"x": [*x, np.inf, np.nan], "y": [*y, 0.0, 1.0]})).repartition(7)
    got = cd.scatter_thinned(df, "x", "y", grid=50).toPandas()
    assert got["n"].sum() == 4001 and not got.duplicated(["cell_x", "cell_y"]).any()
    assert ((got["x"] == 50.0) & (got["y"] == -50.0) & (got["n"] == 1)).any() and np.isinf(got["x"]).any()
    assert set(zip(got["x"], got["y"])) <= {*zip(x, y), (np.inf, 0.0)}
    again = cd.scatter_thinned(df.repartition(3), "x", "y", grid=50).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, again.values))
    more = cd.scatter_thinned(df, "x", "y", grid=50, per_cell=4).toPandas()
    assert more.groupby(["cell_x", "cell_y"]).size().max() <= 4 and len(more) > len(got)
    assert cd.scatter_thinned(df.where("false"), "x", "y").count() == 0
    same = spark.createDataFrame([(2.0, 2.0)] * 3, "x double, y double")
    assert cd.scatter_thinned(same, "x", "y").collect()[0]["n"] == 3
    parts = cd.scatter(df.where("abs(x) < 9"), "x", "y").toPandas()
    assert len(parts[parts["part"] == "trend"]) == 2 and len(parts) > 100


@pytest.mark.parametrize("n,points,ends", [(3, 1000, 50), (40, 10, 2), (6000, 100, 5), (6000, 7000, 50)])
def test_thinned_qq_points_are_exact(skewed, n, points, ends):
    frame, df = skewed
    df = df.where(f"id < {n}")
    full = cd.qq_points(df, "x").toPandas().set_index("rank")
    got = cd.qq_thinned(df, "x", points, ends, task_rows=300).toPandas().set_index("rank").sort_index()
    steps = max(1, min(points, n) - 1)
    want = {1 + i * (n - 1) // steps for i in range(steps + 1)} | set(range(1, min(ends, n) + 1)) | set(range(max(1, n - ends + 1), n + 1))
    assert got.index.tolist() == sorted(want)
    assert got["sample"].tolist() == full["sample"].reindex(got.index).tolist()
    assert got["theoretical"].tolist() == pytest.approx(full["theoretical"].reindex(got.index).tolist())
    parts = cd.qq(df, "x", points).toPandas()
    assert (parts["part"] == "line").sum() == 2


def test_radar_needs_two_groups(spark):
    with pytest.raises(ValueError):
        cd.radar(spark.createDataFrame([("a", 1.0)], "g string, v double"), "g", ["v"])
