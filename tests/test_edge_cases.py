"""Columns with scratch names, constant targets, and predictors that are constant on the complete rows."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.functions import frames
from statloom.operators import association, groups, pii, ranks, regression
from statloom.sources import readers


def test_ranks_of_columns_with_scratch_names(spark):
    frame = pd.DataFrame({"value": [float(i % 50) if i % 2 else 0.0 for i in range(4000)], "bucket": [float(i % 7) for i in range(4000)]})
    df = spark.createDataFrame(frame).repartition(4)
    out = ranks.attach_ranks(df, ["value", "bucket"], 4000, task_rows=300, broadcast_ok=False)
    got = out.toPandas()
    assert list(got.columns[:2]) == ["value", "bucket"]
    fresh = [c for c in got.columns if c not in ("value", "bucket")]
    for name, rank in zip(("value", "bucket"), fresh):
        assert (got[rank] == got[name].rank()).all()


def test_equal_hot_rows_are_spread(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [0.0] * 3000 + [float(i) for i in range(1, 3001)]})).repartition(4)
    splits = ranks.split_points(df, ["x"], 6000, 500)["x"]
    ranked = ranks._windowed_rank(df, df, "x", "r", splits)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or all this is one partition
    sizes = [r["n"] for r in ranked.withColumn("p", F.spark_partition_id()).groupBy("p", "r").agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranked.where("x = 0").select("r").distinct().first()["r"] == 1500.5
    assert sum(sizes) == 6000 and max(sizes) < 2500


def fit(spark, frame):
    return regression.fit_ols(spark.createDataFrame(frame), "y", ["a", "b"])


def test_constant_target_and_constant_predictor(spark):
    n = 60
    base = pd.DataFrame({"a": [float(i) for i in range(n)], "b": [math.sin(i) for i in range(n)], "y": [3.0] * n})
    model = fit(spark, base)
    assert model.model_summary().first()["r_squared"] is None
    late = base.assign(y=base["a"] * 2 + base["b"], b=1.0)
    model = fit(spark, late.assign(y=late["y"] + [math.cos(7 * i) for i in range(n)]))
    vif = {r["variable"]: (r["vif"], r["multicollinearity"]) for r in model.vif().collect()}
    assert vif["a"] == (1.0, "low") and vif["b"] == (None, "constant")


def _grouped(spark):
    n = 2400
    return spark.createDataFrame(pd.DataFrame({
        "g": [f"g{i % 300}" for i in range(n)], "two": ["ab"[i % 2] for i in range(n)],
        "x": [float((i * 7919) % 101) for i in range(n)], "y": [float(i % 17) for i in range(n)]}))


@pytest.mark.parametrize("test", ["t", "anova", "mannwhitney", "kruskal"])
def test_more_groups_than_the_driver_holds(spark, monkeypatch, test):
    df, pairs = _grouped(spark), [("g", "x"), ("two", "x"), ("two", "y")]
    want = groups.compare_groups(df, test, pairs).orderBy("category", "variable").toPandas()
    monkeypatch.setattr(frames, "PIN_ROWS", 50)
    got = groups.compare_groups(df, test, pairs, task_rows=500).orderBy("category", "variable").toPandas()
    assert len(want) == (2 if test in ("t", "mannwhitney") else 3)
    pd.testing.assert_frame_equal(got, want)


def test_more_cells_than_the_driver_holds(spark, monkeypatch):
    table = association.crosstab(_grouped(spark), [("g", "two"), ("two", "y")])
    want = association.chi_squared(table).orderBy("col_a").toPandas()
    shares = association.row_percent(_grouped(spark), "g", "two").orderBy("a", "b").toPandas()
    monkeypatch.setattr(frames, "PIN_ROWS", 50)
    pd.testing.assert_frame_equal(association.chi_squared(table).orderBy("col_a").toPandas(), want)
    pd.testing.assert_frame_equal(association.row_percent(_grouped(spark), "g", "two").orderBy("a", "b").toPandas(), shares)


def test_bucket_of_one_column_is_that_of_the_long_form(spark):
    values = [float("-inf"), -3.0, 0.0, 0.5, 1.0, 7.25, 99.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    for splits in (ranks.Splits([]), ranks.Splits([0.0, 1.0, 8.0], -3.0, 99.0), ranks.Splits([0.0, 1.0, 8.0], -3.0, 99.0, 4)):
        both = ranks.with_bucket(df.withColumn("variable", F.lit("v")), {"v": splits}).withColumn("again", ranks.bucket_of("value", splits))
        assert all(r["bucket"] == r["again"] for r in both.collect())


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,note\n1,"x\ny"\n2,"say ""so"""\n')
    rows = readers.read_csv(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["note"]) for r in rows] == [(1, "x\ny"), (2, 'say "so"')]
    with pytest.raises(ValueError, match="line break"):
        readers.read_csv(spark, str(path), multi_line=False)
    path.write_text('id,note\n1,"x y"\n2,z\n')
    assert readers.read_csv(spark, str(path), multi_line=False).count() == 2


def test_first_rows_need_an_order(spark):
    df = spark.createDataFrame([(1, "a@b.org"), (1, "none")], "k long, mail string")
    with pytest.raises(ValueError, match="order_by"):
        pii.content_hits(df, sample_size=1)
    assert pii.content_hits(df, sample_size=1, order_by=["k"]).first()["email"] == 1.0  # the tie goes to the smaller value
