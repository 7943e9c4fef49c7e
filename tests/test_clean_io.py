import pytest
from pyspark.sql import functions as F

from statloom.functions.frames import cut, pin
from statloom.operators import clean as cl
from statloom.sources import readers, writers


def test_fills(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (None, None, None), (4, 4.0, "a"), (4, 4.0, "a"), (2, 2.0, "b")],
                               "i int, d double, t string")
    assert cl.fill_mean(df, "i").where("d is null").first()["i"] == pytest.approx(2.75)
    assert cl.fill_median(df, "d").where("i is null").first()["d"] == 3.0
    assert cl.fill_mode(df, "t").where("i is null").first()["t"] == "a"  # tie: the smaller
    assert cl.fill_mode(df, "i").where("d is null").first()["i"] == 4
    assert cl.fill_zero(df, "d").where("i is null").first()["d"] == 0.0
    assert cl.fill_value(df, "t", "?").where("i is null").first()["t"] == "?"
    assert cl.drop_null_rows(df, "t").count() == 4
    with pytest.raises(ValueError):
        cl.fill_mean(df, "t")
    with pytest.raises(ValueError):
        cl.fill_value(df, "d", "mean")


def test_fills_without_any_value(spark):
    df = spark.createDataFrame([(None, None)], "d double, t string")
    assert cl.fill_mean(df, "d").first()["d"] is None
    assert cl.fill_mode(df, "t").first()["t"] == "unknown"
    assert cl.drop_empty_columns(df.withColumn("x", F.lit(1))).columns == ["x"]


def test_sparse_rows_keep_half(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (1, 2, None, None, None)], "a int, b int, c int, d int, e int")
    assert cl.drop_sparse_rows(df).count() == 1  # int(5 * 0.5) = 2


def test_conversions(spark):
    df = spark.createDataFrame([("9007199254740993",), ("1e3",), ("2.5",), ("5d",), (" 7 ",), ("x",), (None,)], "v string")
    assert [r[0] for r in cl.convert_type(df, "v", "int").collect()] == [9007199254740993, 1000, None, None, 7, None, None]
    assert [r[0] for r in cl.convert_type(df, "v", "float").collect()][1:] == [1000.0, 2.5, None, 7.0, None, None]
    dates = spark.createDataFrame([("2024-03-01",), ("3/1/2024",), ("nope",)], "v string")
    got = [r[0] for r in cl.convert_type(dates, "v", "datetime").collect()]
    assert got[0] == got[1] and got[2] is None
    assert cl.convert_type(df, "v", "category").schema["v"].dataType.typeName() == "string"
    with pytest.raises(ValueError):
        cl.convert_type(df, "v", "complex")


def test_outliers_in_sequence(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in [*range(20), 100, None or 30]], "a double, b double")
    assert cl.iqr_bounds(df, "b") is None
    kept = cl.remove_outliers(df, ["a", "b"])
    assert kept.agg(F.max("a")).first()[0] == 30.0 and kept.count() == 21


def test_clean_run_reports_each_stage(spark):
    rows = [(1, 1.0, "x", None), (1, 1.0, "x", None), (2, None, None, None), (3, 3.0, "y", None), (4, 500.0, "x", None),
            (5, 2.0, "x", None), (6, 2.5, "x", None), (7, 1.5, "x", None)]
    df = spark.createDataFrame(rows, "id long, v double, t string, e string")
    done = cl.clean(df, {"remove_outliers": ["v"], "convert_types": {"id": "str"}, "fill_nulls": {"t": "none given"}})
    totals = cl.cleaning_totals(done.report).first()
    assert (totals["rows_before"], totals["duplicates_removed"], totals["outliers_removed"], totals["columns_dropped"]) == (8, 1, 1, 1)
    assert done.df.columns == ["id", "v", "t"] and done.df.count() == totals["rows_after"] == 6
    assert done.df.where("id = '2'").first()["t"] == "none given"
    with pytest.raises(ValueError):
        cl.clean(df, {"drop_duplicate": True})


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('i,f,b,t,d,all\n1,1.5,True,"a, ""q""",2024-01-01,NA\n,NA,false,null,2024-01-02,\n3,-2e3,TRUE,5d,n/a,NaN\n')
    df = readers.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "t": "string", "d": "string", "all": "double"}
    got = df.collect()
    assert got[0]["t"] == 'a, "q"' and got[1]["t"] is None and got[1]["i"] is None and got[2]["f"] == -2000.0
    empty = tmp_path / "e.csv"
    empty.write_text("a,b\n")
    with pytest.raises(readers.EmptyInputError):
        readers.read_csv(spark, str(empty))


def test_csv_encoding(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes("n\nZoë\n".encode("latin-1"))
    assert readers.read_csv(spark, str(path), encoding="ISO-8859-1").first()["n"] == "Zoë"


def test_names():
    assert writers.safe_column_names(["a b", "a_b", "a-b"]) == ["a_b", "a_b_1", "a_b_2"]
    clash = writers.safe_column_names(["a", "a_1", "a", "A"])
    assert len({c.lower() for c in clash}) == 4 and clash[:2] == ["a", "a_1"]
    assert writers.table_name("2024 Sales--EU") == "t_2024_sales_eu"
    assert writers.database_name("/x/My File.csv") == writers.database_name("My File.csv")
    assert writers.database_name("a.csv") != writers.database_name("b.csv")


def test_load_masks_and_replaces(spark):
    df = spark.createDataFrame([(1, "Ann", 2.0), (2, "Bob", 2.0)], "id long, name string, `a b` double")
    for _ in range(2):
        manifest = writers.load_tables(df, "staff.csv", {"tables": [{"name": "who", "source_columns": ["name"]},
                                                                  {"name": "amounts", "source_columns": ["a_b"]}]}).collect()
    assert [(r["table_name"], r["row_count"], r["total_rows"]) for r in manifest] == [("who", 2, 3), ("amounts", 1, 3)]
    loaded = spark.table(f"`{manifest[0]['db_name']}`.who")
    assert all(r["name"].startswith("PERSON_") for r in loaded.collect())
    with pytest.raises(ValueError):
        writers.drop_database(spark, "default")
    with pytest.raises(ValueError):
        writers.load_tables(df.limit(0), "staff.csv")


def test_a_failed_load_leaves_the_last_one(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "a long, b double")
    design = {"tables": [{"name": "left", "source_columns": ["a"]}, {"name": "right", "source_columns": ["b"]}]}
    db = writers.load_tables(df, "pairs.csv", design).first()["db_name"]
    seen = lambda: sorted(t.name for t in spark.catalog.listTables(db))
    rows = lambda t: sorted(r[0] for r in spark.table(f"`{db}`.`{t}`").collect())
    bad = df.selectExpr("a + 10 as a", "if(a > 1, cast(raise_error('lost') as double), b) as b")
    with pytest.raises(Exception, match="lost"):
        writers.load_tables(bad, "pairs.csv", design)
    assert seen() == ["left", "right"] and rows("left") == [1, 2] and rows("right") == [2.0, 3.0]

    # the driver is lost after the manifest: the next look at the database ends the swap, from wherever it stood
    newer = {"tables": [{"name": "left", "source_columns": ["a"]}, {"name": "third", "source_columns": ["b"]}]}
    writers.stage_tables(df.selectExpr("a + 20 as a", "b"), "pairs.csv", newer)
    assert rows("left") == [1, 2]
    spark.sql(f"DROP TABLE `{db}`.left")
    assert writers.settle_load(spark, "pairs.csv")
    assert seen() == ["left", "third"] and rows("left") == [21, 22] and rows("third") == [2.0, 3.0]

    # staged tables without a manifest were never loaded
    df.write.saveAsTable(f"`{db}`.left{writers.STAGED}dead")
    assert not writers.settle_load(spark, "pairs.csv") and seen() == ["left", "third"]
    assert not writers.settle_load(spark, "never loaded.csv")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ann")], "id long, name string")
    assert spark.read.parquet(writers.write_cleaned(df, str(tmp_path), "p")).count() == 1
    assert writers.write_masked(df.select("id"), str(tmp_path), "q") is None
    masked = writers.write_masked(df, str(tmp_path), "p", "csv")
    assert readers.read_csv(spark, masked).first()["name"].startswith("PERSON_")


def test_cut_and_pin(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) t")
    assert cut(df, "t").count() == 10
    assert "parquet" in cut(df, "t")._jdf.queryExecution().toString().lower()
    assert pin(df).count() == 10
