"""CSV files with quoted line breaks, cut into ranges of a few bytes, against Python's and Spark's own readers."""

import csv
import io
import random
from pathlib import Path

import pytest
from pyspark.sql import types as T

from registry import sources
from statloom.sources import quoted, readers


@pytest.fixture
def ranges_of(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    usual = {k: spark.conf.get(k, None) for k in keys}

    def cut_into(size: int):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield cut_into
    for k, v in usual.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def texts(rows):
    return sorted(tuple("" if v is None else v for v in r) for r in rows)


def test_every_border_inside_and_outside_quotes(spark, tmp_path, ranges_of):
    rng = random.Random(3)
    bits = ['a', 'b"c', '\n', ',', '"', 'é', ' ', '\n\n', 'x' * 9, '\r\n', ',"', '"\n"']
    rows = [[str(i), "".join(rng.choice(bits) for _ in range(rng.randint(1, 8))), rng.choice(["plain", "two words", 'say "hi"'])] for i in range(40)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([["id", "no\nte", "kind"], *rows])
    path = tmp_path / "all.csv"
    path.write_bytes(out.getvalue().encode())
    for size in (16, 37, 10**6):
        ranges_of(size)
        df = quoted.parsed(quoted.records(spark, str(path)), None)
        if size < 100:
            assert quoted.records(spark, str(path)).select("file").rdd.getNumPartitions() >= 8
        assert df.columns == ["id", "no\nte", "kind"]
        assert texts(df.collect()) == texts(rows)


def test_stray_quotes_blank_lines_and_line_ends_as_the_plain_reader_has_them(spark, tmp_path, ranges_of):
    body = 'id,note\r\n1,5" pipe\r\n2,"a\r\nb"\r\n\r\n3,"q""q\n""\n"\r\n4,x"y,"z\n5,"""\n,"""\n6,\n7,""\n8,"tail\nof it'
    path = tmp_path / "odd.csv"
    path.write_bytes(body.encode())
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
    want = spark.read.options(**options).csv(str(path)).collect()
    for size in (5, 11):
        ranges_of(size)
        got = quoted.parsed(quoted.records(spark, str(path)), None).collect()
        assert ("2", "a\r\nb") in texts(got)  # the plain reader turns this break into a line feed
        assert [(a, b.replace("\r", "")) for a, b in texts(got)] == texts(want)


def test_several_files_schema_and_mark_at_the_beginning(spark, tmp_path, ranges_of):
    for k in range(3):
        rows = "".join(f'{k * 10 + i},"line {i}\nof {k}",{i / 2}\n' for i in range(10))
        (tmp_path / f"f{k}.csv").write_text(("﻿" if k == 0 else "") + "id,note,x\n" + rows)
    ranges_of(20)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType()), T.StructField("x", T.DoubleType())])
    for df in (readers.read_csv(spark, str(tmp_path)), readers.read_csv(spark, str(tmp_path), schema=schema)):
        assert df.dtypes == [("id", "bigint"), ("note", "string"), ("x", "double")]
        assert sorted(map(tuple, df.collect())) == [(k * 10 + i, f"line {i}\nof {k}", i / 2) for k in range(3) for i in range(10)]


def test_a_value_longer_than_many_ranges(spark, tmp_path, ranges_of):
    long = "\n".join(f'row {i} with "marks"' for i in range(40))
    path = tmp_path / "long.csv"
    with path.open("w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([["id", "text"], ["1", long], ["2", "b"], ["3", long + "!"]])
    ranges_of(64)
    got = {r["id"]: r["text"] for r in readers.read_csv(spark, str(path)).collect()}
    assert got == {1: long, 2: "b", 3: long + "!"}


@pytest.mark.parametrize("body", ["", "\n\n", "a,b\n"])
def test_files_without_rows(spark, tmp_path, body):
    path = tmp_path / "none.csv"
    path.write_text(body)
    with pytest.raises(readers.EmptyInputError):
        readers.read_csv(spark, str(path))


def test_states_at_line_ends():
    cases = [('a,b', False, False), ('a,"b', False, True), ('b"', True, False), ('b""', True, True), ('b"""', True, False), ('x"y,z', False, False),
             ('"a","b', False, True), ('"a"x,"b"', False, False), ('c",d,"e', True, True), ('', True, True), ('', False, False), ('""', False, False), ('"""', False, True)]
    for line, before, after in cases:
        assert quoted.ends_inside(line, before) is after, line


def test_the_split_scan_writes_its_files_side_by_side(spark, tmp_path, monkeypatch):
    """No task writes, and so reads, the whole table: its rows go to as many files as the table has parts."""
    seen = []
    usual = readers.read_csv
    monkeypatch.setattr(readers, "read_csv", lambda spark, path: seen.append(path) or usual(spark, path))
    rows = [(i, f'line {i}\nof "{i % 7}",\n\nend', "en", 20 + i) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    (bytes_each, open_cost) = (spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    try:
        got = sorted(map(tuple, sources.csv_scan_split(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_each)
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
    assert got == rows
    assert len(list(Path(seen[0]).glob("part-*.csv"))) >= 4
