"""CSV records with line breaks inside quotes, read from many ranges of one file.

Spark's text scan cuts a file into ranges of whole lines.  Whether a line break ends a record depends on whether
it lies inside quotes, which depends on all the text before it, but at a line's beginning there are only two states:
a record begins, or a quoted value goes on.  So

1. every range is run from both states and says how each of them ends (two booleans per range),
2. these are chained per file, which gives every range its true state,
3. every range puts its records together; what is cut off at its borders is joined with its neighbours' pieces.

Records keep their text and are parsed by Spark's own CSV parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# A closing quote is one that is not doubled.
CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
PIECES = "file string, at long, first boolean, piece string, text string"
STATES = "file string, at long, inside boolean"


def ends_inside(line: str, inside: bool, separator: str = ",") -> bool:
    """Whether the break after a line lies in quotes, if the line begins inside quotes or with a field."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):  # quotes within an unquoted value are text
                at = line.find(separator, at) + 1
                if not at:
                    return False
                continue
            at += 1
        closed = CLOSING.match(line, at)
        if closed is None:
            return True
        inside = False
        at = line.find(separator, closed.end()) + 1
        if not at:
            return False


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Rows of a batch by (file, at), in order."""
    keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], batch.slice(start, i - start)
            start = i


def _outcomes(separator: str):
    """Per range: the state at its end, for either state at its beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, [False, True]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([states[0]]), pa.array([states[1]])], ["file", "at", "from_out", "from_in"])

        for batch in batches:
            for k, rows in _stretches(batch):
                if k != key:
                    if key:
                        yield row()
                    key, states = k, [False, True]
                lines = rows.column(2)
                for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                    out = {s: ends_inside(line, s, separator) for s in set(states)}
                    states = [out[s] for s in states]
        if key:
            yield row()

    return run


def _chained(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state at the beginning of each range of one file; a row for each range, not for its lines."""
    ranges = ranges.sort_values("at")
    inside, state = [], False
    for out, in_ in zip(ranges["from_out"], ranges["from_in"]):
        inside.append(state)
        state = bool(in_ if state else out)
    return pd.DataFrame({"file": ranges["file"], "at": ranges["at"], "inside": inside})


def _assembled(separator: str):
    """Per range: whole records, and the pieces of records that cross its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, held, first, headless = None, False, [], False, False
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string())
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "at", "first", "piece", "text"])

        def left_over() -> None:
            if held:
                out.append((*key, first, "middle" if headless else "tail", "\n".join(held)))

        for batch in batches:
            for k, rows in _stretches(batch):
                if k != key:
                    left_over()
                    state = rows.column(3)[0].as_py()
                    if state is None:
                        raise RuntimeError("a file was cut into other ranges the second time it was read")
                    key, inside, held, first, headless = k, state, [], k[1] == 0, state
                lines = rows.column(2).to_pylist()
                for line in lines:
                    if inside or '"' in line:
                        inside = ends_inside(line, inside, separator)
                    held.append(line)
                    if not inside:
                        out.append((*key, first, "head" if headless else "record", "\n".join(held)))
                        held, first, headless = [], False, False
            yield flushed()
        left_over()
        yield flushed()

    return run


def records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(file, first, text): the records of CSV files in UTF-8, and whether one is its file's first.

    Quotes are '"', doubled inside a value.  Lines end with a line feed, or carriage return and line feed.  The
    table of the ranges' states, a row for each range of a file, is the only thing that is broadcast.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    outcomes = lines.mapInArrow(_outcomes(separator), "file string, at long, from_out boolean, from_in boolean")
    states = outcomes.groupBy("file").applyInPandas(_chained, STATES)
    placed = lines.join(F.broadcast(states), ["file", "at"], "left").select("file", "at", "value", "inside")
    pieces = placed.mapInArrow(_assembled(separator), PIECES)
    # a file without quotes has no pieces; with them there are two at most per border
    split = pieces.where("piece <> 'record'")
    begins = F.when(F.col("piece") == "tail", F.col("at"))
    so_far = Window.partitionBy("file").orderBy("at", F.col("piece") == "tail").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = split.withColumn("begin", F.last(begins, ignorenulls=True).over(so_far)).groupBy("file", "begin").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("at", F.col("piece") == "tail", "text"))).alias("parts"))
    # the piece that begins a record sorts last among those of its range, and first in its chain
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return pieces.where("piece = 'record'").select("file", "first", "text").unionByName(joined.select("file", "first", text.alias("text")))


def parsed(rows: DataFrame, schema: T.StructType | None, separator: str = ",") -> DataFrame:
    """The columns of CSV records: named by the first record of the first file, all of them text, or as `schema` says."""
    spark = rows.sparkSession
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    text = F.regexp_replace("text", r"\r\z", "")
    rows = rows.withColumn("text", F.when(F.col("first"), F.ltrim(text, F.lit("﻿"))).otherwise(text))
    rows = rows.where(F.trim("text") != "")
    if schema is None:
        header = rows.where("first").orderBy("file").select("text").first()
        if header is None:
            return spark.createDataFrame([], T.StructType([]))
        names = spark.read.options(**options, header="true").csv(spark.sparkContext.parallelize([header["text"]], 1)).columns
        fields = [(name, "string") for name in names]
    else:
        fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    ddl = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(fields))
    values = F.from_csv("text", ddl, options)

    def value(i: int) -> Column:
        return F.col("row")[f"c{i}"]

    return rows.where(~F.col("first")).select(values.alias("row")).select(*[value(i).alias(name) for i, (name, _) in enumerate(fields)])
