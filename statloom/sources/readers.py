"""CSV and Parquet scans with missing values normalised once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.frames import chunks, col, cut
from statloom.functions.missing import NUMBER_TEXT, NA_TOKENS, normalise_missing, number_or_null
from statloom.sources import quoted

WHOLE_TEXT = r"^\s*[+-]?[0-9]+\s*$"
# Texts that make a boolean column.
BOOLEAN_TEXT = ["True", "TRUE", "true", "False", "FALSE", "false"]


class EmptyInputError(ValueError):
    """The input has no rows or no columns."""


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest of long, double, boolean that fits every value.

    Runs after NA tokens became null, so a number column with gaps stays a
    number column.  One aggregate over all columns; dates stay text.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    casts = {}
    for part in chunks(text, 30):
        aggs = []
        for i, name in enumerate(part):
            c = col(name)
            aggs += [
                F.count(c).alias(f"n{i}"),
                F.count_if(c.rlike(WHOLE_TEXT) & F.trim(c).try_cast("long").isNotNull()).alias(f"w{i}"),
                F.count_if(c.rlike(NUMBER_TEXT)).alias(f"d{i}"),
                F.count_if(c.isin(BOOLEAN_TEXT)).alias(f"b{i}"),
            ]
        row = df.agg(*aggs).first()
        for i, name in enumerate(part):
            n, c = row[f"n{i}"], col(name)
            if n and row[f"w{i}"] == n:
                casts[name] = F.trim(c).cast("long")
            elif n and row[f"d{i}"] == n:
                casts[name] = number_or_null(c)
            elif n and row[f"b{i}"] == n:
                casts[name] = F.lower(c) == "true"
            elif n == 0:  # nothing but missing values
                casts[name] = F.lit(None).cast("double")
    return df.withColumns(casts) if casts else df


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", schema: T.StructType | None = None,
             multi_line: bool = True, na_tokens=NA_TOKENS) -> DataFrame:
    """Scan CSV with a header; types inferred unless a schema is given.

    Line breaks inside quotes are read right.  UTF-8 files are read in ranges,
    however large one file is (see `quoted`); other encodings take one task per
    file.  `multi_line=False` saves the pass that looks for quotes and is an error
    if any line has an odd number of them.  Production jobs should pass `schema`:
    it saves the inference pass.
    """
    if multi_line and encoding.upper().replace("_", "-") in ("UTF-8", "UTF8", "US-ASCII", "ASCII"):
        rows = quoted.records(spark, path)
        # without a schema the records are looked at several times
        raw = quoted.parsed(rows if schema else cut(rows, "csv-records"), schema)
    else:
        raw = _plain_scan(spark, path, encoding, schema, multi_line)
    if not raw.columns or raw.isEmpty():
        raise EmptyInputError("CSV file is empty or has no columns.")
    clean = normalise_missing(raw, na_tokens)
    return clean if schema else infer_types(clean)


def _plain_scan(spark: SparkSession, path: str, encoding: str, schema: T.StructType | None, multi_line: bool) -> DataFrame:
    if not multi_line:
        quotes = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
        if not spark.read.text(path).where(quotes % 2 == 1).isEmpty():
            raise ValueError("a quoted value holds a line break: read this file with multi_line=True")
    reader = (
        spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )
    return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=False)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Scan Parquet; NaN in floating columns is read as null."""
    df = spark.read.parquet(path)
    floats = {f.name: F.when(~F.isnan(col(f.name)), col(f.name))
              for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(floats) if floats else df
