"""Cleaning stages (lazy transforms) and the configured cleaning run with its report.

Stage order matters: duplicates, configured nulls, mostly-empty rows, automatic
fills, type conversions, outliers, empty columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.frames import as_double, chunks, col, cut, is_numeric, is_text, local_table, present
from statloom.functions.missing import number_or_null
from statloom.operators.profile import value_counts
from statloom.operators.ranks import quantiles
from statloom.operators.roles import columns_of

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(present(df, column).isNotNull())


def null_counts(df: DataFrame, cols: list[str] | None = None) -> dict[str, int]:
    cols = df.columns if cols is None else cols
    out: dict[str, int] = {}
    for part in chunks(cols, 100):
        row = df.agg(*[F.count_if(present(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(part)]).first()
        out.update(dict(zip(part, row)))
    return out


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Most frequent value per column as text; ties go to the smallest value.

    Numeric values are compared as numbers, so 10 does not sort before 9.
    """
    out: dict[str, str] = {}
    text = [c for c in cols if not is_numeric(df.schema[c].dataType)]
    if text:
        best = value_counts(df, text).groupBy("variable").agg(
            F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))).alias("top")
        )
        out.update({r["variable"]: r["top"]["value"] for r in best.collect()})
    for c in cols:
        if c not in text:
            top = (
                df.select(present(df, c).alias("value")).where("value is not null")
                .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
                .agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))).alias("top")).first()["top"]
            )
            if top is not None:
                out[c] = top["value"]
    return out


def _literal(value, dtype: T.DataType, name: str) -> Column:
    if is_numeric(dtype):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"cannot fill numeric column {name!r} with {value!r}")
        whole = isinstance(dtype, INTEGRAL) and float(value) != int(value)
        return F.lit(value).cast("double" if whole else dtype)
    if is_text(dtype):
        return F.lit(str(value))
    return F.lit(value).cast(dtype)


def fill_value(df: DataFrame, name: str, value) -> DataFrame:
    """Replace nulls by a literal; an integer column given a fraction becomes double."""
    dtype = df.schema[name].dataType
    lit = _literal(value, dtype, name)
    c = present(df, name)
    if isinstance(dtype, INTEGRAL) and isinstance(value, float) and value != int(value):
        c = c.cast("double")
    return df.withColumn(name, F.coalesce(c, lit))


def fill_mean(df: DataFrame, name: str) -> DataFrame:
    _require_numeric(df, name, "mean")
    mean = df.agg(F.avg(as_double(df, name))).first()[0]
    return df if mean is None else fill_value(df, name, mean)


def fill_median(df: DataFrame, name: str) -> DataFrame:
    _require_numeric(df, name, "median")
    median = quantiles(df, [name], [0.5])[name][0]
    return df if median is None else fill_value(df, name, median)


def fill_mode(df: DataFrame, name: str) -> DataFrame:
    modes = column_modes(df, [name])
    if name in modes:
        return fill_value(df, name, modes[name])
    return fill_value(df, name, "unknown") if is_text(df.schema[name].dataType) else df


def fill_zero(df: DataFrame, name: str) -> DataFrame:
    return fill_value(df, name, 0)


def _require_numeric(df: DataFrame, name: str, method: str) -> None:
    if not is_numeric(df.schema[name].dataType):
        raise ValueError(f"{method} fill needs a numeric column, {name!r} is not")


FILLS = {"drop": drop_null_rows, "mean": fill_mean, "median": fill_median, "mode": fill_mode, "zero": fill_zero}


def drop_sparse_rows(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Keep rows with at least int(columns * share) non-null values."""
    need = int(len(df.columns) * share)
    filled = sum((present(df, c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    return df.where(filled >= need)


def auto_fill_numeric(df: DataFrame, skip=()) -> tuple[DataFrame, list[str]]:
    """Median-fill numeric columns that have nulls; returns the filled columns too."""
    cols = [c for c in columns_of(df, "numeric") if c not in skip]
    nulls = null_counts(df, cols) if cols else {}
    cols = [c for c in cols if nulls[c]]
    medians = quantiles(df, cols, [0.5])
    done = []
    for c in cols:
        if medians[c][0] is not None:
            df = fill_value(df, c, medians[c][0])
            done.append(c)
    return df, done


def auto_fill_text(df: DataFrame, skip=()) -> tuple[DataFrame, list[str]]:
    """Mode-fill text columns that have nulls; wholly null columns are left for removal."""
    cols = [c for c in columns_of(df, "categorical") if c not in skip]
    nulls = null_counts(df, cols) if cols else {}
    cols = [c for c in cols if nulls[c]]
    modes = column_modes(df, cols) if cols else {}
    done = [c for c in cols if c in modes]
    for c in done:
        df = fill_value(df, c, modes[c])
    return df, done


# Timestamp layouts tried after the ISO form.
DATE_FORMATS = ["M/d/yyyy", "M/d/yyyy H:mm:ss", "yyyy/M/d", "d-MMM-yyyy"]


def convert_type(df: DataFrame, name: str, target: str) -> DataFrame:
    """int, float, str, datetime or category; a bad value becomes null."""
    dtype = df.schema[name].dataType
    c = present(df, name)
    number = number_or_null(c) if is_text(dtype) else c.try_cast("double") if is_numeric(dtype) else c.cast("double")
    if target == "int":
        if isinstance(dtype, INTEGRAL):
            out = c.cast("long")
        else:
            # text goes straight to long where possible: doubles lose digits above 2^53
            exact = F.trim(c).try_cast("long") if is_text(dtype) else number.try_cast("long")
            out = F.when(number == F.floor(number), F.coalesce(exact, number.try_cast("long")))
    elif target == "float":
        out = number
    elif target in ("str", "category"):
        out = c.cast("string")
    elif target == "datetime":
        if is_numeric(dtype):  # nanoseconds since the epoch
            out = F.timestamp_micros((c / 1000).try_cast("long"))
        elif is_text(dtype):
            out = F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])
        else:
            out = c.cast("timestamp")
    else:
        raise ValueError(f"unknown target type {target!r}")
    return df.withColumn(name, out)


def iqr_bounds(df: DataFrame, name: str) -> tuple[float, float] | None:
    """Outlier fences, or None when the quartiles coincide or no value exists."""
    q1, q3 = quantiles(df, [name], [0.25, 0.75])[name]
    if q1 is None or q3 == q1:
        return None
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def remove_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fence columns one after another; quartiles are recomputed on the survivors."""
    for name in cols:
        bounds = iqr_bounds(df, name)
        if bounds:
            df = df.where(as_double(df, name).between(*bounds))
    return df


def drop_empty_columns(df: DataFrame) -> DataFrame:
    total = df.count()
    nulls = null_counts(df)
    return df.drop(*[c for c in df.columns if nulls[c] == total])


# --- the configured run ----------------------------------------------------

CONFIG_KEYS = {"drop_duplicates", "fill_nulls", "convert_types", "remove_outliers", "auto_clean_remaining"}
REPORT_SCHEMA = "step int, stage string, column string, action string, rows_before long, rows_after long"


@dataclass
class Cleaned:
    df: DataFrame
    report: DataFrame


def clean(df: DataFrame, config: dict | None = None) -> Cleaned:
    """Run every stage in order and report what each one did.

    The frame, de-duplicated if that is wanted, is written once to the shared
    scratch folder, so the statistics passes that follow read single columns
    instead of repeating the source's plan or the whole-row shuffle.
    """
    config = config or {}
    unknown = set(config) - CONFIG_KEYS
    if unknown:
        raise ValueError(f"unknown cleaning keys: {sorted(unknown)}")
    spark = df.sparkSession
    report: list[tuple] = []

    def note(stage, column, action, before, after):
        report.append((len(report) + 1, stage, column, action, before, after))

    rows = df.count()
    note("input", None, "read", rows, rows)
    if not config.get("drop_duplicates", True):
        df = cut(df, "to-clean")
    else:
        df = cut(drop_duplicates(df), "deduplicated")
        after = df.count()
        note("duplicates", None, "dropped duplicate rows", rows, after)
        rows = after

    fills = config.get("fill_nulls", {})
    for name, method in fills.items():
        if name not in df.columns:
            continue
        step = FILLS.get(method) if isinstance(method, str) else None
        df = step(df, name) if step else fill_value(df, name, method)
        after = df.count() if method == "drop" else rows
        note("fill_nulls", name, "dropped rows" if method == "drop" else method if step else f"literal: {method}",
             rows, after)
        rows = after

    if config.get("auto_clean_remaining", True):
        df = drop_sparse_rows(df)
        after = df.count()
        note("sparse_rows", None, "dropped rows with >50% null values", rows, after)
        rows = after
        df, filled = auto_fill_numeric(df, skip=fills)
        for name in filled:
            note("auto_fill", name, "auto: median", rows, rows)
        df, filled = auto_fill_text(df, skip=fills)
        for name in filled:
            note("auto_fill", name, "auto: mode", rows, rows)

    for name, target in config.get("convert_types", {}).items():
        if name in df.columns:
            df = convert_type(df, name, target)
            note("convert_types", name, target, rows, rows)

    for name in config.get("remove_outliers", []):
        if name not in df.columns or not is_numeric(df.schema[name].dataType):
            continue
        bounds = iqr_bounds(df, name)
        if bounds is None:
            note("outliers", name, "skipped (constant values)", rows, rows)
            continue
        df = df.where(as_double(df, name).between(*bounds))
        after = df.count()
        note("outliers", name, "dropped rows outside 1.5 IQR", rows, after)
        rows = after

    nulls = null_counts(df)
    gone = [c for c in df.columns if nulls[c] == rows]
    for name in gone:
        note("empty_columns", name, "dropped column", rows, rows)
    df = df.drop(*gone)
    note("output", None, "all rows removed" if rows == 0 else "kept", rows, rows)
    return Cleaned(df, local_table(spark, report, REPORT_SCHEMA))


def cleaning_totals(report: DataFrame) -> DataFrame:
    """One row: rows before and after, duplicates, outliers, fills, conversions, dropped columns."""
    lost = F.col("rows_before") - F.col("rows_after")
    of = lambda stage: F.col("stage") == stage
    return report.agg(
        F.max(F.when(of("input"), F.col("rows_before"))).alias("rows_before"),
        F.max(F.when(of("output"), F.col("rows_after"))).alias("rows_after"),
        F.coalesce(F.sum(F.when(of("duplicates"), lost)), F.lit(0)).alias("duplicates_removed"),
        F.coalesce(F.sum(F.when(of("outliers"), lost)), F.lit(0)).alias("outliers_removed"),
        F.count_if(of("fill_nulls") | of("auto_fill")).alias("nulls_filled"),
        F.count_if(of("convert_types")).alias("type_conversions"),
        F.count_if(of("empty_columns")).alias("columns_dropped"),
    )
