"""Schema profile: counts, samples, duplicates, describe, top values, quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.frames import (
    chunks, col, div, empty, is_text, local_table, present, union_all, unpivot_text,
)
from statloom.functions.missing import number_or_null
from statloom.operators.describe import moments
from statloom.operators.pii import pii_map, placeholder
from statloom.operators.ranks import quantiles
from statloom.operators.roles import columns_of, dtype_role

def _value_key(f: T.StructField, c: Column) -> dict[str, Column]:
    """A value as one of three typed columns, so different columns fit one grouping key."""
    whole = text = real = None
    if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        whole = c.cast("long")
    elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        real = c.cast("double")
    elif f.dataType.typeName() in ("map", "variant", "struct", "array"):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return {"whole": F.lit(None).cast("long") if whole is None else whole,
            "real": F.lit(None).cast("double") if real is None else real,
            "text": F.lit(None).cast("string") if text is None else text}


def column_profile(df: DataFrame, pii: dict[str, str] | None = None, approx: bool = False) -> DataFrame:
    """(position, name, dtype, role, null_count, unique_count, null_rate, pii_type).

    One scan for all columns: every value becomes a (column, value) key and
    equal keys collapse within each task before the shuffle.  approx=True
    counts distinct values by sketch, without that shuffle.
    """
    pii = pii_map(df) if pii is None else pii
    fields = list(enumerate(df.schema.fields))
    meta = local_table(
        df.sparkSession,
        [(i, f.name, f.dataType.simpleString(), dtype_role(f.dataType), pii.get(f.name)) for i, f in fields],
        "position int, name string, dtype string, role string, pii_type string",
    )
    entries = [F.struct(F.lit(i).alias("position"),
                        *[v.alias(k) for k, v in _value_key(f, present(df, f.name)).items()]) for i, f in fields]
    keys = ["position", "whole", "real", "text"]
    long = df.select(F.inline(F.array(*entries)))
    missing = F.col("whole").isNull() & F.col("real").isNull() & F.col("text").isNull()
    if approx:
        value = F.when(~missing, F.xxhash64("whole", "real", "text"))
        sums = long.groupBy("position").agg(
            F.count(F.lit(1)).alias("total"), F.count_if(missing).alias("null_count"),
            F.approx_count_distinct(value, 0.02).alias("unique_count"))
    else:
        sums = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).groupBy("position").agg(
            F.sum("n").alias("total"), F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("null_count"),
            F.count_if(~missing).alias("unique_count"))
    zero = F.lit(0).cast("long")
    return meta.join(sums, "position", "left").select(
        "position", "name", "dtype", "role", F.coalesce("null_count", zero).alias("null_count"),
        F.coalesce("unique_count", zero).alias("unique_count"),
        div(F.col("null_count"), F.col("total").cast("double")).alias("null_rate"), "pii_type",
    )


def sample_values(df: DataFrame, order_by: list[str], k: int = 5, pii: dict[str, str] | None = None) -> DataFrame:
    """(name, sample_no, value): first k non-null values per column; placeholders for PII.

    Each column is a top-k over its own values: a partial heap per task.  Rows
    that `order_by` leaves tied are taken by ascending value.
    """
    pii = pii_map(df) if pii is None else pii
    w = Window.orderBy(*[F.col(f"_o{i}") for i in range(len(order_by))], F.col("value"))  # over k rows
    parts = []
    for name in df.columns:
        c = present(df, name)
        order = [col(o).alias(f"_o{i}") for i, o in enumerate(order_by)]
        kind = pii.get(name)
        first = (
            df.select(*order, c.cast("string").alias("value")).where("value is not null")
            .orderBy(*[f"_o{i}" for i in range(len(order_by))], "value").limit(min(k, 3) if kind else k)
        )
        value = F.lit(placeholder(kind)) if kind else F.col("value")
        parts.append(first.select(
            F.lit(name).alias("name"), F.row_number().over(w).alias("sample_no"), value.alias("value")
        ))
    return union_all(parts)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, distinct_rows, duplicate_rows, from one hash aggregate."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def table_summary(df: DataFrame, pii: dict[str, str] | None = None) -> DataFrame:
    """One row: rows, columns, duplicate rows, PII columns (name:type, sorted)."""
    pii = pii_map(df) if pii is None else pii
    listed = ", ".join(f"{c}:{pii[c]}" for c in sorted(pii))
    return duplicate_rows(df).select(
        "row_count", F.lit(len(df.columns)).alias("columns_count"), "duplicate_rows",
        F.lit(len(pii)).alias("pii_columns"), F.lit(listed).alias("pii_detected"),
    )


def describe(df: DataFrame, pii: dict[str, str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column; PII columns left out."""
    pii = pii_map(df) if pii is None else pii
    cols = [c for c in columns_of(df, "numeric") if c not in pii]
    spark = df.sparkSession
    if not cols:
        return empty(spark, "name string, count long, mean double, std double, min double, "
                            "p25 double, p50 double, p75 double, max double")
    quartiles = quantiles(df, cols, [0.25, 0.5, 0.75])
    table = local_table(spark, [(c, *quartiles[c]) for c in cols], "variable string, p25 double, p50 double, p75 double")
    return table.join(moments(df, cols), "variable", "left").select(
        F.col("variable").alias("name"), F.coalesce("n", F.lit(0).cast("long")).alias("count"), "mean", F.sqrt("var").alias("std"), "min",
        "p25", "p50", "p75", "max",
    )


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, value, n) over text columns; pre-aggregated before the shuffle."""
    return unpivot_text(df, cols).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


def top_categories(df: DataFrame, cols: list[str] | None = None, k: int = 5,
                   pii: dict[str, str] | None = None) -> DataFrame:
    """(name, position, value, n): k most frequent values per text column.

    Ties go to the smaller value.  A PII column yields one redacted row.
    """
    pii = pii_map(df) if pii is None else pii
    cols = columns_of(df, "categorical") if cols is None else cols
    open_cols = [c for c in cols if c not in pii]
    schema = "name string, position int, value string, n long"
    hidden = local_table(
            df.sparkSession, [(c, 1, f"[PII REDACTED - {pii[c]}]", None) for c in cols if c in pii], schema
    )
    if not open_cols:
        return hidden
    w = Window.partitionBy("variable").orderBy(F.desc("n"), "value")
    top = value_counts(df, open_cols).withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
    return top.select(F.col("variable").alias("name"), "position", "value", "n").unionByName(hidden)


def quality_issues(df: DataFrame, null_share: float = 0.3) -> DataFrame:
    """(name, null_rate, many_nulls, mixed_types, float_ids, text_dates), one row per column.

    mixed_types: a text column where some but not all values are numbers.
    float_ids: a floating column that holds only whole numbers.
    text_dates: a text column where every value reads as a timestamp and none is a number.
    """
    parts = []
    for part in chunks(list(df.schema.fields), 10):
        aggs, rows = [F.count(F.lit(1)).cast("double").alias("total")], []
        for i, f in enumerate(part):
            c = present(df, f.name)
            aggs.append(F.count(c).alias(f"c{i}"))
            mixed = whole = dated = F.lit(False)
            if is_text(f.dataType):
                stamped = F.when(c.isNotNull(), F.try_to_timestamp(c).isNotNull() & number_or_null(c).isNull())
                present_num = F.when(c.isNotNull(), number_or_null(c).isNotNull())
                aggs += [F.avg(present_num.cast("double")).alias(f"num{i}"),
                         F.avg(stamped.cast("double")).alias(f"ts{i}")]
                mixed = (F.col(f"num{i}") > 0) & (F.col(f"num{i}") < 1)
                dated = F.col(f"ts{i}") == 1
            elif f.dataType.typeName() in ("double", "float"):
                aggs.append(F.avg((c == F.floor(c)).cast("double")).alias(f"int{i}"))
                whole = F.col(f"int{i}") == 1
            null_rate = div(F.col("total") - F.col(f"c{i}"), F.col("total"))
            rows.append(F.struct(
                F.lit(f.name).alias("name"), null_rate.alias("null_rate"),
                F.coalesce(null_rate > null_share, F.lit(False)).alias("many_nulls"),
                F.coalesce(mixed, F.lit(False)).alias("mixed_types"),
                F.coalesce(whole, F.lit(False)).alias("float_ids"),
                F.coalesce(dated, F.lit(False)).alias("text_dates"),
            ))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    return union_all(parts)
