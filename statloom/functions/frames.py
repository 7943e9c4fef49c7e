"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Groups or tables up to this many rows may be handled whole inside one task
# (a sort, an exact percentile map).  Larger ones always take a split path.
TASK_ROWS = 1_000_000

# A result table kept on the driver, or broadcast, may have at most this many rows.
PIN_ROWS = 200_000


def q(name: str) -> str:
    """Column reference that survives dots and blanks in the name."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double with NaN read as null."""
    dtype = df.schema[name].dataType
    c = col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    return c.cast("double")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null, type unchanged."""
    c = col(name)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c


def div(num: Column, den: Column) -> Column:
    """Division that yields null for a zero denominator in ANSI mode too."""
    return F.when(den != 0, num / F.when(den != 0, den))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def chunks(items, size: int):
    items = list(items)
    return [items[i : i + size] for i in range(0, len(items), size)]


def unpivot_numeric(df: DataFrame, cols, keep=(), name="variable", value="value") -> DataFrame:
    """Long form (keep..., variable, value) of numeric columns, nulls removed."""
    entries = [F.struct(F.lit(c).alias(name), as_double(df, c).alias(value)) for c in cols]
    return df.select(*keep, F.inline(F.array(*entries))).where(F.col(value).isNotNull())


def unpivot_text(df: DataFrame, cols, keep=(), name="variable", value="value") -> DataFrame:
    entries = [F.struct(F.lit(c).alias(name), col(c).cast("string").alias(value)) for c in cols]
    return df.select(*keep, F.inline(F.array(*entries))).where(F.col(value).isNotNull())


ARROW_TYPES = {
    "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(),
    "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
}


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small driver-side table as a local relation (known size, no Python job)."""
    names, types = zip(*(field.split() for field in ddl.split(", ")))
    columns = [pa.array([r[i] for r in rows], ARROW_TYPES[t], from_pandas=False) for i, t in enumerate(types)]
    return spark.createDataFrame(pa.table(columns, names=list(names)), ddl)


def pin(df: DataFrame) -> DataFrame:
    """Compute a result table once: a small one becomes a local relation, a larger one a written table."""
    table = df.limit(PIN_ROWS + 1).toArrow()
    if table.num_rows > PIN_ROWS:
        return cut(df, "result")
    return df.sparkSession.createDataFrame(table, df.schema)


def broadcast_if_small(table: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast if `rows` (a pinned table that bounds this one; itself by default) is small enough."""
    bound = table if rows is None else rows
    return F.broadcast(table) if bound.limit(PIN_ROWS + 1).count() <= PIN_ROWS else table


def settle(df: DataFrame) -> DataFrame:
    """Pin a per-group table when it is small enough, else leave it to Spark.

    Joins against a settled table know its size, so rows need not be shuffled.
    """
    table = df.limit(PIN_ROWS + 1).toArrow()
    return df if table.num_rows > PIN_ROWS else df.sparkSession.createDataFrame(table, df.schema)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as the session names it.

    Only a local session without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder of the cluster")
    folder = tempfile.mkdtemp(prefix="statloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write the frame to the shared scratch folder and read it back.

    One pass, columnar, and safe against lost executors; later passes read only
    the columns they need.  `options` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows a range partition should hold; more partitions than the session's
# shuffle setting are asked for only when it would be exceeded.
RANGE_ROWS = 5_000_000


def lay_out(df: DataFrame, order: list, rows: int) -> DataFrame:
    """Range-partition on the whole order key and sort each partition."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = -(-rows // RANGE_ROWS)
    laid = df.repartitionByRange(need, *order) if need > usual else df.repartitionByRange(*order)
    return laid.sortWithinPartitions(*order)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return local_table(spark, [], schema)
