"""Column roles: numeric, categorical, datetime, boolean, other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.frames import as_double, chunks, col, is_numeric, is_text, local_table


def dtype_role(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    if is_text(dtype):
        return "categorical"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def columns_of(df: DataFrame, role: str) -> list[str]:
    return [f.name for f in df.schema.fields if dtype_role(f.dataType) == role]


def varying_numeric(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Numeric columns with more than one distinct value (min < max), in one pass."""
    cols = columns_of(df, "numeric") if cols is None else cols
    keep = []
    for part in chunks(cols, 40):
        row = df.agg(*[
            (F.min(as_double(df, c)) < F.max(as_double(df, c))).alias(f"v{i}") for i, c in enumerate(part)
        ]).first()
        keep += [c for i, c in enumerate(part) if row[i]]
    return keep


def level_counts(df: DataFrame, cols: list[str], limit: int) -> dict[str, int | None]:
    """Exact distinct counts of columns with at most `limit` levels; None above it.

    A sketch pass rules out wide columns without a shuffle; only columns that
    may be within the limit are counted exactly.
    """
    out: dict[str, int | None] = {c: None for c in cols}
    near = []
    for part in chunks(cols, 50):
        row = df.agg(*[F.approx_count_distinct(col(c), 0.02).alias(f"d{i}") for i, c in enumerate(part)]).first()
        near += [c for i, c in enumerate(part) if row[i] <= 2 * limit + 20]
    for part in chunks(near, 8):
        row = df.agg(*[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(part)]).first()
        out.update({c: row[i] for i, c in enumerate(part) if row[i] <= limit})
    return out


@dataclass
class Roles:
    numeric: list[str]
    categorical: list[str]
    levels: dict

    @property
    def classification(self) -> str:
        total = len(self.numeric) + len(self.categorical)
        if total == 0:
            raise ValueError("No analyzable columns found (all constant or high-cardinality).")
        ratio = len(self.numeric) / total
        return "mostly numeric" if ratio > 0.7 else "mostly categorical" if ratio < 0.3 else "mixed"


def analysis_roles(df: DataFrame, max_levels: int = 50, min_levels: int = 0,
                   numeric: list[str] | None = None) -> Roles:
    """Numeric columns that vary and text columns with min..max distinct values."""
    levels = level_counts(df, columns_of(df, "categorical"), max_levels)
    categorical = [c for c, n in levels.items() if n is not None and n >= min_levels]
    numeric = varying_numeric(df) if numeric is None else numeric
    return Roles(numeric, categorical, {c: levels[c] for c in categorical})


def role_table(df: DataFrame, max_levels: int = 50, min_levels: int = 0) -> DataFrame:
    """(position, name, dtype, role, used): which columns take part in an analysis."""
    roles = analysis_roles(df, max_levels, min_levels)
    used = {*roles.numeric, *roles.categorical}
    rows = [
        (i, f.name, f.dataType.simpleString(), dtype_role(f.dataType), f.name in used)
        for i, f in enumerate(df.schema.fields)
    ]
    return local_table(df.sparkSession, rows, "position int, name string, dtype string, role string, used boolean")


def classify_data(df: DataFrame, max_levels: int = 50) -> DataFrame:
    """One row: numeric and categorical column counts, numeric share, label."""
    roles = analysis_roles(df, max_levels)
    total = len(roles.numeric) + len(roles.categorical)
    label = roles.classification
    return local_table(
            df.sparkSession, [(len(roles.numeric), len(roles.categorical), len(roles.numeric) / total, label)],
        "numeric_columns int, categorical_columns int, numeric_ratio double, classification string",
    )
