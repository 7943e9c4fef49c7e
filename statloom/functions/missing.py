"""Missing-value normalisation: text tokens and NaN become null, once, at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.frames import col

# Texts that a CSV reader takes as missing by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def normalise_missing(df: DataFrame, tokens=NA_TOKENS, strip: bool = False) -> DataFrame:
    """Null out NA tokens in string columns and NaN in floating columns."""
    changed = {}
    for field in df.schema.fields:
        c = col(field.name)
        if isinstance(field.dataType, T.StringType):
            probe = F.trim(c) if strip else c
            changed[field.name] = F.when(~probe.isin(list(tokens)), c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changed[field.name] = F.when(~F.isnan(c), c)
    return df.withColumns(changed) if changed else df


# A number as a CSV reader accepts it; the JVM parser alone would also take "5d".
NUMBER_TEXT = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def number_or_null(c):
    """Text to double; anything that is not a plain number becomes null."""
    return F.when(c.rlike(NUMBER_TEXT), F.trim(c)).try_cast("double")
