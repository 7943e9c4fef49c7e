"""Small helpers of the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.frames import col, cut, scratch_dir

__all__ = ["col", "cut", "scratch_dir", "fresh", "hash_pair", "blocks_for", "lower_ascii", "saved_path", "on_workers", "ASCII_UPPER", "ASCII_LOWER"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def saved_path(spark: SparkSession, tag: str) -> str:
    """A new path in the cluster's shared folder."""
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def hash_pair(*parts) -> tuple[Column, Column]:
    """128 bits of hash as two longs; 64 bits alone would collide on very large corpora."""
    return F.xxhash64(*parts), F.xxhash64(F.lit(0x5EED), *parts)


def blocks_for(rows: int, size: int) -> int:
    """How many blocks of about `size` rows hold `rows` rows."""
    return max(1, -(-rows // size))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; clusters need it installed there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
