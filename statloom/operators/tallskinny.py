"""QR factors of matrices with very many rows and a few columns, without the Gram matrix, which squares the condition.

Every task reduces its rows to one triangular factor, batch by batch; factors are stacked and factored again in a tree
until a few are left for the driver.  A factor has (columns + 1)^2 numbers whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.frames import as_double, cut

#: Factors that one task of the tree, or the driver, stacks.
FAN_IN = 64


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor, with as many rows as columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def _of_rows(centres: np.ndarray):
    width = len(centres) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((width, width)), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns])
            x = x[~np.isnan(x).any(axis=1)]
            if len(x):
                held = _factor(np.vstack([held, np.column_stack([np.ones(len(x)), x - centres])]))
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["n", "factor"])

    return run


def _stacked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((width, width)), 0
        for batch in batches:
            for size, factor in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = _factor(np.vstack([held, np.frombuffer(factor.as_buffer()).reshape(width, width)]))
                n += size
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["n", "factor"])

    return run


def triangular_factor(df: DataFrame, cols: list[str], centres: list[float]) -> tuple[int, np.ndarray]:
    """Complete rows, and the factor R of the matrix [1, columns - centres] of these rows."""
    width = len(cols) + 1
    schema = "n long, factor binary"
    rows = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    factors = cut(rows.mapInArrow(_of_rows(np.array(centres, dtype=float)), schema), "qr-factors")
    left = factors.count()
    while left > FAN_IN:
        tasks = -(-left // FAN_IN)
        factors = cut(factors.repartition(tasks, F.xxhash64("factor")).mapInArrow(_stacked(width), schema), "qr-factors")
        left = factors.count()
    table = factors.toArrow()
    n = sum(table.column("n").to_pylist())
    parts = [np.frombuffer(f).reshape(width, width) for f in table.column("factor").to_pylist()]
    return n, _factor(np.vstack([np.zeros((width, width)), *parts]))
