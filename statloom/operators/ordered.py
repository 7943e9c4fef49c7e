"""Autocorrelation sums over a globally ordered column, without a global window.

Rows are range-partitioned on the whole order key (ties broken by the value),
each task streams its sorted rows once and returns lag products plus its first
and last few values, and the seams between partitions are added on the driver
from those few values.  The result does not depend on where the partitions split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from statloom.functions.frames import col, lay_out

SCHEMA = "part int, n long, sums array<double>, head array<double>, tail array<double>"


@dataclass
class LagSums:
    n: int
    products: np.ndarray  # products[k] = sum of x_t * x_(t+k)
    first: float
    last: float

    @property
    def acf(self) -> np.ndarray:
        return self.products / self.products[0] if self.products[0] > 0 else np.full_like(self.products, np.nan)

    @property
    def squared_steps(self) -> float:
        """Sum of squared differences of neighbours."""
        return 2 * self.products[0] - self.first**2 - self.last**2 - 2 * self.products[1]


def _scanner(lags: int):
    def scan(batches):
        sums = np.zeros(lags + 1)
        head, carry, n = np.empty(0), np.empty(0), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(x):
                continue
            joined = np.concatenate([carry, x])
            start = len(carry)
            for k in range(lags + 1):
                lo = max(start, k)
                if lo < len(joined):
                    sums[k] += joined[lo:] @ joined[lo - k : len(joined) - k]
            if len(head) < lags:
                head = np.concatenate([head, x])[:lags]
            carry = joined[-lags:]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pylist(
                [{"part": TaskContext.get().partitionId(), "n": n, "sums": sums.tolist(),
                  "head": head.tolist(), "tail": carry.tolist()}],
                schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64())),
                                  ("head", pa.list_(pa.float64())), ("tail", pa.list_(pa.float64()))]),
            )

    return scan


def lag_sums(df: DataFrame, value: Column, order_by: list[str], lags: int, rows: int = 0) -> LagSums:
    """Lag products 0..lags of `value` in the given row order (lags >= 1).

    `rows`, when known, sizes the partitions of large frames.
    """
    if not order_by:
        raise ValueError("row order matters here: order_by must name the ordering columns")
    keys = [col(c).alias(f"_o{i}") for i, c in enumerate(order_by)]
    values = df.select(value.cast("double").alias("x"), *keys).where("x is not null")
    order = [f"_o{i}" for i in range(len(order_by))] + ["x"]
    laid = lay_out(values, order, rows).select("x")
    parts = sorted(laid.mapInArrow(_scanner(lags), SCHEMA).collect(), key=lambda r: r["part"])
    total = np.zeros(lags + 1)
    before = np.empty(0)
    for r in parts:
        total += np.array(r["sums"])
        head = np.array(r["head"])
        for k in range(1, lags + 1):
            for j in range(min(k, len(head))):
                back = k - j  # x_t is this many places before the seam
                if back <= len(before):
                    total[k] += before[-back] * head[j]
        before = np.concatenate([before, np.array(r["tail"])])[-lags:]
    n = sum(r["n"] for r in parts)
    if not n:
        return LagSums(0, total, np.nan, np.nan)
    return LagSums(n, total, parts[0]["head"][0], parts[-1]["tail"][-1])


def partial_autocorrelation(acf: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion on autocorrelations, lag 0 first."""
    out = np.ones(len(acf))
    phi = np.empty(0)
    for k in range(1, len(acf)):
        den = 1.0 - (phi @ acf[1:k] if k > 1 else 0.0)
        last = (acf[k] - (phi @ acf[k - 1 : 0 : -1] if k > 1 else 0.0)) / den if den > 0 else np.nan
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out
