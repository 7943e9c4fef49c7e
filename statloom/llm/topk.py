"""Exact top-k inner-product search by distributed histogram selection.

Every query is scored against every candidate.  The k-th score of each query is
found without sorting: each task counts its scores in the bins of the query's
current interval, the counts are added up over all tasks, the bin that holds the
k-th score becomes the next interval, and so on until the interval is a single
integer.  A last pass keeps the scores at or above that value and orders ties by id.

The work is laid out as cells (candidate block x query block) of bounded size, so
memory per task does not depend on the number of rows, and one cell does far more
arithmetic than the bytes it receives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import blocks_for, col, cut, on_workers

RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, q): floor(scale * x) per component; rows that take no part are gone."""
    v = col(vec_col).cast("array<double>")
    return (
        df.select(col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .groupBy("vec_id").agg(F.min(F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))).alias("q"))
    )


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: floating-point BLAS where it is exact, 64-bit integers elsewhere."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _scored(left: pd.DataFrame, right: pd.DataFrame, k: int):
    """For blocks of queries: their rows, scores, candidate ids and each query's own k-th score."""
    if not len(left) or not len(right):
        return
    width = max(max(map(len, left["q"])), max(map(len, right["query"])), 1)
    left = left.sort_values("vec_id")
    ids, cands = left["vec_id"].to_numpy(), _matrix(left["q"].tolist(), width)
    lowest = np.iinfo(np.int64).min
    for at in range(0, len(right), 256):
        part = right.iloc[at : at + 256]
        scores = _products(_matrix(part["query"].tolist(), width), cands)
        own = np.searchsorted(ids, part["query_id"].to_numpy())
        hit = (own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == part["query_id"].to_numpy())
        alive = np.ones(scores.shape, dtype=bool)
        alive[np.flatnonzero(hit), own[hit]] = False
        scores[~alive] = lowest
        if scores.shape[1] > k:
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        else:
            kth = np.full(len(part), lowest)
        yield part, scores, alive, ids, kth


def _count_bins(k: int, bins: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, scores, alive, _, kth in _scored(left, right, k):
            low = np.maximum(part["lo"].to_numpy(), kth)  # k scores of this cell alone lie at or above its k-th
            r, c = np.nonzero(alive & (scores >= low[:, None]) & (scores <= part["hi"].to_numpy()[:, None]))
            lo, step = part["lo"].to_numpy()[r], part["step"].to_numpy()[r]
            key, n = np.unique(r * bins + (scores[r, c] - lo) // step, return_counts=True)
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[key // bins], "bin": key % bins, "n": n}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "bin": [], "n": []}, dtype="int64")

    return run


def _take(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, scores, alive, ids, kth in _scored(left, right, k):
            floor = np.maximum(part["lo"].to_numpy(), kth)
            for i, qid in enumerate(part["query_id"].to_numpy()):
                c = np.flatnonzero(alive[i] & (scores[i] >= floor[i]))
                c = c[np.lexsort((ids[c], -scores[i, c]))[:k]]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[c], "score": scores[i, c]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def exact_top_k(
    df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, bins: int = 512, id_col: str = "vec_id",
    vec_col: str = "embedding", candidate_block: int = 4096, query_block: int = 4096,
) -> DataFrame:
    """The k best candidates of every row whose id is divisible by `every`, by integer inner product.

    Returns (query_id, rank, vec_id, score), ties to the smaller id; a query with fewer than k candidates
    gets all of them.  Defined cases: rows with a null id, a null vector, or a null or non-finite component
    take no part; rows that repeat an id count as one row, with the smallest of its vectors; vectors of
    different length meet as if the shorter one ended in zeros; other columns are ignored, whatever their
    names; an empty table gives an empty result.  Scores are exact while they fit a long.
    """
    spark = df.sparkSession
    on_workers(spark)
    base = cut(quantised(df, id_col, vec_col, scale), "topk-vectors")
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, n_queries, norm2 = base.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(square)).first()
    k_eff = min(k, n - 1)
    if not n_queries or k_eff < 1:
        return spark.createDataFrame([], RESULT)
    cand_blocks, query_blocks = blocks_for(n, candidate_block), blocks_for(n_queries, query_block)
    cells = ["cand_block", "query_block"]
    left = base.withColumn("cand_block", F.pmod(F.xxhash64("vec_id"), F.lit(cand_blocks))).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = base.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), F.col("q").alias("query"),
        F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"))

    def to_cells(state: DataFrame) -> DataFrame:
        return queries.join(state, "query_id").withColumn(
            "cand_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cand_blocks - 1).cast("long"))))

    bound = min(int(norm2 * 1.0001) + 1, 2**62)  # no inner product is larger than the largest squared norm
    width = 2 * bound + 1
    state = queries.select("query_id", F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"),
                           F.lit(0).cast("long").alias("above"))
    while width > 1:
        step = -(-width // bins)
        state = state.withColumn("step", F.lit(step).cast("long"))
        counts = left.groupBy(*cells).cogroup(to_cells(state).groupBy(*cells)).applyInPandas(
            _count_bins(k_eff, bins), "query_id long, bin long, n long")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        counts = counts.withColumn("through", F.sum("n").over(down))
        found = counts.join(state, "query_id").where(
            (F.col("above") + F.col("through") >= k_eff) & (F.col("above") + F.col("through") - F.col("n") < k_eff))
        lo = F.col("lo") + F.col("bin") * F.col("step")
        state = cut(found.select(
            "query_id", lo.alias("lo"), F.least(F.col("hi"), lo + F.col("step") - 1).alias("hi"),
            (F.col("above") + F.col("through") - F.col("n")).alias("above")), "topk-state")
        width = step
    kept = left.groupBy(*cells).cogroup(to_cells(state).groupBy(*cells)).applyInPandas(
        _take(k_eff), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_eff).select(
        "query_id", "rank", "vec_id", "score")
