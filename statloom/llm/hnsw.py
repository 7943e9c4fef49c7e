"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Distinct vectors are dealt to shards of bounded size by a hash.  Each shard builds its graph in one task and
stores it as flat arrays: vectors, and per layer a table of neighbour places.  Blocks of queries meet the shards,
walk the graphs, and the shard results are merged per query.  Vectors get one more component that makes all of
them equally long, so that the largest inner product is the nearest point; queries have zero there.

Building and searching advance many points in step: a batch walks the graph with one array operation per hop.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import blocks_for, col, cut, on_workers

RESULT = "query_id long, rank int, vec_id long, score double"
INDEX = "shard long, rows int, width int, vectors binary, members binary, layers array<struct<size:int, degree:int, neighbours:binary>>"


def beam(vectors: np.ndarray, table: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef best places found for each query, best first, and their products; -1 and -inf where there are fewer.

    All queries take a step together: each expands its best unexpanded place.
    """
    n, degree = len(queries), table.shape[1]
    places = np.full((n, ef + degree), -1, dtype=np.int64)
    score = np.full((n, ef + degree), -np.inf, dtype=np.float32)
    spent = np.zeros((n, ef + degree), dtype=bool)
    seen = np.zeros((n, len(table) + 1), dtype=bool)
    rows = np.arange(n)
    k = entry.shape[1]
    places[:, :k] = entry
    score[:, :k] = np.einsum("nd,nkd->nk", queries, vectors[entry])
    seen[rows[:, None], entry] = True
    active = rows
    while len(active):
        s = np.where(spent[active, :ef] | (places[active, :ef] < 0), -np.inf, score[active, :ef])
        best = s.argmax(axis=1)
        going = s[np.arange(len(active)), best] > -np.inf
        active, best = active[going], best[going]
        if not len(active):
            break
        spent[active, best] = True
        near = table[places[active, best]]
        known = (near < 0) | seen[active[:, None], near]
        seen[active[:, None], np.where(near < 0, len(table), near)] = True
        products = np.einsum("nd,nkd->nk", queries[active], vectors[near])
        products[known] = -np.inf
        places[active, ef:], score[active, ef:], spent[active, ef:] = np.where(known, -1, near), products, False
        order = np.argsort(-score[active], axis=1, kind="stable")
        for a in (places, score, spent):
            a[active] = np.take_along_axis(a[active], order, axis=1)
    order = np.argsort(-score[:, :ef], axis=1, kind="stable")
    return np.take_along_axis(places[:, :ef], order, axis=1), np.take_along_axis(score[:, :ef], order, axis=1)


def diverse(vectors: np.ndarray, places: np.ndarray, score: np.ndarray, degree: int) -> np.ndarray:
    """Pick up to `degree` of each row's candidates (best first): those nearer to the point than to any picked
    one come first, the others fill what is left."""
    n, m = places.shape
    among = np.einsum("nid,njd->nij", vectors[places], vectors[places])
    closest = np.full((n, m), -np.inf, dtype=np.float32)  # product with the nearest picked candidate
    picked = np.zeros((n, m), dtype=bool)
    count = np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    for k in range(m):
        take = (places[:, k] >= 0) & (score[:, k] > closest[:, k]) & (count < degree)
        picked[:, k] = take
        count += take
        closest[take] = np.maximum(closest[take], among[take, :, k])
    rank = np.where(places < 0, 3 * m, np.where(picked, 0, m) + np.arange(m))
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.where(np.take_along_axis(rank, order, axis=1) < 2 * m, np.take_along_axis(places, order, axis=1), -1)
    return out if out.shape[1] == degree else np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


def build(vectors: np.ndarray, degree: int = 16, ef: int = 64, batch: int = 256, seed: int = 7) -> list[np.ndarray]:
    """Neighbour tables from the top layer down; layer l holds the first rows of `vectors` (see order_by_level)."""
    n = len(vectors)
    sizes = layer_sizes(n, degree)
    tables = [np.full((size, degree if depth < len(sizes) - 1 else 2 * degree), -1, dtype=np.int32) for depth, size in enumerate(sizes)]
    at = 1
    while at < n:
        to = min(n, at + max(1, min(batch, at)))
        for depth, size in enumerate(sizes):  # a batch lies within one level
            if at < size:
                to = min(to, size)
                break
        fresh = np.arange(at, to)
        entry = np.zeros((len(fresh), 1), dtype=np.int64)
        for table in tables:
            if at >= len(table):
                entry = beam(vectors, table, vectors[fresh], entry, 1)[0]
                continue
            found, score = beam(vectors, table, vectors[fresh], entry, ef)
            entry = found[:, : max(1, min(8, ef))]
            entry = np.where(entry < 0, entry[:, :1], entry)
            mates = vectors[fresh] @ vectors[fresh].T  # points of one batch do not find each other in the graph
            np.fill_diagonal(mates, -np.inf)
            keep = min(16, len(fresh) - 1)
            if keep > 0:
                near = np.argsort(-mates, axis=1, kind="stable")[:, :keep]
                found = np.concatenate([found, fresh[near]], axis=1)
                score = np.concatenate([score, np.take_along_axis(mates, near, axis=1)], axis=1)
                order = np.argsort(-score, axis=1, kind="stable")
                found, score = np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)
            found, score = found[:, : ef], score[:, : ef]
            table[fresh] = diverse(vectors, found, score, table.shape[1] if len(table) == n else degree)[:, : table.shape[1]]
            _link_back(vectors, table, fresh)
        at = to
    return tables


def _link_back(vectors: np.ndarray, table: np.ndarray, fresh: np.ndarray) -> None:
    """Let the neighbours of new points know them; full lists are chosen anew."""
    degree = table.shape[1]
    source = np.repeat(fresh, degree)
    target = table[fresh].reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    known = (table[target] == source[:, None]).any(axis=1)
    source, target = source[~known], target[~known]
    if not len(target):
        return
    order = np.lexsort((-np.einsum("nd,nd->n", vectors[source], vectors[target]), target))
    source, target = source[order], target[order]
    hubs, first, count = np.unique(target, return_index=True, return_counts=True)
    width = min(int(count.max()), degree)
    place = np.arange(len(target)) - np.repeat(first, count)
    more = np.full((len(hubs), width), -1, dtype=np.int64)
    small = place < width  # the best newcomers of each point; a list holds no more of them anyway
    more[np.repeat(np.arange(len(hubs)), count)[small], place[small]] = source[small]
    both = np.concatenate([table[hubs].astype(np.int64), more], axis=1)
    for a in range(0, len(hubs), 512):
        part, hub = both[a : a + 512], hubs[a : a + 512]
        score = np.einsum("nd,nkd->nk", vectors[hub], vectors[part])
        score[part < 0] = -np.inf
        rank = np.argsort(-score, axis=1, kind="stable")
        part, score = np.take_along_axis(part, rank, axis=1), np.take_along_axis(score, rank, axis=1)
        full = (part >= 0).sum(axis=1) > degree
        chosen = part[:, :degree].copy()
        if full.any():
            chosen[full] = diverse(vectors, part[full], score[full], degree)
        table[hub] = chosen


def layer_sizes(n: int, degree: int) -> list[int]:
    """Sizes of the layers from the top down: each holds one point in `degree` of the next."""
    sizes = [n]
    while sizes[0] > degree:
        sizes.insert(0, -(-sizes[0] // degree))
    return sizes


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more component that makes all vectors as long as the longest."""
    norm = np.einsum("nd,nd->n", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(norm.max(initial=0.0) - norm, 0.0))[:, None]], axis=1).astype(np.float32)


def _padded(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.float64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _index(degree: int, ef: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")  # a hash: which points reach the upper layers is a fair draw
        width = max(map(len, part["v"]))
        vectors = _padded(part["v"].tolist(), width)
        scaled = lifted(vectors / max(np.abs(vectors).max(), 1e-300))
        layers = [{"size": len(t), "degree": t.shape[1], "neighbours": t.tobytes()} for t in build(scaled, degree, ef)]
        counts = np.array([len(x) for x in part["ids"]], dtype="<i8")
        members = np.concatenate([[len(counts)], counts, np.concatenate(part["ids"].tolist())]).astype("<i8")
        return pd.DataFrame({"shard": [key[0]], "rows": [len(part)], "width": [width], "vectors": [vectors.tobytes()],
                             "members": [members.tobytes()], "layers": [layers]})

    return run


def _search(k: int, ef: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(left) or not len(right):
            return none
        shard = left.iloc[0]
        width = max(int(shard["width"]), max(map(len, right["v"])))
        vectors = np.zeros((int(shard["rows"]), width))
        vectors[:, : int(shard["width"])] = np.frombuffer(shard["vectors"], dtype=np.float64).reshape(int(shard["rows"]), -1)
        scaled = lifted(vectors / max(np.abs(vectors).max(), 1e-300))
        tables = [np.frombuffer(x["neighbours"], dtype=np.int32).reshape(x["size"], x["degree"]) for x in shard["layers"]]
        members = np.frombuffer(shard["members"], dtype="<i8")
        count = members[1 : members[0] + 1]
        ids, first = members[members[0] + 1 :], np.cumsum(count) - count
        out = []
        for at in range(0, len(right), 256):
            part = right.iloc[at : at + 256]
            exact = _padded(part["v"].tolist(), width)
            q = np.concatenate([exact / np.maximum(np.abs(exact).max(axis=1, keepdims=True), 1e-300), np.zeros((len(part), 1))], axis=1).astype(np.float32)
            entry = np.zeros((len(part), 1), dtype=np.int64)
            for table in tables[:-1]:
                entry = beam(scaled, table, q, entry, 4)[0]
                entry = np.where(entry < 0, entry[:, :1], entry)
            places, _ = beam(scaled, tables[-1], q, entry[:, :1], ef)
            for i, qid in enumerate(part["query_id"].to_numpy()):
                p = places[i][places[i] >= 0]
                score = np.repeat(vectors[p] @ exact[i], count[p])
                found = np.concatenate([ids[a : a + n] for a, n in zip(first[p], count[p])])
                own = found != qid
                score, found = score[own], found[own]
                best = np.lexsort((found, -score))[:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": found[best], "score": score[best]}))
        return pd.concat(out) if out else none

    return run


def nearest(
    df: DataFrame, k: int = 20, every: int = 20, shard_rows: int = 8192, query_block: int = 4096, degree: int = 16,
    ef_build: int = 64, ef_search: int = 128, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """The k nearest found, by largest inner product, of every row whose id is divisible by `every`.

    Returns (query_id, rank, vec_id, score), nearest first, ties to the smaller id; score is the inner product of
    the original vectors in double precision.  All rows are indexed.  Equal vectors are one point of the graph
    with the k + 1 smallest of their ids, which are all that an answer can hold.  Defined cases: rows with a null
    id, and vectors that are null, empty, zero, or hold a null or non-finite component take no part; rows that
    repeat an id count as one row with the smallest of its vectors; vectors of different length meet as if the
    shorter one ended in zeros; other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    on_workers(spark)
    v = col(vec_col).cast("array<double>")
    rows = df.select(col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(
        ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-vectors")
    smallest = Window.partitionBy("v").orderBy("vec_id")
    points = rows.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1).groupBy("v").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = cut(points, "ann-points")
    n, n_queries = points.count(), rows.where(F.col("vec_id") % every == 0).count()
    if not n or not n_queries:
        return spark.createDataFrame([], RESULT)
    shards, blocks = blocks_for(n, shard_rows), blocks_for(n_queries, query_block)
    dealt = points.withColumns({"place": F.xxhash64("v"), "shard": F.pmod(F.xxhash64(F.lit(3), "v"), F.lit(shards))})
    index = cut(dealt.groupBy("shard").applyInPandas(_index(degree, ef_build), INDEX), "ann-index")
    cells = ["shard", "block"]
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(_search(k, ef_search), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
