"""Pearson and Spearman correlation: matrices, tests, screens, strength labels."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.frames import (
    TASK_ROWS, as_double, chunks, col, div, empty, local_table, union_all,
)
from statloom.functions.special import t_pvalue
from statloom.operators.gappy import gappy_spearman, present_moments
from statloom.operators.gram import column_means, pair_sums
from statloom.operators.normality import LARGE_ROWS, MIN_ROWS, normality, omnibus
from statloom.operators.ranks import attach_ranks, non_null_counts
from statloom.operators.roles import varying_numeric

ALPHA = 0.05
# Larger aggregates compile to methods the JVM interprets.
PAIRS_PER_PASS = 6
# Pairs with gaps that are ranked one by one.
FEW_PAIRS = 3
PAIR_SCHEMA = "x string, y string, n long, r double"


def pair_aggregate(df: DataFrame, pairs: list[tuple[str, str]], names=None) -> DataFrame:
    """(x, y, n, r): pairwise-complete count and Pearson r.

    A few pairs are one plain aggregate.  More pairs take one scan of matrix
    sums; see `gram`.
    """
    if not pairs:
        return empty(df.sparkSession, PAIR_SCHEMA)
    names = names or {}
    if len(pairs) > 2 * PAIRS_PER_PASS:
        return _matrix_pairs(df, pairs, names)
    parts = []
    for part in chunks(pairs, PAIRS_PER_PASS):
        aggs, rows = [], []
        for i, (a, b) in enumerate(part):
            x, y = as_double(df, a), as_double(df, b)
            both = x.isNotNull() & y.isNotNull()
            aggs += [F.count_if(both).alias(f"n{i}"), safe_corr(F.when(both, x), F.when(both, y)).alias(f"r{i}")]
            rows.append(F.struct(
                F.lit(names.get(a, a)).alias("x"), F.lit(names.get(b, b)).alias("y"),
                F.col(f"n{i}").alias("n"), _clamped(F.col(f"r{i}")).alias("r"),
            ))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    return union_all(parts)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r of two columns that are null together; null when a side is constant.

    `corr` itself divides by zero on constants, which ANSI mode makes an error.
    """
    return div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _clamped(r: Column) -> Column:
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _matrix_pairs(df: DataFrame, pairs, names) -> DataFrame:
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    centres = column_means(df, cols)
    at = {c: k for k, c in enumerate(cols)}
    wanted = local_table(
            df.sparkSession, [(i, j, names.get(a, a), names.get(b, b), centres[i], centres[j])
         for a, b in pairs for i, j in [sorted((at[a], at[b]))]],
        "i int, j int, x string, y string, ci double, cj double",
    )
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    # spread below the rounding of the centre itself means a constant column
    varies = (vx > n * (F.col("ci") * 1e-13) ** 2) & (vy > n * (F.col("cj") * 1e-13) ** 2)
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)
    sums = pair_sums(df, cols, centres).where(n > 0)
    return wanted.join(sums, ["i", "j"], "left").select(
        "x", "y", F.coalesce(n, F.lit(0.0)).cast("long").alias("n"), _clamped(F.when(varies, r)).alias("r")
    )


def with_r_pvalue(table: DataFrame) -> DataFrame:
    n, r = F.col("n"), F.col("r")
    room = 1.0 - r * r
    t = F.when((n > 2) & (room > 0), r * F.sqrt((n - 2) / F.when(room > 0, room)))
    p = t_pvalue(F.col("_t"), (n - 2).cast("double"))
    return (
        table.withColumn("_t", t)
        .withColumn("p_value", F.when(r.isNotNull() & (n == 2), 1.0).when(room <= 0, 0.0).otherwise(p))
        .drop("_t")
    )


def pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x, y, n, r, p_value) over pairwise-complete rows."""
    return with_r_pvalue(pair_aggregate(df, pairs))


def spearman(df: DataFrame, pairs: list[tuple[str, str]], task_rows: int = TASK_ROWS,
             broadcast_ok: bool = True) -> DataFrame:
    """(x, y, n, r, p_value): Pearson on exact average ranks.

    Columns without nulls are ranked once and shared by their pairs.  A few pairs
    with nulls are ranked on their own complete rows one by one; more of them
    share one table of counts (see `gappy`), with equal results.
    """
    return with_r_pvalue(_rank_correlation(df, pairs, task_rows, broadcast_ok))


def _rank_correlation(df, pairs, task_rows, broadcast_ok, total=None, filled=None):
    if not pairs:
        return empty(df.sparkSession, PAIR_SCHEMA)
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    total = df.count() if total is None else total
    filled = non_null_counts(df, cols) if filled is None else filled
    whole = [p for p in pairs if filled[p[0]] == total and filled[p[1]] == total]
    parts = []
    if whole:
        used = [c for c in cols if any(c in p for p in whole)]
        parts.append(_ranked_pairs(df, used, whole, total, task_rows, broadcast_ok))
    rest = [p for p in pairs if p not in whole]
    if len(rest) > FEW_PAIRS:
        parts.append(gappy_spearman(df, rest, task_rows))
    elif rest:
        sizes = {(r["x"], r["y"]): r["n"] for r in _pair_sizes(df, rest).collect()}
        for a, b in rest:
            both = df.where(as_double(df, a).isNotNull() & as_double(df, b).isNotNull())
            parts.append(_ranked_pairs(both, [a, b], [(a, b)], sizes[(a, b)], task_rows, broadcast_ok))
    return union_all(parts)


def _pair_sizes(df, pairs):
    parts = []
    for part in chunks(pairs, 200):
        aggs = [F.count_if(as_double(df, a).isNotNull() & as_double(df, b).isNotNull()).alias(f"n{i}")
                for i, (a, b) in enumerate(part)]
        rows = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"n{i}").alias("n"))
                for i, (a, b) in enumerate(part)]
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    return union_all(parts)


def _ranked_pairs(df, used, pairs, rows, task_rows, broadcast_ok):
    narrow = df.select(*[col(c) for c in used])
    ranked = attach_ranks(narrow, used, rows, task_rows, broadcast_ok)
    rank_of = {c: f"rank_{i}" for i, c in enumerate(used)}
    return pair_aggregate(
        ranked, [(rank_of[a], rank_of[b]) for a, b in pairs], names={v: k for k, v in rank_of.items()}
    )


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.7, "strong").when(a >= 0.4, "moderate").when(a >= 0.2, "weak").otherwise("negligible")


def direction(r: Column) -> Column:
    return F.when(r > 0, "positive").otherwise("negative")


def correlation_sentence(r: Column, p: Column) -> Column:
    return F.format_string("%s %s correlation (r=%.3f, p=%.4f)", strength(r), direction(r), r, p)


def labelled(table: DataFrame) -> DataFrame:
    """Add significance, strength, direction and a sentence to (x, y, n, r, p_value)."""
    return table.withColumns({
        "significant": F.coalesce(F.col("p_value") < ALPHA, F.lit(False)),
        "strength": strength(F.col("r")),
        "direction": direction(F.col("r")),
        "interpretation": F.when(F.col("r").isNotNull(), correlation_sentence(F.col("r"), F.col("p_value"))),
    })


def auto_correlation(df: DataFrame, cols: list[str] | None = None, task_rows: int = TASK_ROWS,
                     moment_table: DataFrame | None = None) -> DataFrame:
    """(test_name, x, y, n, r, p_value, significant, strength, direction, interpretation).

    Pairs with at least 5 complete rows; Pearson when both columns are normal
    on those rows, else Spearman.  A pinned moments table of the columns saves scans.
    """
    cols = varying_numeric(df) if cols is None else cols
    pairs = list(combinations(cols, 2))
    schema = ("test_name string, " + PAIR_SCHEMA + ", p_value double, significant boolean, strength string, "
              "direction string, interpretation string")
    if not pairs:
        return empty(df.sparkSession, schema)
    total = df.count()
    if moment_table is None:
        filled = non_null_counts(df, cols)
    else:
        filled = {r["variable"]: r["n"] for r in moment_table.select("variable", "n").collect()}
    gaps = [p for p in pairs if filled[p[0]] < total or filled[p[1]] < total]
    shared = [c for c in cols if any(c in p for p in pairs if p not in gaps)]
    tests = [normality(df, shared, moment_table)] if shared else []
    verdict = {r["variable"]: (r["is_normal"], r["n"]) for r in union_all(tests).collect()} if tests else {}
    within = _normal_within(df, gaps) if gaps else {}
    of = lambda a, b, side: within[a, b, side] if (a, b, side) in within else verdict[side]
    usable = [p for p in pairs if of(*p, p[0])[1] >= 5]
    normal = [p for p in usable if of(*p, p[0])[0] and of(*p, p[1])[0]]
    other = [p for p in usable if p not in normal]
    parts = []
    if normal:
        parts.append(pair_aggregate(df, normal).select(F.lit("Pearson Correlation").alias("test_name"), "*"))
    if other:
        parts.append(_rank_correlation(df, other, task_rows, True, total, filled)
                     .select(F.lit("Spearman Correlation").alias("test_name"), "*"))
    if not parts:
        return empty(df.sparkSession, schema)
    return labelled(with_r_pvalue(union_all(parts)))


def _normal_within(df: DataFrame, gaps: list[tuple[str, str]]) -> dict:
    """(is_normal, n) by (a, b, side): each side of a pair on the pair's complete rows.

    Large sides are judged by one matrix of moments; only sides with few rows are sorted.
    """
    cols = list(dict.fromkeys(c for pair in gaps for c in pair))
    at = {c: i for i, c in enumerate(cols)}
    moments = present_moments(df, cols)
    size = {(r["i"], r["j"]): r["n"] for r in moments.select("i", "j", "n").collect()}
    k2 = omnibus(moments.where((F.col("i") != F.col("j")) & (F.col("n") >= LARGE_ROWS)), ["i", "j"])
    large = {(r["i"], r["j"]): r["p_value"] is not None and r["p_value"] > ALPHA for r in k2.collect()}
    out, probes = {}, {}
    for a, b in gaps:
        for side, other in ((a, b), (b, a)):
            key = (at[side], at[other])
            n = size.get(key, 0)
            out[a, b, side] = (large.get(key, False), n)
            if MIN_ROWS <= n < LARGE_ROWS:
                both = as_double(df, a).isNotNull() & as_double(df, b).isNotNull()
                probes[f"_probe_{len(probes)}"] = (a, b, side, F.when(both, as_double(df, side)))
    for part in chunks(list(probes), 200):
        tested = normality(df.select(*[probes[name][3].alias(name) for name in part]), part)
        for r in tested.collect():
            out[probes[r["variable"]][:3]] = (r["is_normal"], r["n"])
    return out


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Long form (x, y, n, r) with every ordered pair; the diagonal is 1."""
    cols = varying_numeric(df) if cols is None else cols
    half = pair_aggregate(df, list(combinations(cols, 2)))
    both = half.select(F.inline(F.array(
        F.struct("x", "y", "n", "r"),
        F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("n"), F.col("r")),
    )))
    filled = non_null_counts(df, cols)
    diagonal = local_table(df.sparkSession, [(c, c, filled[c], 1.0) for c in cols], PAIR_SCHEMA)
    return both.unionByName(diagonal)


def correlations_with(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """(variable, n, r): correlation of each other numeric column with the target."""
    cols = varying_numeric(df) if cols is None else cols
    return pair_aggregate(df, [(c, target) for c in cols if c != target]).select(
        F.col("x").alias("variable"), "n", "r"
    )


def significant_pairs(df: DataFrame, cols: list[str] | None = None, min_rows: int = 10,
                      min_abs_r: float = 0.3, max_cols: int | None = None) -> DataFrame:
    """Pearson pairs with |r| > 0.3 and p < 0.05, strongest first."""
    cols = (varying_numeric(df) if cols is None else cols)[:max_cols]
    table = pearson(df, list(combinations(cols, 2)))
    return (
        table.where((F.col("n") >= min_rows) & (F.abs("r") > min_abs_r) & (F.col("p_value") < ALPHA))
        .withColumn("strength", F.when(F.abs("r") > 0.7, "strong").otherwise("moderate"))
        .orderBy(F.abs("r").desc(), "x", "y")
    )
