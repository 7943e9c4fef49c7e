"""Group comparison: t-test, ANOVA, Mann-Whitney, Kruskal-Wallis and their dispatchers.

Parametric tests read only per-group moments.  Rank tests read value counts per
group, so ties and hot values collapse before any shuffle.  Groups are taken in
ascending order, which fixes the sign of t and the group U belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.frames import (
    TASK_ROWS, as_double, broadcast_if_small, col, div, empty, local_table, pin, union_all,
)
from statloom.functions.special import (
    FEW, chi2_pvalue, f_pvalue, mann_whitney_exact_pvalue, norm_upper, t_pvalue,
)
from statloom.operators.describe import finite, moment_aggs
from statloom.operators.normality import grouped_normality
from statloom.operators.ranks import bucket_of, rank_counts, split_points
from statloom.operators.roles import columns_of, level_counts, varying_numeric

ALPHA = 0.05
MIN_GROUP = 3
KEYS = ["category", "variable"]
RESULT = [*KEYS, "test_name", "groups", "n", "statistic", "df", "p_value"]
RESULT_SCHEMA = ("category string, variable string, test_name string, groups long, n long, statistic double, "
                 "df double, p_value double")


def _long_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, group, value): rows once per (category, numeric) pair, named by list position.

    Small integer keys keep the hash tables and shuffles of long rows light.
    """
    entries = [
        F.struct(F.lit(i).alias("pair"), col(c).cast("string").alias("group"), as_double(df, v).alias("value"))
        for i, (c, v) in enumerate(pairs)
    ]
    return df.select(F.inline(F.array(*entries))).where("group is not null and value is not null")


def _named(table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Replace the pair number by (category, variable)."""
    names = local_table(table.sparkSession, [(i, c, v) for i, (c, v) in enumerate(pairs)],
                        "pair int, category string, variable string")
    return table.join(F.broadcast(names), "pair").select(*KEYS, *[c for c in table.columns if c != "pair"])


def _numbered(table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Replace (category, variable) by the pair number; other pairs are left out."""
    names = local_table(table.sparkSession, [(i, c, v) for i, (c, v) in enumerate(pairs)],
                        "pair int, category string, variable string")
    return table.join(F.broadcast(names), KEYS).select("pair", *[c for c in table.columns if c not in KEYS])


def group_moments(df: DataFrame, cats: list[str], nums: list[str], min_group: int = MIN_GROUP) -> DataFrame:
    """(category, variable, group, n, mean, var, g1, g2, min, max) of groups with enough rows."""
    pairs = [(c, v) for c in cats for v in nums]
    m = _long_pairs(df, pairs).groupBy("pair", "group").agg(*moment_aggs(F.col("value"))).withColumns(
        {c: finite(F.col(c)) for c in ("var", "g1", "g2")}
    )
    return _named(m.where(F.col("n") >= min_group), pairs)


def _usable(pinned: DataFrame) -> dict[tuple[str, str], int]:
    """(category, variable) pairs that keep at least two groups, with their group count."""
    found = pinned.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("groups")).where("groups >= 2").collect()
    return dict(sorted(((r["category"], r["variable"]), r["groups"]) for r in found))


def _two_groups(table: DataFrame, columns: list[str], *more) -> DataFrame:
    """One row per key with exactly two groups: `a` is the smaller group, `b` the larger."""
    entry = F.struct("group", *columns)
    return table.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("groups"), F.min(entry).alias("a"), F.max(entry).alias("b"), *more).where("groups = 2")


def t_test(moment_table: DataFrame) -> DataFrame:
    """Student's t with pooled variance for keys with exactly two groups."""
    pair = _two_groups(moment_table, ["n", "mean", "var"])
    a, b = F.col("a"), F.col("b")
    n1, n2 = a["n"].cast("double"), b["n"].cast("double")
    pooled = ((n1 - 1) * a["var"] + (n2 - 1) * b["var"]) / (n1 + n2 - 2)
    flat = pair.select(
        *KEYS, F.lit(2).cast("long").alias("groups"), (a["n"] + b["n"]).alias("n"),
        div(a["mean"] - b["mean"], F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("statistic"),
        (n1 + n2 - 2).alias("df"),
    )
    return flat.select(
        *KEYS, F.lit("Independent t-test").alias("test_name"), "groups", "n", "statistic", "df",
        t_pvalue("statistic", "df").alias("p_value"),
    )


def anova(moment_table: DataFrame) -> DataFrame:
    """One-way ANOVA F from group counts, means and variances; df is that between groups."""
    grand = moment_table.groupBy(*KEYS).agg(
        F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")
    )
    gap = F.col("mean") - F.col("grand")
    sums = (
        moment_table.join(F.broadcast(grand), KEYS).groupBy(*KEYS, "total")
        .agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * gap * gap).alias("between"),
             F.sum((F.col("n") - 1) * F.col("var")).alias("within"))
        .where("groups >= 2")
        .withColumns({"df": (F.col("groups") - 1).cast("double"),
                      "df_within": (F.col("total") - F.col("groups")).cast("double")})
    )
    f = div(F.col("between") / F.col("df"), div(F.col("within"), F.col("df_within")))
    return sums.withColumn("statistic", f).select(
        *KEYS, F.lit("One-way ANOVA").alias("test_name"), "groups", F.col("total").alias("n"), "statistic", "df",
        f_pvalue("statistic", "df", "df_within").alias("p_value"),
    )


def rank_sums(df: DataFrame, pairs: list[tuple[str, str]], usable: DataFrame,
              task_rows: int = TASK_ROWS) -> DataFrame:
    """(category, variable, group, n, rank_sum, tie_term) of pooled average ranks.

    `pairs` are (category, numeric) columns; `usable` lists the groups to keep
    as (category, variable, group) and is pinned.  Buckets are found once per
    numeric column, before rows are repeated per pair.
    """
    rows = df.count()
    cats = list(dict.fromkeys(c for c, _ in pairs))
    nums = list(dict.fromkeys(v for _, v in pairs))
    splits = split_points(df, nums, rows, task_rows)
    wide = df.select(*[col(c).cast("string").alias(f"g{i}") for i, c in enumerate(cats)],
                     *[as_double(df, v).alias(f"v{i}") for i, v in enumerate(nums)])
    wide = wide.select("*", *[bucket_of(f"v{i}", splits[v]).alias(f"b{i}") for i, v in enumerate(nums)])
    entries = [
        F.struct(F.lit(i).alias("pair"), F.col(f"g{cats.index(c)}").alias("group"),
                 F.col(f"v{nums.index(v)}").alias("value"), F.col(f"b{nums.index(v)}").alias("bucket"))
        for i, (c, v) in enumerate(pairs)
    ]
    long = wide.select(F.inline(F.array(*entries))).where("group is not null and value is not null")
    counts = long.groupBy("pair", "bucket", "value", "group").agg(F.count(F.lit(1)).alias("n"))
    wanted = broadcast_if_small(_numbered(usable.select(*KEYS, "group"), pairs), usable)
    kept = counts.join(wanted, ["pair", "group"], "left_semi")
    ranked = rank_counts(kept, ["pair"], single_bucket=rows <= task_rows)
    ties = F.col("ties").cast("double")
    sums = ranked.groupBy("pair", "group").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"),
        F.sum(F.col("n") * (ties * ties - 1)).alias("tie_term"),
    )
    return _named(sums, pairs)


def mann_whitney(sums: DataFrame, method: str = "auto") -> DataFrame:
    """Two-sided Mann-Whitney U of the first group, for keys with two groups, and the `method` of its p-value.

    method "auto" is exact where a side has at most FEW values and nothing is tied, at any size of the other side;
    "exact" is exact wherever nothing is tied, which takes time n1 * n2 when both sides are larger; "normal" never is.
    Otherwise the p-value is normal with tie and continuity correction.
    """
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method {method!r}")
    pair = _two_groups(sums, ["n", "rank_sum"], F.sum("tie_term").alias("tie_term"))
    a, b = F.col("a"), F.col("b")
    n1, n2 = a["n"].cast("double"), b["n"].cast("double")
    total = n1 + n2
    u1 = a["rank_sum"] - n1 * (n1 + 1) / 2.0
    upper = F.greatest(u1, n1 * n2 - u1)
    sd = F.sqrt(n1 * n2 / 12.0 * ((total + 1) - F.col("tie_term") / (total * (total - 1))))
    small = {"auto": F.least(n1, n2) <= FEW, "exact": F.lit(True), "normal": F.lit(False)}[method]
    exact = small & (F.col("tie_term") == 0)
    flat = pair.select(
        *KEYS, F.lit(2).cast("long").alias("groups"), (a["n"] + b["n"]).alias("n"), u1.alias("statistic"),
        F.when(exact, upper).alias("_u"), a["n"].alias("_n1"), b["n"].alias("_n2"),
        div(upper - n1 * n2 / 2.0 - 0.5, sd).alias("_z"), F.when(exact, "exact").otherwise("normal").alias("method"),
    )
    normal = F.coalesce(F.least(F.lit(1.0), 2.0 * norm_upper("_z")), F.lit(1.0))  # no spread: p = 1
    return flat.select(
        *KEYS, F.lit("Mann-Whitney U").alias("test_name"), "groups", "n", "statistic",
        F.lit(None).cast("double").alias("df"),
        F.coalesce(mann_whitney_exact_pvalue("_u", "_n1", "_n2"), normal).alias("p_value"), "method",
    )


def kruskal_wallis(sums: DataFrame) -> DataFrame:
    """Tie-corrected H; null when all values are equal."""
    parts = sums.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("tie_term").alias("tie_term"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("spread"),
    ).where("groups >= 2")
    n = F.col("n").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("spread") - 3.0 * (n + 1)
    flat = parts.select(
        *KEYS, F.lit("Kruskal-Wallis").alias("test_name"), "groups", "n",
        div(h, 1.0 - F.col("tie_term") / (n * n * n - n)).alias("statistic"),
        (F.col("groups") - 1).cast("double").alias("df"),
    )
    return flat.withColumn("p_value", chi2_pvalue("statistic", "df"))


def _only(df: DataFrame, table: DataFrame, pairs) -> DataFrame:
    chosen = local_table(df.sparkSession, list(pairs), "category string, variable string")
    return table.join(F.broadcast(chosen), KEYS, "left_semi")


def compare_groups(df: DataFrame, test: str, pairs: list[tuple[str, str]], min_group: int = MIN_GROUP,
                   task_rows: int = TASK_ROWS) -> DataFrame:
    """Run one named test - t, anova, mannwhitney, kruskal - on (category, numeric) pairs."""
    cats = list(dict.fromkeys(c for c, _ in pairs))
    nums = list(dict.fromkeys(v for _, v in pairs))
    table = _only(df, group_moments(df, cats, nums, min_group), pairs)
    if test in ("t", "anova"):
        return {"t": t_test, "anova": anova}[test](table).select(*RESULT)
    sums = rank_sums(df, pairs, pin(table.select(*KEYS, "group")), task_rows)
    return {"mannwhitney": mann_whitney, "kruskal": kruskal_wallis}[test](sums).select(*RESULT)


def mann_whitney_pairs(df: DataFrame, pairs: list[tuple[str, str]], method: str = "auto", min_group: int = MIN_GROUP,
                       task_rows: int = TASK_ROWS) -> DataFrame:
    """Mann-Whitney U of (category, numeric) pairs with the `method` that each p-value was found by."""
    cats = list(dict.fromkeys(c for c, _ in pairs))
    nums = list(dict.fromkeys(v for _, v in pairs))
    wanted = pin(_only(df, group_moments(df, cats, nums, min_group), pairs).select(*KEYS, "group"))
    return mann_whitney(rank_sums(df, pairs, wanted, task_rows), method).select(*RESULT, "method")


def _categories(df: DataFrame, cats: list[str] | None, lo: int, hi: int, levels: dict | None = None) -> list[str]:
    cats = columns_of(df, "categorical") if cats is None else cats
    levels = level_counts(df, cats, hi) if levels is None else levels
    return [c for c in cats if levels.get(c) is not None and lo <= levels[c] <= hi]


def labelled(table: DataFrame) -> DataFrame:
    significant = F.coalesce(F.col("p_value") < ALPHA, F.lit(False))
    text = F.format_string(
        "%s: %s difference in %s across %s groups (p=%.4f)", F.col("test_name"),
        F.when(significant, "significant").otherwise("not significant"),
        F.col("variable"), F.col("category"), F.col("p_value"),
    )
    return table.withColumns({
        "significant": significant,
        "interpretation": F.when(F.col("p_value").isNotNull(), text),
    })


def auto_group_tests(df: DataFrame, cats: list[str] | None = None, nums: list[str] | None = None,
                     max_groups: int = 20, task_rows: int = TASK_ROWS, levels: dict | None = None) -> DataFrame:
    """Pick and run a test per (category, numeric) pair.

    Categories with 2 to 20 levels; groups below 3 rows are dropped and two must
    remain.  All groups normal: t-test or ANOVA; else Mann-Whitney or Kruskal-Wallis.
    `levels` gives distinct counts that are already known.
    """
    spark = df.sparkSession
    cats = _categories(df, cats, 2, max_groups, levels)
    nums = varying_numeric(df) if nums is None else nums
    out_schema = RESULT_SCHEMA + ", significant boolean, interpretation string"
    if not cats or not nums:
        return empty(spark, out_schema)
    m = pin(group_moments(df, cats, nums))
    ready = _usable(m)
    if not ready:
        return empty(spark, out_schema)
    pairs = list(ready)
    tested = pin(_numbered(m, pairs))
    verdict = grouped_normality(_long_pairs(df, pairs), tested, ["pair", "group"], pinned=True)
    all_normal = {
        pairs[r["pair"]]: r["ok"] for r in verdict.groupBy("pair").agg(F.every("is_normal").alias("ok")).collect()
    }
    chosen = {"t": [], "anova": [], "mannwhitney": [], "kruskal": []}
    for key, k in ready.items():
        if all_normal[key]:
            chosen["t" if k == 2 else "anova"].append(key)
        else:
            chosen["mannwhitney" if k == 2 else "kruskal"].append(key)
    return labelled(_run(df, m, chosen, task_rows))


def _run(df: DataFrame, m: DataFrame, chosen: dict, task_rows: int) -> DataFrame:
    parts = []
    if chosen.get("t"):
        parts.append(t_test(_only(df, m, chosen["t"])))
    if chosen.get("anova"):
        parts.append(anova(_only(df, m, chosen["anova"])))
    by_rank = [*chosen["mannwhitney"], *chosen["kruskal"]]
    if by_rank:
        # both rank tests share one ranking; the result has a row per group
        sums = pin(rank_sums(df, by_rank, _only(df, m, by_rank), task_rows))
        if chosen["mannwhitney"]:
            parts.append(mann_whitney(_only(df, sums, chosen["mannwhitney"])))
        if chosen["kruskal"]:
            parts.append(kruskal_wallis(_only(df, sums, chosen["kruskal"])))
    return union_all([p.select(*RESULT) for p in parts])


def group_screen(df: DataFrame, cats: list[str] | None = None, nums: list[str] | None = None,
                 max_groups: int = 10, max_cats: int | None = None, max_nums: int | None = None,
                 task_rows: int = TASK_ROWS, levels: dict | None = None) -> DataFrame:
    """Non-parametric screen: significant differences only, smallest p first."""
    spark = df.sparkSession
    cats = columns_of(df, "categorical") if cats is None else cats
    levels = level_counts(df, cats, 20) if levels is None else levels
    # the first categories with 2 to 20 levels, of which those within the limit are tested
    cats = _categories(df, _categories(df, cats, 2, 20, levels)[:max_cats], 2, max_groups, levels)
    nums = (varying_numeric(df) if nums is None else nums)[:max_nums]
    if not cats or not nums:
        return empty(spark, RESULT_SCHEMA)
    m = pin(group_moments(df, cats, nums))
    ready = _usable(m)
    if not ready:
        return empty(spark, RESULT_SCHEMA)
    chosen = {
        "mannwhitney": [k for k, g in ready.items() if g == 2],
        "kruskal": [k for k, g in ready.items() if g > 2],
    }
    return _run(df, m, chosen, task_rows).where(F.col("p_value") < ALPHA).orderBy("p_value", *KEYS)
