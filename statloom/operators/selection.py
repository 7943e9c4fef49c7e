"""Exact order statistics of many large groups at once, each group with cuts of its own.

A position hides in a gap between two values of its group; at first that is the whole group.  A round sketches the
rows of all open gaps, takes cut values from the sketches, and counts the rows at and between the cuts exactly; a
position then either falls on a cut or hides in a gap some ten to some hundred times smaller.  Sketches only shape
the work, never the answer.  Counts and sketches collapse within tasks, so neither a large group nor a value that
a third of all rows share meets in one task.  Gaps of bounded size are sorted at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.functions.frames import broadcast_if_small, cut, union_all

#: The first cuts stand so far on both sides of the wanted shares; later ones divide a gap evenly.
FIRST_MARGIN, FIRST_ACCURACY = 0.002, 2000
CUTS, ACCURACY = 16, 400


def _in_gaps(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """(g, low, high, value): rows that lie strictly inside an open gap of their group; no bound is null."""
    gaps = spots.groupBy("g").agg(F.collect_set(F.struct("low", "high")).alias("gaps"))  # two per share at most
    x = F.col("value")
    inside = lambda s: (s["low"].isNull() | (x > s["low"])) & (s["high"].isNull() | (x < s["high"]))
    found = rows.join(broadcast_if_small(gaps), "g").withColumn("gap", F.get(F.filter("gaps", inside), 0))
    return found.where("gap is not null").select("g", "gap.low", "gap.high", "value")


def _cells(inside: DataFrame, cuts: DataFrame) -> DataFrame:
    """(g, low, high, upto, on_cut, n, cuts): exact counts at each cut of a gap and after it."""
    same = lambda side: F.col(f"a.{side}").eqNullSafe(F.col(f"b.{side}"))
    placed = inside.alias("a").join(broadcast_if_small(cuts).alias("b"), (F.col("a.g") == F.col("b.g")) & same("low") & same("high")).select(
        "a.g", "a.low", "a.high", "value", F.size(F.filter("cuts", lambda c: c <= F.col("value"))).alias("upto"), "cuts")
    on_cut = (F.col("upto") > 0) & (F.col("value") == F.try_element_at("cuts", F.greatest("upto", F.lit(1))))
    counted = placed.groupBy("g", "low", "high", "upto", on_cut.alias("on_cut")).agg(F.count("*").alias("n"))
    return counted.alias("a").join(cuts.alias("b"), (F.col("a.g") == F.col("b.g")) & same("low") & same("high")).select(
        "a.g", "a.low", "a.high", "upto", "on_cut", "n", "cuts")


def _narrowed(spots: DataFrame, cells: DataFrame) -> DataFrame:
    """Spots (g, k, low, high, below, size, value) after a round; `value` is set where a cut is the answer."""
    order = Window.partitionBy("g", "low", "high").orderBy("upto", F.desc("on_cut"))
    cells = cells.withColumn("before", F.sum("n").over(order) - F.col("n"))
    same = lambda side: F.col(f"s.{side}").eqNullSafe(F.col(f"c.{side}"))
    here = (F.col("before") <= F.col("k") - F.col("below")) & (F.col("k") - F.col("below") < F.col("before") + F.col("n"))
    hit = spots.alias("s").join(cells.alias("c"), (F.col("s.g") == F.col("c.g")) & same("low") & same("high") & here)
    at: Column = F.try_element_at("cuts", F.greatest("upto", F.lit(1)))
    following = F.when(F.col("upto") < F.size("cuts"), F.try_element_at("cuts", F.least(F.col("upto") + 1, F.size("cuts"))))
    return hit.select(
        "s.g", "k", F.when(F.col("upto") > 0, at).otherwise(F.col("s.low")).alias("low"), F.coalesce(following, "s.high").alias("high"),
        (F.col("below") + F.col("before")).alias("below"), F.col("n").alias("size"), F.when(F.col("on_cut"), at).alias("value"))


def _sorted_picks(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """(g, k, value) of spots in gaps of bounded size."""
    order = Window.partitionBy("g", "low", "high").orderBy("value")
    runs = _in_gaps(rows, spots).groupBy("g", "low", "high", "value").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(order))
    same = lambda side: F.col(f"s.{side}").eqNullSafe(F.col(f"r.{side}"))
    rel = F.col("k") - F.col("below")
    return spots.alias("s").join(runs.alias("r"), (F.col("s.g") == F.col("r.g")) & same("low") & same("high") & (
        F.col("upto") > rel) & (F.col("upto") - F.col("n") <= rel)).select("s.g", "k", F.col("r.value").alias("value"))


def order_statistics(rows: DataFrame, sizes: DataFrame, probs: list[float], task_rows: int) -> DataFrame:
    """(g, k, value): the k-th smallest value (from 0) of each group, for the positions around every share of its size.

    `rows` is (g, value) without nulls, `sizes` is (g, n) of the groups wanted; others are passed over.
    """
    shares = F.array(*[F.lit(float(p)) for p in probs])
    n = F.col("n")
    around = F.flatten(F.transform(shares, lambda p: F.array(
        F.floor((n - 1) * p).cast("long"), F.least(n - 1, F.floor((n - 1) * p).cast("long") + 1))))
    none = F.lit(None).cast("double")
    spots = sizes.select("g", F.explode(F.array_distinct(around)).alias("k"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below"), n.alias("size"))
    spots = cut(spots, "quantile-spots")
    first = sorted({min(1.0, max(0.0, p + d * FIRST_MARGIN)) for p in probs for d in (-1, 1)})
    grid, accuracy = first, FIRST_ACCURACY
    found = []
    while True:
        wide = spots.where(F.col("size") > task_rows)
        if wide.isEmpty():
            break
        inside = _in_gaps(rows, wide)
        sketch = F.percentile_approx("value", F.array(*[F.lit(p) for p in grid]), accuracy)
        cuts = cut(inside.groupBy("g", "low", "high").agg(F.array_sort(F.array_distinct(sketch)).alias("cuts")), "quantile-cuts")
        moved = cut(_narrowed(wide, _cells(inside, cuts)), "quantile-spots")
        found.append(moved.where("value is not null").select("g", "k", "value"))
        spots = spots.where(F.col("size") <= task_rows).unionByName(moved.where("value is null").drop("value"))
        grid, accuracy = [i / CUTS for i in range(CUTS + 1)], ACCURACY
    found.append(_sorted_picks(rows, spots))
    return union_all(found)


def large_group_quantiles(rows: DataFrame, sizes: DataFrame, probs: list[float], task_rows: int) -> DataFrame:
    """(g, n, q): exact quantiles by linear interpolation of the groups in `sizes` (g, n)."""
    picks = order_statistics(rows, sizes, probs, task_rows)
    by_place = picks.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("at"))

    def quantile(p: float) -> Column:
        h = (F.col("n") - 1) * F.lit(p)
        low = F.floor(h).cast("long")
        a, b = F.col("at")[low], F.col("at")[F.least(F.col("n") - 1, low + 1)]
        return F.when(a == b, a).otherwise(a + (b - a) * (h - low))

    return sizes.join(by_place, "g").select("g", "n", F.array(*[quantile(float(p)) for p in probs]).alias("q"))
