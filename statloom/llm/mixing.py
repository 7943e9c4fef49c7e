"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token counts are added up per cell (source x language x topic).  Raking scales the cells to the target share of
each margin in turn, a given number of times (`residual` tells how far off the margins then are); the raked weight of
a cell over its tokens is the cell's sampling rate.  Rates are scaled so that a given share of all tokens is expected to be kept, no rate above
`top_rate`, or else so that the highest one is `top_rate`.  Every document is kept with the probability of its
cell, by a hash of its id, so the sample is the same on every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import col, cut, fresh

#: A table of at most so many cells (under 20 MB) is raked in one task, and its rates are broadcast.
BROADCAST_CELLS = 100_000
MARGINS = ("source", "lang", "topic")


def count_tokens(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed and carriage return."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\n\r]+"), lambda x: x != "")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from surface signs; the first that holds."""
    t = F.coalesce(text, F.lit(""))
    marks = F.char_length(t) - F.char_length(F.translate(t, "%*$#&", ""))
    low = F.lower(t)
    return (
        F.when(F.contains(low, F.lit("license")) | F.contains(low, F.lit("copyright")), "legal")
        .when(marks * 20 > F.char_length(t), "noisy").when(F.contains(t, F.lit("://")), "links")
        .when(F.contains(t, F.lit("@")), "contact").otherwise("prose")
    )


def unit_hash(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from 32 bits of the md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """Target shares of a margin: its own shares to the power `temper`, normalised."""
    shares = cells.groupBy(margin).agg(F.sum("tokens").alias("n")).where("n > 0").withColumn("p", F.pow(F.col("n").cast("double"), F.lit(temper)))
    total = shares.agg(F.sum("p")).first()[0] or 1.0
    return shares.select(margin, (F.col("p") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 8, margins=MARGINS) -> DataFrame:
    """Cells with `weight`, raked `sweeps` times to the target share of each margin.

    `cells` has one row per combination of the margins with its tokens; `targets` has (margin, target) tables.
    A margin value without a target gets weight zero; a target without tokens cannot be met and stays empty.
    Up to BROADCAST_CELLS cells are laid into one partition, where sums per margin need no shuffle.  More cells are
    summed per task and joined with their sums, and each sweep is cut from its lineage, so the plan does not grow.
    """
    work = cells.withColumn("weight", F.col("tokens").cast("double"))
    if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        share = {m: fresh(cells, f"share_{m}") for m in margins}
        work = work.coalesce(1)
        for m in margins:
            work = work.join(F.broadcast(targets[m].select(m, F.col("target").alias(share[m]))), m, "left")
        for _ in range(sweeps):
            for m in margins:
                total = F.sum("weight").over(Window.partitionBy(m))
                work = work.withColumn("sum", total).withColumn("weight", F.when(
                    F.col("sum") > 0, F.col("weight") * (F.coalesce(share[m], F.lit(0.0)) / F.when(F.col("sum") > 0, F.col("sum")))).otherwise(0.0))
        return cut(work.select(*cells.columns, "weight"), "rake")
    for _ in range(sweeps):
        for m in margins:
            sums = work.groupBy(m).agg(F.sum("weight").alias("sum")).join(targets[m], m, "left").select(
                F.col(m), F.when(F.col("sum") > 0, F.coalesce("target", F.lit(0.0)) / F.when(F.col("sum") > 0, F.col("sum"))).otherwise(0.0).alias("factor"))
            work = work.join(sums, m).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        work = cut(work, "rake")
    return work


def residual(raked: DataFrame, targets: dict[str, DataFrame], margins=MARGINS) -> float:
    """The largest distance of a margin's share from its target after raking."""
    total = raked.agg(F.sum("weight")).first()[0] or 0.0
    worst = 0.0
    for m in margins:
        share = F.coalesce(F.col("got") / F.lit(total or 1.0), F.lit(0.0))
        off = raked.groupBy(m).agg(F.sum("weight").alias("got")).join(targets[m], m, "full").select(F.abs(share - F.coalesce("target", F.lit(0.0))).alias("d"))
        worst = max(worst, off.agg(F.max("d")).first()[0] or 0.0)
    return worst


def scale_for(raked: DataFrame, keep: float, top_rate: float = 1.0) -> float | None:
    """The c for which cells sampled at min(top_rate, c * ratio) keep the share `keep` of all tokens; None if only
    `top_rate` for every cell comes near it.

    The kept tokens are piecewise linear and concave in c, so Newton's steps from below come to the exact c after
    finitely many; each is one sum over the cells.
    """
    c, held = 0.0, -1
    while True:
        full = F.col("ratio") * F.lit(c) >= F.lit(float(top_rate))
        total, capped, n, weight = raked.where("tokens > 0").agg(
            F.sum("tokens"), F.sum(F.when(full, F.col("tokens"))), F.count(F.when(full, 1)), F.sum(F.when(~full, F.col("weight")))).first()
        rest = keep * (total or 0) - top_rate * (capped or 0)
        if not weight:
            return None
        if n == held:
            return c
        c, held = max(c, rest / weight), n


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.9, sweeps: int = 8,
    top_rate: float = 1.0, rate_out: str = "rate", keep: float | None = None,
) -> DataFrame:
    """The sampled documents with all their columns and the rate they were kept at.

    `targets` gives shares per margin ("source", "lang", "topic"); a margin that is not given is tempered: its
    own shares to the power `temper`, normalised, which lifts rare values.  `keep` is the share of all tokens that
    is expected to be kept; cells that would need a rate above `top_rate` get `top_rate`, and the others make up for
    them.  Without `keep` the cell with the largest weight per token sets the rates of all others, so that one rare
    document can thin the rest.  Defined cases: null sources,
    languages and texts form their own class, written as an empty string; documents without tokens weigh
    nothing and get the rate of their cell, or `top_rate` in a cell without any tokens; rows that repeat an id
    are kept or dropped together if their cell is the same; an empty table stays empty; a column that bears
    the name of `rate_out` is replaced.

    Documents are pre-aggregated per task before the cells are shuffled, and rates come back by broadcast
    while the cells stay under BROADCAST_CELLS, so a source with a third of all rows is never moved.
    """
    spark = df.sparkSession
    base = df.drop(rate_out)
    keys = {m: fresh(base, f"mix_{m}") for m in MARGINS}
    named = base.withColumns({
        keys["source"]: F.coalesce(col(source_col).cast("string"), F.lit("")),
        keys["lang"]: F.coalesce(col(lang_col).cast("string"), F.lit("")),
        keys["topic"]: F.coalesce(topic if topic is not None else topic_of(col(text_col)), F.lit("")),
    })
    cells = named.select(*[F.col(keys[m]).alias(m) for m in MARGINS], count_tokens(col(text_col)).alias("tokens"))
    cells = cut(cells.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    goal = {}
    for m in MARGINS:
        if targets and m in targets:
            pairs = [F.struct(F.lit(k).alias(m), F.lit(float(v)).alias("target")) for k, v in targets[m].items()]
            goal[m] = spark.range(1).select(F.inline(F.array(*pairs)))
        else:
            goal[m] = cut(tempered(cells, m, temper), "mix-target")
    raked = rake(cells, goal, sweeps).withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.when(F.col("tokens") > 0, F.col("tokens"))))
    if keep is None:
        scale = F.col("ratio") / F.lit(raked.agg(F.max("ratio")).first()[0] or 1.0) * F.lit(float(top_rate))
    else:
        c = scale_for(raked, keep, top_rate)
        scale = F.when(F.col("ratio") > 0, F.lit(float(top_rate))).otherwise(F.col("ratio")) if c is None else F.col("ratio") * F.lit(c)
    rate = F.coalesce(F.least(F.lit(float(top_rate)), scale), F.lit(float(top_rate)))
    rates = cut(raked.select(*MARGINS, rate.alias("r")), "mix-rates")
    if rates.count() <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    r = fresh(named, "mix_rate")
    rates = rates.withColumnsRenamed({**keys, "r": r})
    out = named.join(rates, list(keys.values())).where(unit_hash(col(id_col)) < F.col(r))
    return out.select(*[col(c) for c in base.columns], F.col(r).alias(rate_out))
