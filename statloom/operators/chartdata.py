"""The aggregation behind each chart type, as small tables a notebook can plot."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.frames import (
    TASK_ROWS, as_double, col, cut, div, empty, is_numeric, local_table, settle,
)
from statloom.functions.special import with_norm_ppf
from statloom.operators.association import row_percent, top_values
from statloom.operators.correlation import correlation_matrix, safe_corr
from statloom.operators.ranks import grouped_quantiles, quantiles, row_index, value_ranks
from statloom.operators.regression import OLSFit
from statloom.operators.roles import columns_of


def auto_bins(n: int, per_bin: int = 20) -> int:
    """Bin count of automatic histograms: n // per_bin kept within 10..50."""
    return min(50, max(10, n // per_bin))


def histogram(df: DataFrame, cols: list[str], bins: int | None = 30, per_bin: int = 20) -> DataFrame:
    """(variable, bin, low, high, n): equal-width bins per column, empty bins included.

    bins=None uses `auto_bins` on each column's own count.
    """
    limits = df.agg(*[f(as_double(df, c)).alias(f"{k}{i}") for i, c in enumerate(cols)
                      for k, f in (("a", F.min), ("z", F.max), ("n", F.count))]).first()
    entries, frame = [], []
    for i, c in enumerate(cols):
        low, high, n = limits[f"a{i}"], limits[f"z{i}"], limits[f"n{i}"]
        if not n:
            continue
        k = (auto_bins(n, per_bin) if bins is None else bins) if high > low else 1
        width = (high - low) / k if high > low else 1.0
        x = as_double(df, c)
        number = F.least(F.floor((x - F.lit(low)) / F.lit(width)).cast("int"), F.lit(k - 1))
        entries.append(F.struct(F.lit(c).alias("variable"), number.alias("bin")))
        frame += [(c, b, low + b * width, low + (b + 1) * width if b < k - 1 else high) for b in range(k)]
    if not frame:
        return empty(df.sparkSession, "variable string, bin int, low double, high double, n long")
    counts = (
        df.select(F.inline(F.array(*entries))).where("bin is not null")
        .groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    grid = local_table(df.sparkSession, frame, "variable string, bin int, low double, high double")
    return grid.join(counts, ["variable", "bin"], "left").select(
        "variable", "bin", "low", "high", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def _grouped(df: DataFrame, column: str, group_by: str | None) -> DataFrame:
    group = col(group_by).cast("string") if group_by else F.lit("all")
    rows = df.select(group.alias("grp"), as_double(df, column).alias("value"))
    return rows.where("grp is not null and value is not null")


def _fences(df: DataFrame, column: str, group_by: str | None, task_rows: int) -> DataFrame:
    table = grouped_quantiles(_grouped(df, column, group_by), "value", ["grp"], [0.25, 0.5, 0.75], task_rows)
    iqr = F.col("q")[2] - F.col("q")[0]
    return settle(table.select(
        "grp", F.col("n"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
        (F.col("q")[0] - 1.5 * iqr).alias("lower_fence"), (F.col("q")[2] + 1.5 * iqr).alias("upper_fence"),
    ))


def box_summary(df: DataFrame, column: str, group_by: str | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """(grp, n, q1, median, q3, whiskers, notch span, outliers) per group."""
    rows = _grouped(df, column, group_by)
    fences = _fences(df, column, group_by, task_rows)
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    ends = rows.join(fences.select("grp", "lower_fence", "upper_fence"), "grp").groupBy("grp").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
    notch = 1.57 * (F.col("q3") - F.col("q1")) / F.sqrt("n")
    return fences.join(ends, "grp").select(
        "grp", "n", "q1", "median", "q3", "whisker_low", "whisker_high",
        (F.col("median") - notch).alias("notch_low"), (F.col("median") + notch).alias("notch_high"), "outliers",
    )


def box_outliers(df: DataFrame, column: str, group_by: str | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """(grp, value): the points beyond the fences."""
    fences = _fences(df, column, group_by, task_rows).select("grp", "lower_fence", "upper_fence")
    return _grouped(df, column, group_by).join(fences, "grp").where(
        ~F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    ).select("grp", "value")


def scatter_points(df: DataFrame, x: str, y: str, hue: str | None = None, fraction: float | None = None,
                   seed: int = 42) -> DataFrame:
    """(x, y, grp) of complete rows; `fraction` thins the points for display only."""
    group = col(hue).cast("string") if hue else F.lit("all")
    rows = df.select(as_double(df, x).alias("x"), as_double(df, y).alias("y"), group.alias("grp"))
    rows = rows.where("x is not null and y is not null and grp is not null")
    return rows if fraction is None else rows.sample(fraction, seed)


def scatter_thinned(df: DataFrame, x: str, y: str, hue: str | None = None, grid: int = 200, per_cell: int = 1) -> DataFrame:
    """(grp, cell_x, cell_y, n, x, y): points to draw, at most `per_cell` of each cell of a grid x grid raster.

    The raster spans the finite range of all points; infinite ones fall into the outermost cells.  `n` counts the
    points of the cell, so a chart can shade dense cells, and a point that lies alone is always drawn: thinning
    never loses an outlier.  The points of a cell are those with the smallest of `per_cell` independent hashes of
    (x, y), which does not depend on the layout of the table.  Counts and smallest hashes collapse within tasks, so
    what is shuffled is bounded by the cells, and a cell that holds a third of the rows is one row per task.
    """
    rows = scatter_points(df, x, y, hue)
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    ends = rows.agg(*[f(finite(c)).alias(f"{c}_{name}") for c in ("x", "y") for name, f in (("low", F.min), ("high", F.max))]).first()

    def cell(c: str) -> Column:
        low, high = ends[f"{c}_low"], ends[f"{c}_high"]
        if low is None or not high > low:
            return F.when(F.col(c) == float("inf"), grid - 1).otherwise(0)
        at = F.floor((F.col(c) - F.lit(low)) / F.lit(high - low) * grid)
        return F.greatest(F.lit(0), F.least(F.lit(grid - 1), at)).cast("int")

    hashes = [F.xxhash64(F.lit(j), F.col("x"), F.col("y")) for j in range(per_cell)]
    cells = rows.withColumns({"cell_x": cell("x"), "cell_y": cell("y")}).groupBy("grp", "cell_x", "cell_y").agg(
        F.count(F.lit(1)).alias("n"), *[F.min_by(c, h).alias(f"{c}{j}") for j, h in enumerate(hashes) for c in ("x", "y")])
    drawn = F.array_distinct(F.array(*[F.struct(F.col(f"x{j}").alias("x"), F.col(f"y{j}").alias("y")) for j in range(per_cell)]))
    return cells.select("grp", "cell_x", "cell_y", "n", F.inline(drawn))


def scatter(df: DataFrame, x: str, y: str, hue: str | None = None, grid: int = 200) -> DataFrame:
    """(grp, part, x, y, n, r2): all that a scatter chart shows.

    part "point" has the thinned points with the number of rows in their cell; "trend" has the two ends of each
    group's least-squares line with the rows and r2 it was fitted on.
    """
    none = F.lit(None).cast("double")
    points = scatter_thinned(df, x, y, hue, grid).select("grp", F.lit("point").alias("part"), "x", "y", "n", none.alias("r2"))
    end = lambda c: F.struct(F.col(c).alias("x"), (F.col("intercept") + F.col("slope") * F.col(c)).alias("y"))
    line = trend_line(df, x, y, hue).where("slope is not null").select(
        "grp", F.lit("trend").alias("part"), "n", "r2", F.inline(F.array(end("x_min"), end("x_max"))))
    return points.unionByName(line)


def trend_line(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """(grp, n, slope, intercept, r2, x_min, x_max): least-squares line per colour group."""
    rows = scatter_points(df, x, y, hue)
    slope = div(F.covar_pop("x", "y"), F.var_pop("x"))
    r = safe_corr(F.col("x"), F.col("y"))
    return rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), slope.alias("slope"), (F.avg("y") - slope * F.avg("x")).alias("intercept"),
        (r * r).alias("r2"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
    )


def heatmap(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(x, y, r): the correlation matrix rounded for display; needs two columns."""
    cols = columns_of(df, "numeric") if cols is None else cols
    if len(cols) < 2:
        raise ValueError("Insufficient data for this chart type")
    return correlation_matrix(df, cols).select("x", "y", F.round("r", 2).alias("r"))


def bar_counts(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    return top_values(df, column, k)


def pie_shares(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(value, n, share): top-k values with their share of the shown total."""
    top = top_values(df, column, k)
    return top.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # k rows


def area_series(df: DataFrame, cols: list[str], order_by: list[str], buckets: int | None = None,
                task_rows: int = TASK_ROWS) -> DataFrame:
    """(variable, position, value): values by row number in the given order.

    `buckets` averages runs of neighbouring rows down to that many points.
    """
    keys = [col(c).alias(f"_o{i}") for i, c in enumerate(order_by)]
    rows = df.select(*keys, *[as_double(df, c).alias(f"_v{i}") for i, c in enumerate(cols)])
    order = [f"_o{i}" for i in range(len(order_by))]
    placed = row_index(rows, order, "position", task_rows)
    entries = [F.struct(F.lit(c).alias("variable"), F.col(f"_v{i}").alias("value")) for i, c in enumerate(cols)]
    long = placed.select("position", F.inline(F.array(*entries))).select("variable", "position", "value")
    if buckets is None:
        return long
    per = max(1, -(-df.count() // buckets))
    return long.groupBy("variable", F.floor(F.col("position") / per).alias("position")).agg(
        F.avg("value").alias("value")
    ).select("variable", "position", "value")


def hierarchy(df: DataFrame, path: list[str], values: str | None = None) -> DataFrame:
    """(depth, path..., total, percent_of_parent) for every prefix of the path.

    Rows with a null in the path are left out, as a chart cannot place them.
    """
    keys = [f"level_{i + 1}" for i in range(len(path))]
    rows = df.select(*[col(c).cast("string").alias(k) for c, k in zip(path, keys)],
                     (as_double(df, values) if values else F.lit(1.0)).alias("_v"))
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    # leaf sums first, so the roll-up expands leaves instead of rows
    leaves = rows.groupBy(*keys).agg(F.sum("_v").alias("_v"))
    sums = leaves.rollup(*keys).agg(F.sum("_v").alias("total"), F.grouping_id().alias("_g"))
    depth = sum((F.col(k).isNotNull().cast("int") for k in keys), F.lit(0))
    sums = sums.withColumn("depth", depth).drop("_g")
    parent = sums.select(
        (F.col("depth") + 1).alias("_d"), *[F.col(k).alias(f"_p_{k}") for k in keys], F.col("total").alias("_whole")
    )
    match = [F.col("depth") == F.col("_d")]
    for i, k in enumerate(keys):
        # a node's parent shares all levels but the node's own
        up = F.when(F.col("depth") > i + 1, F.col(k))
        match.append(up.eqNullSafe(F.col(f"_p_{k}")))
    return sums.join(parent, match, "left").select(
        "depth", *keys, "total", (div(F.col("total"), F.col("_whole")) * 100.0).alias("percent_of_parent")
    )


def radar(df: DataFrame, category: str, metrics: list[str], k: int | None = None) -> DataFrame:
    """(category, metric, mean, scaled): group means over the largest group mean; `k` keeps the first k categories.

    The maximum is taken over all categories before the first k are kept; one category alone is not compared.
    """
    means = df.where(col(category).isNotNull()).groupBy(col(category).cast("string").alias("category")).agg(
        *[F.avg(as_double(df, m)).alias(f"m{i}") for i, m in enumerate(metrics)]
    )
    top = means.agg(F.count(F.lit(1)).alias("n"), *[F.max(f"m{i}").alias(f"t{i}") for i in range(len(metrics))]).first()
    if top["n"] < 2:
        raise ValueError("Insufficient data for this chart type")
    first = means.orderBy("category").limit(k) if k is not None else means
    entries = []
    for i, m in enumerate(metrics):
        scale = top[f"t{i}"] if top[f"t{i}"] else 1.0
        entries.append(F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").alias("mean"),
                                (F.col(f"m{i}") / F.lit(float(scale))).alias("scaled")))
    return first.select("category", F.inline(F.array(*entries)))


def _violin_shape(df: DataFrame, rows: DataFrame, column: str, group_by: str | None, points: int, task_rows: int) -> DataFrame:
    """(grp, n, low, high, step, h): range, grid step and Silverman bandwidth of the groups that have a spread."""
    spread = rows.groupBy("grp").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_samp("value").alias("sd")
    )
    box = _fences(df, column, group_by, task_rows).select("grp", "n", (F.col("q3") - F.col("q1")).alias("iqr"))
    scale = F.least("sd", F.when(F.col("iqr") > 0, F.col("iqr") / 1.349).otherwise(F.col("sd")))
    return settle(spread.join(box, "grp").where((F.col("n") > 1) & (F.col("high") > F.col("low"))).select(
        "grp", "n", "low", "high", ((F.col("high") - F.col("low")) / (points - 1)).alias("step"),
        (1.059 * scale * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
    ))


# Bins of a binned density: sixteen per bandwidth, within these limits.
LEAST_BINS, MOST_BINS, BINS_PER_BANDWIDTH = 1024, 16_384, 16


def _kernel_sums(points: int):
    def run(bins: pd.DataFrame) -> pd.DataFrame:
        """The densities of one group from its bins, of which there are MOST_BINS at most."""
        one = bins.iloc[0]
        weight = np.zeros(int(one["bins"]))
        at = bins["bin"].to_numpy()
        np.add.at(weight, at, bins["n_here"].to_numpy() - bins["ahead"].to_numpy())
        np.add.at(weight, at + 1, bins["ahead"].to_numpy())
        place = np.flatnonzero(weight)
        centre, h = one["low"] + place * one["width"], one["h"]
        x = one["low"] + np.arange(points) * one["step"]
        mass = np.exp(-(((x[:, None] - centre) / h) ** 2) / 2.0) @ weight[place]
        return pd.DataFrame({
            "grp": one["grp"], "point": np.arange(points, dtype=np.int32), "x": x, "density": mass / (one["n"] * h * math.sqrt(2 * math.pi)),
            "error_bound": one["width"] ** 2 / (8 * h**3 * math.sqrt(2 * math.pi))})

    return run


def violin_binned(df: DataFrame, column: str, group_by: str | None = None, points: int = 100, task_rows: int = TASK_ROWS) -> DataFrame:
    """(grp, point, x, density, error_bound): the density of `violin_density`, from bins.

    Every value is shared out between the two bin centres beside it (linear binning), which is two sums per bin
    inside the tasks, so no row is repeated; the kernel is laid over the bins only.  The linear interpolation of
    the kernel between centres that are w apart is wrong by at most w^2 / (8 h^3 sqrt(2 pi)), and so is the density:
    with sixteen bins per bandwidth h, by 1/2048 of the height of one kernel.  Only ranges of more than a thousand
    bandwidths have wider bins; `error_bound` says so.
    """
    rows = _grouped(df, column, group_by)
    shape = _violin_shape(df, rows, column, group_by, points, task_rows)
    span = F.col("high") - F.col("low")
    bins = F.greatest(F.lit(LEAST_BINS), F.least(F.lit(MOST_BINS), F.ceil(F.lit(BINS_PER_BANDWIDTH) * span / F.col("h")).cast("int") + 1))
    shape = shape.withColumn("bins", bins).withColumn("width", span / (F.col("bins") - 1))
    place = (F.col("value") - F.col("low")) / F.col("width")
    at = F.greatest(F.lit(0), F.least(F.col("bins") - 2, F.floor(place).cast("int")))
    binned = rows.join(shape, "grp").withColumn("bin", at).groupBy("grp", "bin").agg(
        F.count(F.lit(1)).cast("double").alias("n_here"), F.sum(place - F.col("bin")).alias("ahead"))
    schema = "grp string, point int, x double, density double, error_bound double"
    return binned.join(shape, "grp").groupBy("grp").applyInPandas(_kernel_sums(points), schema)


def violin(df: DataFrame, column: str, group_by: str | None = None, points: int = 100, task_rows: int = TASK_ROWS) -> DataFrame:
    """(grp, part, point, x, density): all that a violin shows.

    part "density" has `points` points of the density; "median", "q1", "q3", "whisker_low" and "whisker_high" have one
    row each; "outlier" has a row for every value beyond the fences.
    """
    none = F.lit(None)
    shape = violin_binned(df, column, group_by, points, task_rows).select("grp", F.lit("density").alias("part"), "point", "x", "density")
    names = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    box = box_summary(df, column, group_by, task_rows).select("grp", F.inline(F.array(*[
        F.struct(F.lit(name).alias("part"), F.col(name).alias("x")) for name in names])))
    beyond = box_outliers(df, column, group_by, task_rows).select("grp", F.lit("outlier").alias("part"), F.col("value").alias("x"))
    marks = box.unionByName(beyond).select("grp", "part", none.cast("int").alias("point"), "x", none.cast("double").alias("density"))
    return shape.unionByName(marks)


def violin_density(df: DataFrame, column: str, group_by: str | None = None, points: int = 100,
                   task_rows: int = TASK_ROWS) -> DataFrame:
    """(grp, point, x, density): Gaussian kernel density on a grid from min to max.

    Silverman bandwidth 1.059 * min(sd, IQR/1.349) * n^(-1/5).  Every value
    counts; it only reaches the grid points within eight bandwidths, beyond
    which its kernel is below double precision, so the work per row shrinks
    as the data grows.
    """
    rows = _grouped(df, column, group_by)
    shape = _violin_shape(df, rows, column, group_by, points, task_rows)
    reach = 8.0 * F.col("h")
    lowest = F.greatest(F.lit(0), F.ceil((F.col("value") - reach - F.col("low")) / F.col("step")).cast("int"))
    highest = F.least(F.lit(points - 1), F.floor((F.col("value") + reach - F.col("low")) / F.col("step")).cast("int"))
    near = rows.join(shape, "grp").withColumns({"_a": lowest, "_b": highest}).where("_a <= _b").select(
        "grp", "low", "step", "h", "value", F.explode(F.sequence("_a", "_b")).alias("point")
    )
    z = (F.col("low") + F.col("point") * F.col("step") - F.col("value")) / F.col("h")
    sums = near.groupBy("grp", "point").agg(F.sum(F.exp(-z * z / 2.0)).alias("mass"))
    grid = shape.select("grp", "n", "low", "step", "h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    return grid.join(sums, ["grp", "point"], "left").select(
        "grp", "point", (F.col("low") + F.col("point") * F.col("step")).alias("x"),
        (F.coalesce("mass", F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"),
    )


# A run of equal values is expanded in pieces of this many ranks.
RUN_PIECE = 100_000


def filliben(i: Column, n: Column) -> Column:
    """Plotting position of rank i among n."""
    last = F.pow(F.lit(0.5), 1.0 / n)
    return F.when(i == n, last).when(i == 1, 1.0 - last).otherwise((i - 0.3175) / (n + 0.365))


def qq_points(df: DataFrame, column: str, task_rows: int = TASK_ROWS, min_rows: int = 3) -> DataFrame:
    """(rank, theoretical, sample): normal quantiles against the sorted sample.

    A value shared by very many rows is cut into pieces that are spread over
    the tasks before its ranks are written out.
    """
    rows = df.select(as_double(df, column).alias(column)).where(col(column).isNotNull())
    n = rows.count()
    if n < min_rows:
        raise ValueError("Insufficient data for this chart type")
    runs = value_ranks(rows, [column], n, task_rows).select(
        "value", (F.col("below") + 1).alias("first"), (F.col("below") + F.col("ties")).alias("last")
    )
    short = (F.col("last") - F.col("first")) < RUN_PIECE
    parts = runs.where(short)
    if n > RUN_PIECE:
        pieces = runs.where(~short).select(
            "value", "last", F.explode(F.sequence("first", "last", F.lit(RUN_PIECE).cast("long"))).alias("first")
        )
        parts = parts.unionByName(pieces.repartition("first").select(
            "value", "first", F.least(F.col("last"), F.col("first") + RUN_PIECE - 1).alias("last")
        ))
    ranked = parts.select("value", F.explode(F.sequence("first", "last")).alias("rank"))
    place = filliben(F.col("rank").cast("double"), F.lit(float(n)))
    return with_norm_ppf(ranked, place, "theoretical").select("rank", "theoretical", F.col("value").alias("sample"))


def qq_thinned(df: DataFrame, column: str, points: int = 1000, ends: int = 50, task_rows: int = TASK_ROWS,
               min_rows: int = 3) -> DataFrame:
    """(rank, theoretical, sample): the QQ points at chosen ranks, each with its exact value.

    `points` ranks are spaced evenly from the first to the last, and the `ends` outermost ranks of either side are
    all there, where a normal plot is read.  A run of equal values finds its own ranks among them by integer
    arithmetic, so neither runs nor ranks are written out in full.
    """
    rows = df.select(as_double(df, column).alias(column)).where(col(column).isNotNull())
    n = rows.count()
    if n < max(min_rows, 2):
        raise ValueError("Insufficient data for this chart type")
    steps, span = max(1, min(points, n) - 1), n - 1
    runs = value_ranks(rows, [column], n, task_rows).select(
        "value", (F.col("below") + 1).cast("long").alias("first"), (F.col("below") + F.col("ties")).cast("long").alias("last"))
    # rank i of the even ones is 1 + floor(i * span / steps)
    even_from = F.expr(f"((first - 1) * {steps}L + {span - 1}L) div {span}L")
    even_to = F.expr(f"(last * {steps}L - 1) div {span}L")
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    even = F.transform(upto(even_from, F.least(even_to, F.lit(steps).cast("long"))), lambda i: (i * F.lit(span) - F.pmod(i * F.lit(span), F.lit(steps))) / F.lit(steps) + 1).cast("array<bigint>")
    first_ones = upto(F.col("first"), F.least(F.col("last"), F.lit(min(ends, n)).cast("long")))
    last_ones = upto(F.greatest(F.col("first"), F.lit(max(n - ends + 1, 1)).cast("long")), F.col("last"))
    ranked = runs.select("value", F.explode(F.array_distinct(F.concat(even, first_ones, last_ones))).alias("rank"))
    place = filliben(F.col("rank").cast("double"), F.lit(float(n)))
    return with_norm_ppf(ranked, place, "theoretical").select("rank", "theoretical", F.col("value").alias("sample"))


def qq(df: DataFrame, column: str, points: int = 1000, task_rows: int = TASK_ROWS, min_rows: int = 3) -> DataFrame:
    """(part, rank, theoretical, sample): all that a QQ chart shows.

    part "point" has the thinned points, "line" the two ends of the least-squares line through all points.
    """
    drawn = qq_thinned(df, column, points, task_rows=task_rows, min_rows=min_rows).select(F.lit("point").alias("part"), "rank", "theoretical", "sample")
    line = qq_line(df, column, task_rows, min_rows)
    n = F.col("n").cast("double")
    ends = with_norm_ppf(line.where("slope is not null").select("slope", "intercept", F.explode(F.array(filliben(F.lit(1.0), n), filliben(n, n))).alias("p")),
                         F.col("p"), "theoretical")
    return drawn.unionByName(ends.select(
        F.lit("line").alias("part"), F.lit(None).cast("long").alias("rank"), "theoretical",
        (F.col("intercept") + F.col("slope") * F.col("theoretical")).alias("sample")))


def qq_line(df: DataFrame, column: str, task_rows: int = TASK_ROWS, min_rows: int = 3) -> DataFrame:
    """One row: n, slope, intercept and r of the least-squares line through the QQ points."""
    points = qq_points(df, column, task_rows, min_rows)
    slope = div(F.covar_pop("theoretical", "sample"), F.var_pop("theoretical"))
    return points.agg(
        F.count(F.lit(1)).alias("n"), slope.alias("slope"),
        (F.avg("sample") - slope * F.avg("theoretical")).alias("intercept"),
        safe_corr(F.col("theoretical"), F.col("sample")).alias("r"),
    )


def stacked_percent(df: DataFrame, a: str, b: str) -> DataFrame:
    return row_percent(df, a, b)


# --- regression charts -----------------------------------------------------

def actual_vs_predicted(fit: OLSFit) -> DataFrame:
    return fit.predictions().select("actual", "predicted")


def residuals_vs_fitted(fit: OLSFit) -> DataFrame:
    return fit.predictions().select("predicted", "residual")


def prediction_range(fit: OLSFit) -> DataFrame:
    """One row: low and high of the perfect-prediction diagonal."""
    return fit.predictions().agg(
        F.least(F.min("actual"), F.min("predicted")).alias("low"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("high"),
    )


def residual_histogram(fit: OLSFit) -> DataFrame:
    return histogram(fit.predictions().select("residual"), ["residual"], bins=None, per_bin=15)


def residual_qq_line(fit: OLSFit, task_rows: int = TASK_ROWS) -> DataFrame:
    return qq_line(fit.predictions().select("residual"), "residual", task_rows, min_rows=6)


def lag_bars(fit: OLSFit) -> DataFrame:
    """(kind, lag, value, band, outside): ACF and PACF bars; lag 0 is never outside."""
    return fit.acf_pacf().select("band", F.inline(F.array(
        F.struct(F.lit("acf").alias("kind"), "lag", F.col("acf").alias("value"), F.col("acf_outside").alias("outside")),
        F.struct(F.lit("pacf").alias("kind"), "lag", F.col("pacf").alias("value"), F.col("pacf_outside").alias("outside")),
    ))).select("kind", "lag", "value", "band", "outside")


def vif_bars(fit: OLSFit) -> DataFrame:
    """(variable, vif, band): bars with their 5 / 10 band."""
    return fit.vif().select("variable", F.round("vif", 2).alias("vif"), F.col("multicollinearity").alias("band"))


def coefficient_bars(fit: OLSFit) -> DataFrame:
    """(variable, coefficient, arm_low, arm_high, significant), without the intercept."""
    c = fit.coefficients().where(F.col("variable") != "const")
    return c.select(
        "variable", "coefficient", (F.col("coefficient") - F.col("ci_lower")).alias("arm_low"),
        (F.col("ci_upper") - F.col("coefficient")).alias("arm_high"), "significant",
    )


# --- requests --------------------------------------------------------------

def _numeric(df: DataFrame, names) -> list[str]:
    return [c for c in names if c in df.columns and is_numeric(df.schema[c].dataType)]


def _request(df: DataFrame, spec: dict, order_by) -> DataFrame | None:
    kind = spec.get("type", "").lower()
    column, group = spec.get("column", ""), spec.get("group_by") or None
    group = group if group in df.columns else None
    known = column in df.columns
    numbers = bool(_numeric(df, [column]))
    cols = _numeric(df, spec.get("columns", []))
    path = [c for c in spec.get("path", []) if c in df.columns]
    if kind == "histogram":
        return histogram(df, cols) if cols else None
    if kind == "boxplot":
        return box_summary(df, column, group) if numbers else None
    if kind == "violin":
        return violin(df, column, group) if numbers else None
    if kind == "scatter":
        x, y, hue = spec.get("x", ""), spec.get("y", ""), spec.get("hue")
        both = x in df.columns and y in df.columns
        return scatter(df, x, y, hue if hue in df.columns else None) if both else None
    if kind == "heatmap":
        return heatmap(df) if len(columns_of(df, "numeric")) >= 2 else None
    if kind == "bar":
        return bar_counts(df, column) if known else None
    if kind in ("donut", "pie"):
        return pie_shares(df, column) if known else None
    if kind == "area":
        return area_series(df, cols, order_by) if cols else None
    if kind in ("sunburst", "treemap"):
        values = spec.get("values")
        return hierarchy(df, path, values if values in df.columns else None) if path else None
    if kind == "radar":
        metrics = _numeric(df, spec.get("metrics", []))
        category = spec.get("categories", "")
        return radar(df, category, metrics) if category in df.columns and metrics else None
    return qq(df, column) if numbers else None


CHART_TYPES = ["histogram", "boxplot", "scatter", "heatmap", "bar", "area", "sunburst", "radar", "violin",
               "treemap", "donut", "pie", "qq"]


def run_requests(df: DataFrame, specs: list[dict], order_by: list[str] | None = None):
    """({title: DataFrame}, status table (position, chart_type, title, error)).

    Unknown types are skipped; a request that cannot be served gets an error
    row and does not stop the others.  Every chart is computed here, once, so
    that what fails on the rows shows in the status, too.
    """
    made, status = {}, []
    for i, spec in enumerate(specs):
        kind = spec.get("type", "").lower()
        if kind not in CHART_TYPES:
            continue
        title, error = spec.get("title", f"Chart {i + 1}"), None
        try:
            table = _request(df, spec, order_by)
            if table is None:
                error = "Insufficient data for this chart type"
            else:
                made[title] = cut(table, "chart")
        except Exception as exc:  # reported in the status row
            error = str(exc).split("\n")[0]
        status.append((i + 1, kind, title, error))
    return made, local_table(
        df.sparkSession, status, "position int, chart_type string, title string, error string")
