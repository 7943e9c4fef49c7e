"""Exact order statistics and average ranks without a single-task sort.

Approximate quantiles give split points; the bucket of a value is a pure
function of the value, so equal values always share a bucket and a lost task
recomputes the same rows.  Ranks come from value counts: a value that holds a
third of all rows is one row of the count table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.frames import (
    PIN_ROWS, TASK_ROWS, as_double, chunks, col, cut, div, lay_out, local_table, q, unpivot_numeric,
)
from statloom.operators.selection import large_group_quantiles

# Buckets come from split points (a binary tree of comparisons per value) and,
# above MAX_BUCKETS x task_rows rows, from equal slices between split points.
MAX_BUCKETS = 512
MAX_SLICES = 64

# Split points are read off a sample of about this many rows.  They only shape
# the buckets; every rank and quantile is exact whatever the sample holds.
SAMPLE_ROWS = 1_000_000


@dataclass
class Splits:
    points: list[float]  # ascending, distinct
    low: float = 0.0  # sampled range, used to slice the outer buckets
    high: float = 0.0
    slices: int = 1


def split_points(df: DataFrame, cols: list[str], rows: int, task_rows: int = TASK_ROWS) -> dict[str, Splits]:
    """Per column, split points so that a bucket holds about `task_rows` rows."""
    wanted = -(-rows // max(1, task_rows))
    n = min(MAX_BUCKETS, wanted)
    if n <= 1:
        return {c: Splits([]) for c in cols}
    slices = min(MAX_SLICES, -(-wanted // MAX_BUCKETS))
    narrow = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    if rows > SAMPLE_ROWS:
        narrow = narrow.sample(SAMPLE_ROWS / rows, seed=7)
    probs = F.array(*[F.lit(i / n) for i in range(n + 1)])
    out = {}
    for part in chunks(range(len(cols)), 20):
        row = narrow.agg(*[F.percentile_approx(f"c{i}", probs, 20 * n).alias(f"s{i}") for i in part]).first()
        for i in part:
            cuts = row[f"s{i}"]
            out[cols[i]] = Splits(sorted(set(cuts[1:-1])), cuts[0], cuts[-1], slices) if cuts else Splits([])
    return out


def _number(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else f"double('{'-' if x < 0 else ''}Infinity')"


def _tree(value: str, points: list[float]) -> str:
    """SQL for the number of points <= value, as a balanced tree of comparisons."""

    def node(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {value} < {_number(points[mid])} THEN {node(lo, mid)} ELSE {node(mid + 1, hi)} END"

    return node(0, len(points))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _per_variable(name: str, sql: dict, default: str) -> Column:
    """One expression per variable (a text or a number), chosen by the column `name`."""
    if len(sql) == 1:
        return F.expr(next(iter(sql.values())))
    arms = " ".join(f"WHEN {name} = {c if isinstance(c, int) else _literal(c)} THEN {e}" for c, e in sql.items())
    return F.expr(f"CASE {arms} ELSE {default} END")


def with_bucket(long: DataFrame, splits: dict, name="variable", value="value") -> DataFrame:
    """Add the bucket number of each (variable, value) row; numbers follow the values."""
    if all(not s.points for s in splits.values()):
        return long.withColumn("bucket", F.lit(0))
    slices = max(s.slices for s in splits.values())
    out = long.withColumn("bucket", _per_variable(name, {c: _tree(value, s.points) for c, s in splits.items()}, "0"))
    if slices == 1:
        return out
    bounds = {c: [s.low, *s.points, s.high] for c, s in splits.items()}
    at = lambda step: _per_variable(name, {
        c: f"element_at(array({', '.join(map(_number, b))}), bucket + {step})" for c, b in bounds.items()
    }, "0D")
    low, high = F.col("_low"), F.col("_high")
    share = div(F.col(value) - low, high - low) * slices
    slice_ = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(slices - 1.0), share))).cast("int")
    return out.withColumns({"_low": at(1), "_high": at(2)}).withColumn(
        "bucket", F.col("bucket") * slices + F.coalesce(slice_, F.lit(0))
    ).drop("_low", "_high")


def bucket_of(value: str, splits: Splits) -> Column:
    """The bucket number of the values of one column, as with_bucket gives it."""
    if not splits.points:
        return F.lit(0)
    bucket = F.expr(_tree(value, splits.points))
    if splits.slices == 1:
        return bucket
    bounds = [splits.low, *splits.points, splits.high]
    low, high = (F.element_at(F.array(*[F.lit(float(x)) for x in bounds]), bucket + step) for step in (1, 2))
    share = div(F.col(value) - low, high - low) * splits.slices
    slice_ = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(splits.slices - 1.0), share))).cast("int")
    return bucket * splits.slices + F.coalesce(slice_, F.lit(0))


def rank_counts(counts: DataFrame, keys: list[str], single_bucket: bool = False) -> DataFrame:
    """Average ranks from a count table (keys..., bucket, value[, group], n).

    Adds `ties` (rows sharing the value), `below` (rows with a smaller value)
    and `rank`.  `counts` may hold several rows per value, one per group.
    """
    run = Window.partitionBy(*keys, "bucket").orderBy("value")
    here = Window.currentRow
    local = counts.withColumn("ties", F.sum("n").over(run.rangeBetween(here, here))).withColumn(
        "upto", F.sum("n").over(run.rangeBetween(Window.unboundedPreceding, here))
    )
    if single_bucket:
        local = local.withColumn("below", F.col("upto") - F.col("ties"))
    else:
        # One row per key and bucket: at most MAX_BUCKETS rows per key.
        w = Window.partitionBy(*keys).orderBy("bucket")
        offsets = (
            counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("bucket_n"))
            .withColumn("offset", F.sum("bucket_n").over(w) - F.col("bucket_n"))
            .drop("bucket_n")
        )
        local = local.join(offsets, [*keys, "bucket"]).withColumn(
            "below", F.col("offset") + F.col("upto") - F.col("ties")
        ).drop("offset")
    return local.withColumn("rank", F.col("below") + (F.col("ties") + 1) / 2.0).drop("upto")


def non_null_counts(df: DataFrame, cols: list[str]) -> dict:
    row = df.agg(*[F.count(as_double(df, c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return {c: row[i] for i, c in enumerate(cols)}


def value_ranks(df: DataFrame, cols: list[str], rows: int | None = None,
                task_rows: int = TASK_ROWS) -> DataFrame:
    """(variable, bucket, value, n, ties, below, rank): one row per distinct value."""
    rows = rows if rows is not None else df.count()
    long = with_bucket(unpivot_numeric(df, cols), split_points(df, cols, rows, task_rows))
    counts = long.groupBy("variable", "bucket", "value").agg(F.count(F.lit(1)).alias("n"))
    return rank_counts(counts, ["variable"], single_bucket=rows <= task_rows)


# Rank maps up to this many distinct values are broadcast to the rows.
BROADCAST_VALUES = 500_000
SALTS = 64
SCRATCH = ("value", "bucket", "_low", "_high", "_at", "_salt", "_salt_of_row", "_bucket", "_point", "_below", "_point_rank")


def _small_maps(df: DataFrame, cols: list[str], rows: int) -> dict:
    """Which columns provably have few distinct values."""
    if rows <= BROADCAST_VALUES:
        return {c: True for c in cols}
    row = df.agg(*[F.approx_count_distinct(as_double(df, c), 0.02).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    # 10 standard errors above the estimate still fit.
    return {c: row[i] * 1.2 < BROADCAST_VALUES for i, c in enumerate(cols)}


def attach_ranks(df: DataFrame, cols: list[str], rows: int | None = None,
                 task_rows: int = TASK_ROWS, broadcast_ok: bool = True) -> DataFrame:
    """Rows with columns `rank_<i>` (average rank of cols[i]); other columns kept.

    Few distinct values: a broadcast map of ranks.  Otherwise one shuffle into
    value buckets and a window in each.
    """
    rows = rows if rows is not None else df.count()
    small = _small_maps(df, cols, rows) if broadcast_ok else {c: False for c in cols}
    wide = [c for c in cols if not small[c]]
    splits = split_points(df, wide, rows, task_rows) if wide else {}
    out = df
    for i, c in enumerate(cols):
        if small[c]:
            ranks = rank_counts(
                unpivot_numeric(df, [c]).groupBy("variable", F.lit(0).alias("bucket"), "value")
                .agg(F.count(F.lit(1)).alias("n")), ["variable"], single_bucket=True,
            ).select(F.col("value").alias("_value"), F.col("rank").alias(f"rank_{i}"))
            out = out.withColumn("_probe", as_double(df, c)).join(
                F.broadcast(ranks), F.col("_probe") == F.col("_value"), "left"
            ).drop("_probe", "_value")
        else:
            out = _windowed_rank(df, out, c, f"rank_{i}", splits[c])
    return out


def _windowed_rank(df: DataFrame, rows: DataFrame, name: str, rank: str, splits: Splits) -> DataFrame:
    """Add the average rank of one column by a window over its value buckets.

    A value too frequent for a bucket is a split point itself.  Rows equal to a
    split point take their rank from exact counts and are spread over SALTS
    partitions, so no window partition grows with a frequent value.
    """
    points = splits.points
    on_point = lambda x: x.isin(points) if points else F.lit(False)
    # rows on a split point are counted apart from the rest of their bucket
    probe = with_bucket(df.select(as_double(df, name).alias("value")).where("value is not null"), {name: splits})
    sizes = probe.groupBy("bucket", F.when(on_point(F.col("value")), F.col("value")).alias("point")).agg(
        F.count(F.lit(1)).alias("n")
    ).collect()  # at most MAX_BUCKETS x (MAX_SLICES + 1) rows
    below, table = 0, []
    for r in sorted(sizes, key=lambda r: (r["bucket"], r["point"] is None)):
        table.append((r["bucket"], r["point"], float(below), below + (r["n"] + 1) / 2.0))
        below += r["n"]
    places = local_table(
        df.sparkSession, table, "_bucket int, _point double, _below double, _point_rank double")
    # columns of the caller that bear a scratch name step aside meanwhile
    aside = {c: f"_aside_{i}_{c}" for i, c in enumerate(rows.columns) if c.lower() in SCRATCH}
    rows = rows.withColumnsRenamed(aside)
    name_here = aside.get(name, name)
    # equal rows get different salts; the rank of rows that stand alone does not depend on the salt
    salted = rows.withColumns({"value": as_double(rows, name_here), "_salt_of_row": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))})
    keyed = with_bucket(salted, {name: splits}).withColumn(
        "_at", F.when(on_point(F.col("value")), F.col("value"))
    )
    alone = F.col("_at").isNotNull() | F.col("value").isNull()
    salt = F.when(alone, F.col("_salt_of_row")).otherwise(-1)
    placed = keyed.withColumn("_salt", salt).join(
        F.broadcast(places), (F.col("bucket") == F.col("_bucket")) & F.col("_at").eqNullSafe(F.col("_point")), "left"
    )
    w = Window.partitionBy("bucket", "_salt").orderBy("value")
    peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    inside = F.col("_below") + F.rank().over(w) + (peers - 1) / 2.0
    return placed.withColumn(
        rank, F.when(F.col("_at").isNotNull(), F.col("_point_rank")).when(F.col("value").isNotNull(), inside)
    ).drop(*SCRATCH).withColumnsRenamed({v: k for k, v in aside.items()})


# --- exact quantiles -------------------------------------------------------

def quantiles(df: DataFrame, cols: list[str], probs: list[float], task_rows: int = TASK_ROWS) -> dict:
    """Exact linear-interpolation quantiles: {column: [q1, q2, ...]} (None if no values).

    Columns with few rows use the built-in exact percentile.  For larger ones a
    bracket around each order statistic is narrowed until it holds few enough
    rows to sort; the answer is exact at any size.
    """
    if not cols:
        return {}
    out = {c: [None] * len(probs) for c in cols}
    large = {}
    if df.count() > task_rows:
        for part in chunks(cols, 50):
            large.update({c: n for c, n in non_null_counts(df, part).items() if n > task_rows})
    small = [c for c in cols if c not in large]
    if small:
        arr = F.array(*[F.lit(float(p)) for p in probs])
        # as rows, so each column's values meet in a task of their own
        table = unpivot_numeric(df, small).groupBy("variable").agg(F.percentile("value", arr).alias("q"))
        out.update({r["variable"]: list(r["q"]) for r in table.collect()})
    if large:
        out.update(_narrowed_quantiles(df, large, probs, task_rows))
    return out


def _narrowed_quantiles(df: DataFrame, sizes: dict[str, int], probs: list[float], task_rows: int) -> dict:
    """Order statistics by repeated bracketing, all columns together.

    A round samples the stretches that still hide a position, takes cut values
    around it, and counts the rows below and at each cut exactly.  Two scans
    per round; a round shrinks a stretch a few hundredfold, so a trillion rows
    need about four.  Stretches of at most `task_rows` rows are then sorted.
    """
    spots = {c: sorted({k for p in probs for k in (int((n - 1) * p), min(n - 1, int((n - 1) * p) + 1))})
             for c, n in sizes.items()}
    df = df.select(*[col(c) for c in sizes])
    known: dict[str, dict[float, tuple[int, int]]] = {c: {} for c in sizes}  # cut -> rows (below, equal)
    for attempt in count():
        found, gaps = _locate(spots, known, sizes)
        wide = {g for g in gaps.values() if g.size > task_rows}
        if not wide:
            break
        cuts = _sampled_cuts(df, wide, gaps, attempt)
        for c, counted in _counts_at(df, cuts).items():
            known[c].update(counted)
    if gaps:
        found.update(_sorted_picks(df, gaps))
    out = {}
    for c, n in sizes.items():
        out[c] = []
        for p in probs:
            h = (n - 1) * p
            low, high = found[(c, int(h))], found[(c, min(n - 1, int(h) + 1))]
            out[c].append(low if low == high else low + (high - low) * (h - int(h)))
    return out


@dataclass(frozen=True)
class _Gap:
    """Values strictly between two neighbouring cuts."""

    column: str
    low: float | None
    high: float | None
    below: int
    size: int


def _locate(spots, known, sizes):
    """Positions that fall on a counted cut, and the gap that hides each other one."""
    found, gaps = {}, {}
    for c, ks in spots.items():
        cuts = sorted(known[c].items())
        for k in ks:
            low, below, high, upto = None, 0, None, sizes[c]
            for value, (under, equal) in cuts:
                if under <= k < under + equal:
                    found[(c, k)] = value
                    break
                if under > k:
                    high, upto = value, under
                    break
                low, below = value, under + equal
            if (c, k) not in found:
                gaps[(c, k)] = _Gap(c, low, high, below, upto - below)
    return found, gaps


def _in_gaps(df: DataFrame, gaps: list[_Gap]) -> DataFrame:
    """(gap, value): rows inside the listed gaps, numbered by list position."""
    entries = []
    for c in dict.fromkeys(g.column for g in gaps):
        x, number = as_double(df, c), None
        for i, g in enumerate(gaps):
            if g.column == c:
                hit = x.isNotNull()
                hit = hit & (x > g.low) if g.low is not None else hit
                hit = hit & (x < g.high) if g.high is not None else hit
                number = F.when(hit, i) if number is None else number.when(hit, i)
        entries.append(F.struct(number.alias("gap"), x.alias("value")))
    return df.select(F.inline(F.array(*entries))).where("gap is not null")


def _sampled_cuts(df: DataFrame, wide: set[_Gap], gaps: dict, seed: int) -> dict[str, list[float]]:
    listed = sorted(wide, key=lambda g: (g.column, g.below))
    share, accuracy = F.lit(1.0), 5_000
    aims = []
    for i, g in enumerate(listed):
        m = min(g.size, SAMPLE_ROWS)
        share = F.when(F.col("gap") == i, m / g.size).otherwise(share)
        at = [(k - g.below + 0.5) / g.size for (_, k), other in gaps.items() if other == g]
        # three standard errors of a sampled quantile, plus the sketch's own error
        aims.append({min(1.0, max(0.0, p + d * (1.5 / m**0.5 + 1.0 / accuracy))) for p in at for d in (-1, 1)})
    every = sorted(set().union(*aims))
    rows = _in_gaps(df, listed).where(F.rand(seed) < share).groupBy("gap").agg(
        F.percentile_approx("value", F.array(*[F.lit(p) for p in every]), accuracy).alias("q")
    ).collect()
    cuts: dict[str, set] = {}
    for r in rows:
        cuts.setdefault(listed[r["gap"]].column, set()).update(
            v for p, v in zip(every, r["q"]) if p in aims[r["gap"]])
    return {c: sorted(v) for c, v in cuts.items()}


def _counts_at(df: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[float, tuple[int, int]]]:
    """Per cut, exact (rows below it, rows equal to it), from one grouped count."""
    cols = list(cuts)
    rows = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(cols)])
    rows = rows.withColumns({f"u{i}": F.expr(_tree(f"x{i}", cuts[c])) for i, c in enumerate(cols)})
    entries = []
    for i, c in enumerate(cols):
        at = f"element_at(array({', '.join(map(_number, cuts[c]))}), greatest(u{i}, 1))"
        entries.append(F.struct(
            F.lit(c).alias("variable"), F.expr(f"x{i} is not null").alias("present"), F.col(f"u{i}").alias("upto"),
            F.expr(f"coalesce(u{i} > 0 and x{i} = {at}, false)").alias("on_cut"),
        ))
    tally = rows.select(F.inline(F.array(*entries))).where("present").groupBy("variable", "upto", "on_cut").agg(
        F.count(F.lit(1)).alias("n")).collect()
    by = {(r["variable"], r["upto"], r["on_cut"]): r["n"] for r in tally}
    out = {}
    for c, v in cuts.items():
        below, out[c] = by.get((c, 0, False), 0), {}
        for i, value in enumerate(v, 1):
            equal = by.get((c, i, True), 0)
            out[c][value] = (below, equal)
            below += equal + by.get((c, i, False), 0)
    return out


def _sorted_picks(df: DataFrame, gaps: dict) -> dict:
    """Read positions off small gaps; each holds at most task_rows rows."""
    listed = sorted(set(gaps.values()), key=lambda g: (g.column, g.below))
    w = Window.partitionBy("gap").orderBy("value")
    runs = _in_gaps(df, listed).groupBy("gap", "value").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "upto", F.sum("n").over(w)
    )
    wanted = F.lit(False)
    for (_, k), g in gaps.items():
        rel = k - g.below
        hit = (F.col("gap") == listed.index(g)) & (F.col("upto") > rel) & (F.col("upto") - F.col("n") <= rel)
        wanted = wanted | hit
    picks = runs.where(wanted).collect()
    return {
        (c, k): next(r["value"] for r in picks
                     if r["gap"] == listed.index(g) and r["upto"] > k - g.below >= r["upto"] - r["n"])
        for (c, k), g in gaps.items()
    }


def grouped_quantiles(df: DataFrame, value: str, by: list[str], probs: list[float],
                      task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per group: by..., n, quantile array `q`; exact at any group size.

    Groups of at most `task_rows` rows use the built-in percentile, however many
    they are.  Larger ones are never gathered in one task: all of them are narrowed
    together, each between cuts of its own (see `selection`).
    """
    rows = df.select(*[col(b) for b in by], as_double(df, value).alias("value")).where("value is not null")
    arr = F.array(*[F.lit(float(p)) for p in probs])
    keys = [q(b) for b in by]
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    whole = lambda frame: frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("value", arr).alias("q"))
    if largest <= task_rows:
        return whole(rows)
    # a null is a group of its own, as in groupBy; equal structs join whatever they hold
    g = F.struct(*[col(b).alias(f"k{i}") for i, b in enumerate(by)])
    large = cut(rows.groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_rows), "large-groups")
    # values of one sign of zero
    keyed = rows.select(g.alias("g"), F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value")).alias("value"))
    exact = large_group_quantiles(keyed, large, probs, task_rows)
    small = rows.withColumn("_g", g).join(F.broadcast(large.select(F.col("g").alias("_g"))) if large.limit(PIN_ROWS + 1).count() <= PIN_ROWS
                                          else large.select(F.col("g").alias("_g")), "_g", "left_anti")
    return whole(small).unionByName(exact.select(*[F.col(f"g.k{i}").alias(b) for i, b in enumerate(by)], "n", "q"))


# --- global row order ------------------------------------------------------

def row_index(df: DataFrame, order_by: list[str], name: str = "row_index",
              task_rows: int = TASK_ROWS) -> DataFrame:
    """Add the 0-based position of each row in the given order.

    Remaining columns break ties, so the numbering is reproducible.  Above
    `task_rows` rows the frame is range-partitioned on the whole order key,
    written once, and numbered by partition offset plus local position.
    """
    rest = [f.name for f in df.schema.fields
            if f.name not in order_by and f.dataType.typeName() not in ("map", "variant")]
    order = [col(c) for c in [*order_by, *rest]]
    rows = df.count()
    if rows <= task_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    laid = cut(
        lay_out(df, order, rows).withColumn("_id", F.monotonically_increasing_id()),
        "row-index",
    )
    part = F.shiftright("_id", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_offset", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # one row per partition
    ).drop("_n")
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        laid.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local).drop("_part", "_id", "_offset")
    )
