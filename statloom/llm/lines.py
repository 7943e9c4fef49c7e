"""Line deduplication over whole documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import col, cut, fresh, hash_pair, lower_ascii

#: Fixed by the contract: the characters stripped at both ends of a line's key.
BLANKS = " \t\n\x0b\x0c\r"
LEAST_ID = -(2**63)
#: Keys that hold more than one line in so many are joined by broadcast.
HOT_KEYS = 1000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
    lines_out: str = "n_lines", dropped_out: str = "n_dropped",
) -> DataFrame:
    """Drop lines whose key occurs in `min_docs` documents or more, except in the largest id that holds it.

    The key is the line stripped of blanks and with A-Z lower-cased; keys under `min_chars` code points are
    never dropped.  Returns all columns with the text reassembled, and the two counts.  Defined cases: a null
    or empty text is one empty line and comes back as an empty text; rows that share an id count as
    one document; a null id is smaller than all others; rows that repeat id and text are
    treated alike; columns of the input that bear the names of the two counts are replaced.

    Key counts collapse within each task, so a line held by a third of all documents is one row per task.
    Only hashes and positions are shuffled for the lines; each text is shuffled once, to its dropped positions.
    """
    for name in (lines_out, dropped_out):
        df = df.drop(name)
    i, t, d = fresh(df, "line_id"), fresh(df, "line_text_hash"), fresh(df, "line_drops")
    keyed = df.withColumns({
        i: F.coalesce(col(id_col).cast("long"), F.lit(LEAST_ID)),
        t: F.xxhash64(F.coalesce(col(text_col), F.lit(""))),
    })
    key = lambda line: lower_ascii(F.btrim(line, F.lit(BLANKS)))
    lines = keyed.select(F.col(i).alias("id"), F.col(t).alias("th"), F.posexplode(_lines(col(text_col))).alias("pos", "line"))
    lines = lines.where(F.char_length("line") >= min_chars).withColumn("key", key(F.col("line")))
    h1, h2 = hash_pair("key")
    lines = cut(lines.where(F.char_length("key") >= min_chars).select("id", "th", "pos", h1.alias("h1"), h2.alias("h2")), "lines")
    holders = lines.select("h1", "h2", "id").distinct()
    common = cut(holders.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("id").alias("keeper")).where(
        F.col("docs") >= min_docs), "lines-common")
    # at most HOT_KEYS keys can hold that share of all lines: they go to the lines, all others are shuffled
    hot = F.col("docs") > lines.count() / HOT_KEYS
    held = lambda keys: keys.select("h1", "h2", "keeper")
    frequent = F.broadcast(held(common.where(hot)))
    gone_lines = lines.join(frequent, ["h1", "h2"]).unionByName(
        lines.join(frequent, ["h1", "h2"], "left_anti").join(held(common.where(~hot)), ["h1", "h2"]))
    drops = gone_lines.where(F.col("id") != F.col("keeper")).groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias(d))
    drops = drops.withColumnsRenamed({"id": i, "th": t})
    out = keyed.join(drops, [i, t], "left")
    gone = F.coalesce(F.size(d), F.lit(0))
    parts = F.transform(F.array(_lines(col(text_col))), lambda lines: F.struct(
        F.size(lines).alias("n"),
        F.when(F.col(d).isNotNull(), F.array_join(_kept(lines, F.col(d)), "\n")).alias("text")))[0]
    p = fresh(out, "line_parts")
    return out.withColumn(p, parts).withColumns({
        lines_out: F.col(p)["n"].cast("long"), dropped_out: gone.cast("long"),
        text_col: F.coalesce(F.col(p)["text"], col(text_col), F.lit("")),
    }).select(*[col(c) for c in df.columns], lines_out, dropped_out)


def _kept(lines: Column, drops: Column) -> Column:
    """The lines outside the sorted positions `drops`: the stretches between them, linear in the lines."""
    starts = F.concat(F.array(F.lit(-1)), drops)
    ends = F.concat(drops, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1)))
