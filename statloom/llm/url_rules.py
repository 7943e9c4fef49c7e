"""URL filters from association rules, with DataFrame functions only.

The URLs of labelled pages become sets of host and path tokens.  The token combinations that go with the unwanted
label are counted by growing frequent ones, token by token; rules are kept by support and confidence, and a rule is dropped if a shorter one inside
it is at least as confident.  Rules are matched through an inverted index: each rule hangs under its rarest
token, a URL looks up its own tokens, and the full combination is then checked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.frames import local_table, union_all
from statloom.llm.common import col, cut, fresh, lower_ascii

#: (host, path, verdict), fixed by the contract of the query.
FIXED_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
#: A rule index of at most so many rows (under 20 MB) is broadcast.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.char_length(F.substring_index(url, "://", 1)) + 4)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, lower_ascii(host)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.char_length(F.substring_index(url, "://", 1)) + 4)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise("")


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, and the letter-digit runs of the path."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(lower_ascii(path), r"[^a-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, words))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fixed rule that fits, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grown(found: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """(row, tokens): sets of `size` tokens inside the rows, joined from sets one token smaller that are counted in `sets`."""
    held = found.join(sets.select("tokens"), "tokens").select(
        "row", "tokens", F.slice("tokens", 1, size - 2).alias("stem"), F.element_at("tokens", -1).alias("token"))
    more = held.select("row", "stem", F.col("token").alias("next"))
    pairs = held.join(more, ["row", "stem"]).where(F.col("token") < F.col("next")).select(
        "row", F.concat("tokens", F.array("next")).alias("tokens"))
    rest = sets.select(F.col("tokens").alias("rest"))
    return pairs.withColumn("rest", F.slice("tokens", 2, size - 1)).join(rest, "rest", "left_semi").select("row", "tokens") if size > 2 else pairs


def mine_rules(
    labelled: DataFrame, url_col: str, bad: Column, min_support: float = 0.005, min_rows: int = 4, min_confidence: float = 0.6,
    max_size: int = 3,
) -> DataFrame:
    """(tokens, support, confidence) of the kept rules "these tokens, therefore unwanted".

    All token sets of at most `max_size` tokens of all labelled rows are counted, however many tokens a URL has: sets
    grow by one token at a time inside the distinct token sets of the URLs.  A set is left where it cannot lead to a
    kept rule: without the least support, or with as many rows as a set inside it, which is then as confident and
    shorter, as it is for every set around both.
    """
    spark = labelled.sparkSession
    rows = labelled.select(col(url_col).alias("url"), F.coalesce(bad, F.lit(False)).alias("bad"))
    rows = rows.select(F.array_sort(tokens_of(host_of(F.col("url")), path_of(F.col("url")))).alias("tokens"), F.col("bad").cast("long").alias("bad"))
    rows = cut(rows.groupBy("tokens").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).withColumn(
        "row", F.monotonically_increasing_id()), "url-fit")
    least = max(min_rows, math.ceil((rows.agg(F.sum("n")).first()[0] or 0) * min_support))
    weights = rows.select("row", "n", "bad")
    found = rows.select("row", F.explode(F.transform("tokens", lambda x: F.array(x))).alias("tokens"))
    sets, levels = None, []
    for size in range(1, max_size + 1):
        if sets is not None:
            found = _grown(found, sets, size)
        counted = found.join(weights, "row").groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("bad").alias("support")).where(
            F.col("support") >= least)
        if sets is not None:
            inside = F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.filter("tokens", lambda x, i: i != k)))
            fewest = counted.select("tokens", inside.alias("part")).join(
                sets.select(F.col("tokens").alias("part"), F.col("n").alias("rows")), "part").groupBy("tokens").agg(
                F.min("rows").alias("rows"), F.count("*").alias("parts"))
            counted = counted.join(fewest, "tokens").where((F.col("n") < F.col("rows")) & (F.col("parts") == size)).select("tokens", "n", "support")
        sets = cut(counted, "url-sets")
        if not sets.take(1):
            break
        levels.append(sets)
    if not levels:
        return local_table(spark, [], "tokens array<string>, support long, confidence double")
    rules = union_all(levels).withColumn("confidence", F.col("support") / F.col("n")).where(
        F.col("confidence") >= min_confidence).select("tokens", "support", "confidence")
    rules = cut(rules, "url-rules")
    # a rule falls to any shorter rule inside it that is as confident; at most 2 ** max_size subsets each
    subsets = F.transform(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("tokens")) - 2).cast("int")), lambda mask: F.filter(
        "tokens", lambda x, i: F.pmod(F.floor(mask / F.pow(F.lit(2.0), i)), F.lit(2)) == 1))
    inside = rules.where(F.size("tokens") > 1).select(
        F.col("tokens").alias("long"), F.col("confidence").alias("theirs"), F.explode(subsets).alias("tokens"))
    beaten = inside.join(rules, "tokens").where(F.col("confidence") >= F.col("theirs")).select(F.col("long").alias("tokens")).distinct()
    return cut(rules.join(beaten, "tokens", "left_anti"), "url-kept-rules")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, tokens, confidence) of the strongest mined rule of each distinct URL that has one."""
    entries = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    frequency = entries.groupBy("token").agg(F.count("*").alias("rules"))
    anchor = Window.partitionBy("tokens").orderBy("rules", "token")
    index = cut(entries.join(frequency, "token").withColumn("rank", F.row_number().over(anchor)).where("rank = 1").select(
        "token", F.col("tokens").alias("rule"), "confidence"), "url-index")
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    seen = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    hits = seen.join(index, "token").where(F.size(F.array_except("rule", "tokens")) == 0)
    best = F.max_by(F.struct(F.col("rule"), F.col("confidence")), F.struct("confidence", F.col("rule")))
    return hits.groupBy("url").agg(best.alias("best")).select("url", F.col("best.rule").alias("tokens"), F.col("best.confidence").alias("confidence"))


def judge_urls(pages: DataFrame, rules: DataFrame, fixed: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """Add host, path, rule, verdict, mined_rule and confidence.

    A fixed rule fits its host and all subdomains where the path starts with the rule's; the longest one wins
    over the mined rules, and its name stands in `rule`.  Elsewhere the verdict is "block" for a URL that matches
    a mined rule and "allow" for all others.  Defined cases: a null URL, or one without "://", has an empty host
    and path and is allowed; repeated URLs get equal verdicts; columns that bear an output's name are replaced.
    """
    outputs = ["host", "path", "rule", "verdict", "mined_rule", "confidence"]
    base = pages.drop(*[c for c in outputs if c != url_col])
    url, fixed_col, hit = fresh(base, "url_key"), fresh(base, "url_fixed"), fresh(base, "url_hit")
    base = base.withColumn(url, col(url_col)).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    distinct = base.select(F.col(url).alias("url"), "host", "path").where(F.col("url").isNotNull()).distinct().select(
        "url", tokens_of(F.col("host"), F.col("path")).alias("tokens"))
    matched = match_rules(distinct, rules).select(
        F.col("url").alias(url), F.struct(F.array_join("tokens", " ").alias("rule"), "confidence").alias(hit))
    out = base.join(matched, url, "left").withColumn(fixed_col, fixed_rule(F.col("host"), F.col("path"), fixed))
    return out.withColumns({
        "rule": F.col(fixed_col)["rule"],
        "verdict": F.coalesce(F.col(fixed_col)["verdict"], F.when(F.col(hit).isNotNull(), "block").otherwise("allow")),
        "mined_rule": F.col(hit)["rule"], "confidence": F.col(hit)["confidence"],
    }).drop(url, fixed_col, hit)
