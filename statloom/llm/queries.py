"""The registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import bpe, hnsw, html_text, huffman, lines, mixing, neardup, phrases, spelling, substrings, topk, toxicity, url_rules

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_exact_top_k", """
with parts as (
  select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scaled as (select vec_id, i, cast(floor(256 * cast(x as double)) as bigint) as x from parts),
scores as (
  select a.vec_id as query_id, b.vec_id as vec_id, cast(sum(a.x * b.x) as bigint) as score
  from scaled a join scaled b on a.i = b.i and a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scores)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 5""")
def op1(spark, sf):
    return topk.exact_top_k(table(spark, sf, "embeddings"), k=5, every=50, scale=256)


MIN_CONFIDENCE, MIN_ROWS, MIN_SUPPORT = 0.6, 4, 0.005
_RULES = " ".join(
    f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}|{v}'"
    for h, p, v in sorted(url_rules.FIXED_RULES, key=lambda r: -len(r[0] + r[1])))


def _rule_sql(size: int) -> str:
    """Itemsets of `size` tokens with their rows and their unwanted rows."""
    items = ", ".join(f"t{i}.token" for i in range(size))
    joins = " ".join(f"join baskets t{i} on t{i}.page_id = t0.page_id and t{i}.token > t{i - 1}.token" for i in range(1, size))
    groups = ", ".join(f"t{i}.token" for i in range(size))
    return (f"select [{items}] as tokens, count(*) as n, cast(sum(t0.bad) as bigint) as support "
            f"from baskets t0 {joins} group by {groups} having sum(t0.bad) >= (select least from fit_size)")


@query("op2_url_filters", f"""
with cut as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
parsed as (
  select page_id, url,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
tokens as (
  select page_id, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(string_split_regex(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'p:' || x))) as tokens
  from parsed),
wanted as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
fit as (select t.page_id, t.tokens, w.bad from tokens t join wanted w on w.doc_id = t.page_id),
fit_size as (select greatest({MIN_ROWS}, cast(ceil(count(*) * {MIN_SUPPORT}) as bigint)) as least from fit),
exploded as (select page_id, bad, unnest(tokens) as token from fit),
frequent as (select token, count(*) as n from exploded group by token having count(*) >= (select least from fit_size)),
baskets as (select e.page_id, e.bad, e.token from exploded e join frequent f on f.token = e.token),
sets as ({_rule_sql(1)} union all {_rule_sql(2)} union all {_rule_sql(3)}),
rules as (select tokens, support, support / cast(n as double) as confidence from sets where support / cast(n as double) >= {MIN_CONFIDENCE}),
kept as (
  select * from rules r where not exists (
    select 1 from rules s where len(s.tokens) < len(r.tokens) and list_has_all(r.tokens, s.tokens) and s.confidence >= r.confidence)),
hits as (
  select t.page_id, k.tokens, k.confidence,
    row_number() over (partition by t.page_id order by k.confidence desc, k.tokens desc) as r
  from tokens t join kept k on list_has_all(t.tokens, k.tokens)),
judged as (
  select p.page_id, p.host, p.path, case {_RULES} end as fixed, array_to_string(h.tokens, ' ') as mined_rule, h.confidence as confidence
  from parsed p left join hits h on h.page_id = p.page_id and h.r = 1)
select page_id, host, path, split_part(fixed, '|', 1) as rule,
  coalesce(split_part(fixed, '|', 2), case when mined_rule is not null then 'block' else 'allow' end) as verdict,
  mined_rule, round(confidence, 6) as confidence
from judged""")
def op2(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    rules = url_rules.mine_rules(
        pages.join(labels, "page_id"), "url", F.col("bad") == 1, min_support=MIN_SUPPORT, min_rows=MIN_ROWS,
        min_confidence=MIN_CONFIDENCE)
    judged = url_rules.judge_urls(pages, rules, url_rules.FIXED_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule", F.round("confidence", 6).alias("confidence"))


TOXIC_FROM = 0.5


@query("op3_toxicity")
def op3(spark, sf):
    docs = table(spark, sf, "documents")
    scorer = toxicity.learn(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs, scorer, keep=["doc_id"])
    return scored.select(
        "doc_id", *[F.round("p_" + c, 9).alias("p_" + c) for c in toxicity.CATEGORIES],
        (F.col("p_toxic") >= TOXIC_FROM).cast("int").alias("is_toxic"))


@query("op4_line_dedup", r"""
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
numbered as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from split),
keyed as (
  select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from numbered),
common as (select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (
  select k.doc_id, k.pos, k.line, c.key is not null and c.keeper <> k.doc_id as gone from keyed k left join common c on c.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id""")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, min_chars=20, min_docs=3).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op5_byte_level_bpe")
def op5(spark, sf):
    coded = bpe.encode_and_decode(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


SWEEPS, TEMPER, KEEP = 8, 0.9, 0.7


def _mixing_sql() -> str:
    steps = ["c0 as (select source, lang, topic, tokens, cast(tokens as double) as weight from cells)"]
    last = "c0"
    for sweep in range(SWEEPS):
        for m in mixing.MARGINS:
            name = f"s{sweep}_{m}"
            steps.append(
                f"{name} as (select c.source, c.lang, c.topic, c.tokens, case when s.total > 0 then c.weight * (coalesce(t.target, 0) / s.total) else 0 end as weight "
                f"from {last} c join (select {m}, sum(weight) as total from {last} group by {m}) s on s.{m} = c.{m} left join target_{m} t on t.{m} = c.{m})")
            last = name
    targets = ", ".join(
        f"share_{m} as (select {m}, pow(cast(sum(tokens) as double), {TEMPER}) as p from cells group by {m} having sum(tokens) > 0), "
        f"target_{m} as (select {m}, p / (select sum(p) from share_{m}) as target from share_{m})" for m in mixing.MARGINS)
    return f"""
with named as (
  select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang,
    case when contains(lower(coalesce(text, '')), 'license') or contains(lower(coalesce(text, '')), 'copyright') then 'legal'
      when (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '%*$#&', ''))) * 20 > length(coalesce(text, '')) then 'noisy'
      when contains(coalesce(text, ''), '://') then 'links' when contains(coalesce(text, ''), '@') then 'contact' else 'prose' end as topic,
    len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')) as tokens
  from documents),
cells as (select source, lang, topic, cast(sum(tokens) as bigint) as tokens from named group by 1, 2, 3),
{targets},
{", ".join(steps)},
ratios as (select *, case when tokens > 0 then weight / tokens end as ratio from {last}),
-- with the k largest ratios kept whole, the others share what is left; the first k at which none of them would pass 1
steps as (select ratio, sum(tokens) over () as whole, coalesce(sum(tokens) over above, 0) as capped, sum(weight) over rest as weight
  from ratios where tokens > 0 window above as (order by ratio desc, source, lang, topic rows between unbounded preceding and 1 preceding),
  rest as (order by ratio desc, source, lang, topic rows between current row and unbounded following)),
scale as (select max(({KEEP} * whole - capped) / weight) filter (({KEEP} * whole - capped) / weight * ratio < 1) as c from steps where weight > 0),
rates as (select source, lang, topic, coalesce(least(1.0, ratio * c), case when ratio > 0 or ratio is null then 1.0 else 0.0 end) as rate from ratios, scale)
select n.doc_id, r.source, r.lang, r.topic, round(r.rate, 6) as rate
from named n join rates r on r.source = n.source and r.lang = n.lang and r.topic = n.topic
where cast(concat('0x', substr(md5(concat('mix:', cast(n.doc_id as varchar))), 1, 8)) as bigint) / 4294967296.0 < r.rate"""


@query("op6_mix_sources", _mixing_sql())
def op6(spark, sf):
    docs = table(spark, sf, "documents").withColumn("topic", mixing.topic_of(F.col("text")))
    kept = mixing.mix(docs, topic=F.col("topic"), temper=TEMPER, sweeps=SWEEPS, keep=KEEP)
    return kept.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "topic", F.round("rate", 6).alias("rate"))


@query("op7_html_text")
def op7(spark, sf):
    return html_text.extract_text(table(spark, sf, "pages"), keep=["page_id", "url"])


@query("op8_minhash_near_duplicates")
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return neardup.mark_near_duplicates(docs, threshold=0.8).select("doc_id", "class_id", F.col("is_first").cast("int").alias("is_first"))


@query("op9_token_files")
def op9(spark, sf):
    folder = huffman.store_ids(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return huffman.read_digests(spark, folder)


@query("op10_nearest_neighbours")
def op10(spark, sf):
    return hnsw.nearest(table(spark, sf, "embeddings"), k=20, every=20)


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op11_spelling_variants", f"""
with recursive
steps(i, k, c) as (
  select i, 0, i from range(256) r(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
crc_table as (select i, c from steps where k = 8),
found as (
  select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) as run from documents),
pairs as (select doc_id, translate(run, {_LOWER}) as run, count(*) as n from found group by 1, 2),
numbered as (select row_number() over () as pair, run, n, hex(encode(concat(doc_id, ':', run))) as bytes from pairs),
crc(pair, bytes, pos, c) as (
  select pair, bytes, 0, 4294967295 from numbered
  union all
  select r.pair, r.bytes, r.pos + 2, xor(t.c, r.c >> 8)
  from crc r join crc_table t on t.i = xor(r.c & 255, cast('0x' || substr(r.bytes, r.pos + 1, 2) as bigint))
  where r.pos < length(r.bytes)),
hashed as (select pair, xor(c, 4294967295) as h from crc where pos = length(bytes)),
damaged as (
  select n, case when h % 199 = 0 then concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) else run end as word
  from numbered join hashed using (pair)),
words as (select word, cast(sum(n) as bigint) as n from damaged where length(word) >= 6 group by word having sum(n) >= 5),
cuts as (
  select word, n, pos, concat(substr(word, 1, pos), substr(word, pos + 2)) as rest
  from (select word, n, unnest(range(length(word))) as pos from words)),
near as (
  select a.word, a.n, b.word as other, b.n as other_n from cuts a join cuts b on a.rest = b.rest and a.pos = b.pos and a.word <> b.word
  union select a.word, a.n, b.word, b.n from cuts a join words b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from cuts a join words b on a.rest = b.word),
best as (
  select word, n, other, other_n, count(*) over (partition by word) as n_near,
    row_number() over (partition by word order by other_n desc, other) as r from near),
judged as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.other_n >= 5 * w.n then b.other end as form,
    case when b.other_n >= 5 * w.n then b.other_n end as form_n
  from words w left join best b on b.word = w.word and b.r = 1),
chain(word, root, depth) as (
  select word, word, 0 from judged
  union all select c.word, j.form, c.depth + 1 from chain c join judged j on j.word = c.root where j.form is not null),
last as (select word, arg_max(root, depth) as root from chain group by word)
select j.word, j.form, l.root, j.n, j.n_near, j.form_n from judged j join last l on l.word = j.word""")
def op11(spark, sf):
    return spelling.group_spellings(table(spark, sf, "documents"), min_chars=6, min_count=5, ratio=5, damage=199)


@query("op12_substring_dedup", r"""
with split as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
windows as (
  select doc_id, w.pos, array_to_string(words[w.pos : w.pos + 12], ' ') as win
  from split, lateral (select unnest(range(1, len(words) - 11)) as pos) w),
earliest as (select win, min(doc_id) as doc_id from windows group by win),
hits as (select w.doc_id, w.pos from windows w join earliest e on e.win = w.win and e.doc_id < w.doc_id),
gone as (select distinct doc_id, unnest(range(pos, pos + 13)) as pos from hits),
each as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from split),
kept as (select e.doc_id, string_agg(e.word, ' ' order by e.pos) as text from each e anti join gone g on g.doc_id = e.doc_id and g.pos = e.pos group by e.doc_id),
counts as (select doc_id, count(*) as n from gone group by doc_id)
select s.doc_id, cast(len(s.words) as bigint) as n_words, coalesce(c.n, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from split s left join kept k on k.doc_id = s.doc_id left join counts c on c.doc_id = s.doc_id""")
def op12(spark, sf):
    kept = substrings.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), words=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op13_phrase_collocations", f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) as piece from documents),
split as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as words from pieces),
totals as (select lang, cast(sum(len(words)) as bigint) as n from split group by lang),
grams as (
  select lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i : i + size - 1], ' '))) as phrase
  from split, (select unnest([1, 2, 3]) as size) sizes where len(words) >= size),
f as (select lang, size, phrase, count(*) as f from grams group by 1, 2, 3 having count(*) >= 10),
candidates as (select lang, size, phrase, f as a, string_split(phrase, ' ') as words from f where size > 1),
cuts as (
  select c.lang, c.phrase, c.a, k, array_to_string(c.words[1 : k], ' ') as before, array_to_string(c.words[k + 1 : c.size], ' ') as after
  from candidates c, (select unnest([1, 2]) as k) ks where k < c.size),
scored as (
  select c.*, l.f as l, r.f as r, cast((cast(1000000 as hugeint) * c.a * c.a) // (cast(l.f as hugeint) * r.f) as bigint) as score
  from cuts c join f l on l.lang = c.lang and l.phrase = c.before join f r on r.lang = c.lang and r.phrase = c.after),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as nth from scored),
inner_parts as (
  select lang, array_to_string(words[1 : 2], ' ') as phrase, a from candidates where size = 3
  union all select lang, array_to_string(words[2 : 3], ' '), a from candidates where size = 3),
around as (select lang, phrase, max(a) as around from inner_parts group by 1, 2),
kept as (
  select s.lang, s.phrase, s.a, s.l, s.r, s.score from lowest s left join around x on x.lang = s.lang and x.phrase = s.phrase
  where s.nth = 1 and (x.around is null or 100 * x.around < 50 * s.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score from ranked r join totals t on t.lang = r.lang where r.rank <= 2000""")
def op13(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"), longest=3, min_count=10, inside_percent=50, scale=1_000_000, top=2000)
