"""Profile and PII queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import DIRTY_SQL, PEOPLE_SQL, dirty_orders, people, query, rd, rounded, table
from statloom.operators import pii, profile, roles

DIRTY_COLS = [
    ("o_orderkey", "bigint", "numeric"), ("o_totalprice", "double", "numeric"), ("o_orderpriority", "string", "categorical"),
    ("o_orderstatus", "string", "categorical"), ("custkey_text", "string", "categorical"),
    ("orderdate_text", "string", "categorical"), ("empty_col", "double", "numeric"),
]
PROFILE_ARMS = " union all ".join(
    f"select {i} as position, '{c}' as name, '{t}' as dtype, '{r}' as role, count(*) - count({c}) as null_count, "
    f"count(distinct {c}) as unique_count, {rd(f'(count(*) - count({c})) / cast(count(*) as double)')} as null_rate, "
    f"cast(null as varchar) as pii_type from dirty_orders"
    for i, (c, t, r) in enumerate(DIRTY_COLS)
)


@query("column_profile", f"with {DIRTY_SQL} {PROFILE_ARMS}")
def column_profile(spark, sf):
    return rounded(profile.column_profile(dirty_orders(spark, sf)))


HIDDEN = {"name": "[personal name detected]", "email": "[email detected]", "phone": "[phone number detected]",
          "ref_a": "[SSN detected]", "ref_b": "[credit card detected]", "ref_c": "[IP address detected]",
          "contact": "[email detected]"}
SAMPLE_ARMS = " union all ".join(
    f"select '{c}' as name, cast(row_number() over (order by id) as integer) as sample_no, "
    + (f"'{HIDDEN[c]}'" if c in HIDDEN else f"cast({c} as varchar)") + " as value "
    f"from (select * from people order by id limit {3 if c in HIDDEN else 5})"
    for c in ["id", "name", "email", "phone", "ref_a", "ref_b", "ref_c", "contact", "segment"]
)


@query("sample_values", f"with {PEOPLE_SQL} {SAMPLE_ARMS}")
def sample_values(spark, sf):
    return profile.sample_values(people(spark, sf), ["id"])


@query("table_summary", f"""
with {DIRTY_SQL}
select (select count(*) from dirty_orders) as row_count, 7 as columns_count,
       (select count(*) from dirty_orders) - (select count(*) from (select distinct * from dirty_orders)) as duplicate_rows,
       0 as pii_columns, '' as pii_detected""")
def table_summary(spark, sf):
    return profile.table_summary(dirty_orders(spark, sf))


@query("table_summary_with_pii", f"""
with {PEOPLE_SQL}
select count(*) as row_count, 9 as columns_count, cast(0 as bigint) as duplicate_rows, 7 as pii_columns,
       'contact:email, email:email, name:name, phone:phone, ref_a:ssn, ref_b:credit_card, ref_c:ip' as pii_detected
from people""")
def table_summary_with_pii(spark, sf):
    return profile.table_summary(people(spark, sf))


@query("duplicate_rows", """
select count(*) as row_count, (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as distinct_rows,
       count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as duplicate_rows
from lineitem""")
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe", " union all ".join(
    f"select '{c}' as name, count({c}) as count, {rd(f'avg({c})', 4)} as mean, {rd(f'stddev_samp({c})', 4)} as std, "
    f"{rd(f'cast(min({c}) as double)', 4)} as min, "
    + ", ".join(f"{rd(f'quantile_cont(cast({c} as double), {p})', 4)} as {a}"
                for p, a in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    + f", {rd(f'cast(max({c}) as double)', 4)} as max from lineitem" for c in LINE_NUM))
def describe(spark, sf):
    return rounded(profile.describe(table(spark, sf, "lineitem")), 4)


@query("describe_skips_pii", f"""
with {PEOPLE_SQL}
select 'id' as name, count(id) as count, {rd('avg(id)', 4)} as mean, {rd('stddev_samp(id)', 4)} as std,
       cast(min(id) as double) as min, quantile_cont(cast(id as double), 0.25) as p25,
       quantile_cont(cast(id as double), 0.5) as p50, quantile_cont(cast(id as double), 0.75) as p75,
       cast(max(id) as double) as max
from people""")
def describe_skips_pii(spark, sf):
    # a numeric phone column must not show its range
    df = people(spark, sf).withColumn("phone", F.regexp_replace("phone", "-", "").cast("double"))
    return rounded(profile.describe(df), 4)


def _top(source: str, cols: list[str], k: int) -> str:
    arms = " union all ".join(f"select '{c}' as name, {c} as value, count(*) as n from {source} where {c} is not null group by {c}"
                              for c in cols)
    return (f"select name, cast(position as integer) as position, value, n from (select *, row_number() over "
            f"(partition by name order by n desc, value) as position from ({arms})) where position <= {k}")


@query("top_categories", _top("orders", ["o_orderstatus", "o_orderpriority"], 5))
def top_categories(spark, sf):
    return profile.top_categories(table(spark, sf, "orders"))


@query("top_categories_redacted", f"with {PEOPLE_SQL} " + _top("people", ["segment"], 5) + " union all " + " union all ".join(
    f"select '{c}', 1, '[PII REDACTED - {t}]', null" for c, t in
    (("name", "name"), ("email", "email"), ("phone", "phone"), ("ref_a", "ssn"), ("ref_b", "credit_card"),
     ("ref_c", "ip"), ("contact", "email"))))
def top_categories_redacted(spark, sf):
    return profile.top_categories(people(spark, sf))


PART = [("p_partkey", "bigint", "numeric"), ("p_name", "string", "categorical"), ("p_brand", "string", "categorical"),
        ("p_type", "string", "categorical"), ("p_size", "int", "numeric"), ("p_retailprice", "double", "numeric")]


def _roles_sql(lo: int, hi: int) -> str:
    return " union all ".join(
        f"select {i} as position, '{c}' as name, '{t}' as dtype, '{r}' as role, "
        + (f"min({c}) < max({c})" if r == "numeric" else f"count(distinct {c}) between {lo} and {hi}")
        + " as used from part" for i, (c, t, r) in enumerate(PART))


@query("column_roles", _roles_sql(0, 50))
def column_roles(spark, sf):
    return roles.role_table(table(spark, sf, "part"))


@query("column_roles_for_findings", _roles_sql(2, 20))
def column_roles_for_findings(spark, sf):
    return roles.role_table(table(spark, sf, "part"), max_levels=20, min_levels=2)


@query("data_classification", """
select 8 as numeric_columns, 2 as categorical_columns, cast(0.8 as double) as numeric_ratio,
       case when 0.8 > 0.7 then 'mostly numeric' else 'mixed' end as classification
from (select min(l_tax) < max(l_tax) as varies, count(distinct l_returnflag) as flags from lineitem) where varies and flags <= 50""")
def data_classification(spark, sf):
    return roles.classify_data(table(spark, sf, "lineitem"))


def _issue(c: str, t: str) -> str:
    rate = f"(count(*) - count({c})) / cast(count(*) as double)"
    mixed = dated = whole = "false"
    if t == "string":
        num = f"avg(case when {c} is not null then cast(try_cast({c} as double) is not null as integer) end)"
        mixed = f"coalesce({num} > 0 and {num} < 1, false)"
        dated = (f"coalesce(avg(case when {c} is not null then cast(try_cast({c} as timestamp) is not null "
                 f"and try_cast({c} as double) is null as integer) end) = 1, false)")
    if t == "double":
        whole = f"coalesce(avg(cast({c} = floor({c}) as integer)) = 1, false)"
    return (f"select '{c}' as name, {rd(rate)} as null_rate, {rate} > 0.3 as many_nulls, {mixed} as mixed_types, "
            f"{whole} as float_ids, {dated} as text_dates from dirty_issues")


@query("quality_issues", f"with {DIRTY_SQL}, dirty_issues as (select *, cast(o_orderkey as double) as key_float from dirty_orders) "
       + " union all ".join(_issue(c, t) for c, t, _ in [*DIRTY_COLS, ("key_float", "double", "numeric")]))
def quality_issues(spark, sf):
    df = dirty_orders(spark, sf)
    return rounded(profile.quality_issues(df.withColumn("key_float", F.col("o_orderkey").cast("double"))))


# --- PII ---------------------------------------------------------------------

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
FULL = {
    "ssn": r"\b\d{3}[\-\s]?\d{2}[\-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[\s\-]?){3}\d{4}\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "phone": r"(?:\+?\d{1,3}[\s\-]?)?(?:\(?\d{2,4}\)?[\s\-]?)?\d{3,5}[\s\-]?\d{3,5}",
}


def _hits(source: str, c: str) -> str:
    share = lambda test: rd(f"avg(cast({test} as integer))")
    full = ", ".join(f"{share(f'''regexp_full_match(trim({c}), '{p}')''')} as {t}" for t, p in FULL.items())
    return f"select '{c}' as \"column\", {share(f'''regexp_matches({c}, '{EMAIL}')''')} as email, {full} from {source}"


PEOPLE_TEXT = ["name", "email", "phone", "ref_a", "ref_b", "ref_c", "contact", "segment"]


@query("pii_content_shares", f"with {PEOPLE_SQL} " + " union all ".join(_hits("people", c) for c in PEOPLE_TEXT))
def pii_content_shares(spark, sf):
    return rounded(pii.content_hits(people(spark, sf)))


@query("pii_content_in_documents", " union all ".join(_hits("documents", c) for c in ("text", "lang", "source")))
def pii_content_in_documents(spark, sf):
    return rounded(pii.content_hits(table(spark, sf, "documents")))


@query("detect_pii", f"""
with {PEOPLE_SQL}
select * from (values ('name', 'name', 'name', cast(null as double)), ('email', 'email', 'name', null), ('phone', 'phone', 'name', null))
  v("column", pii_type, source, hit_rate)
union all select 'ref_a', 'ssn', 'content', {rd(f"avg(cast(regexp_full_match(ref_a, '{FULL['ssn']}') as integer))")} from people
union all select 'ref_b', 'credit_card', 'content', {rd(f"avg(cast(regexp_full_match(ref_b, '{FULL['credit_card']}') as integer))")} from people
union all select 'ref_c', 'ip', 'content', {rd(f"avg(cast(regexp_full_match(ref_c, '{FULL['ip']}') as integer))")} from people
union all select 'contact', 'email', 'content', {rd(f"avg(cast(regexp_matches(contact, '{EMAIL}') as integer))")} from people""")
def detect_pii(spark, sf):
    return rounded(pii.detect_pii(people(spark, sf)))


@query("detect_pii_first_rows", f"""
with {PEOPLE_SQL}, head as (select * from people order by id limit 200)
select 'contact' as "column", 'email' as pii_type, 'content' as source,
       {rd(f"avg(cast(regexp_matches(contact, '{EMAIL}') as integer))")} as hit_rate from head""")
def detect_pii_first_rows(spark, sf):
    """The sampled variant: the operator's own sample size, in id order."""
    df = people(spark, sf).select("id", "contact", "segment")
    return rounded(pii.detect_pii(df, sample_size=200, order_by=["id"]))


SQL_MASKS = {
    "email": r"case when regexp_extract({c}, '" + EMAIL + r"') <> '' then "
             r"substr(regexp_extract({c}, '" + EMAIL + r"'), 1, 1) || '***@' || "
             r"substr(split_part(split_part(regexp_extract({c}, '" + EMAIL + r"'), '@', 2), '.', 1), 1, 1) || '***.' || "
             r"regexp_extract(regexp_extract({c}, '" + EMAIL + r"'), '[a-zA-Z]+$') "
             r"else '[EMAIL_' || substr(sha256({c}), 1, 6) || ']' end",
    "phone": r"case when length(regexp_replace({c}, '\D', '', 'g')) >= 4 then '***-***-' || right(regexp_replace({c}, '\D', '', 'g'), 4) else '[PHONE_REDACTED]' end",
    "ssn": r"case when length(regexp_replace({c}, '\D', '', 'g')) >= 4 then '***-**-' || right(regexp_replace({c}, '\D', '', 'g'), 4) else '[SSN_REDACTED]' end",
    "credit_card": r"case when length(regexp_replace({c}, '\D', '', 'g')) >= 4 then '****-****-****-' || right(regexp_replace({c}, '\D', '', 'g'), 4) else '[CC_REDACTED]' end",
    "name": "'PERSON_' || substr(sha256({c}), 1, 8)",
    "generic": "'[REDACTED_' || substr(sha256({c}), 1, 6) || ']'",
}


def mask_sql(kind: str, c: str) -> str:
    return SQL_MASKS.get(kind, SQL_MASKS["generic"]).replace("{c}", c)


for _kind, _column in (("email", "contact"), ("phone", "phone"), ("ssn", "ref_a"), ("credit_card", "ref_b"),
                       ("name", "name"), ("address", "segment")):
    def _mask(spark, sf, kind=_kind, column=_column):
        df = people(spark, sf)
        mask = pii.MASKS.get(kind, pii.mask_generic)
        return df.select("id", mask(F.col(column)).alias("masked"))

    query(f"mask_{'generic' if _kind == 'address' else _kind}",
          f"with {PEOPLE_SQL} select id, {mask_sql(_kind, _column)} as masked from people")(_mask)


DETECTED = {"name": "name", "email": "email", "phone": "phone", "ref_a": "ssn", "ref_b": "credit_card",
            "ref_c": "ip", "contact": "email"}


@query("mask_table", f"with {PEOPLE_SQL} select id, "
       + ", ".join(f"{mask_sql(t, c)} as {c}" for c, t in DETECTED.items()) + ", segment from people")
def mask_table(spark, sf):
    df = people(spark, sf)
    return pii.mask_columns(df, pii.pii_map(df))


@query("mask_document_text", f"select doc_id, {mask_sql('email', 'text')} as text, source from documents")
def mask_document_text(spark, sf):
    return pii.mask_columns(table(spark, sf, "documents"), {"text": "email"}).select("doc_id", "text", "source")


@query("mask_float_phone", r"""
select c_custkey, '***-***-' || right(cast(5550000000 + c_custkey as varchar), 4) as phone from customer""")
def mask_float_phone(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") + F.lit(5550000000.0)).alias("phone"))
    return pii.mask_columns(df, {"phone": "phone"})


@query("masking_summary", f"""
with {PEOPLE_SQL}, n as (select count(*) as rows from people)
select cast(line as integer) as line, text from n, (values (0, 'Detected 7 PII column(s):'), (1, '  - name: name'),
  (2, '  - email: email'), (3, '  - phone: phone'), (4, '  - ref_a: ssn'), (5, '  - ref_b: credit_card'), (6, '  - ref_c: ip'),
  (7, '  - contact: email'), (8, 'These columns have been masked to prevent data leakage.')) v(line, text) where rows > 0""")
def masking_summary(spark, sf):
    return pii.masking_summary(people(spark, sf))
