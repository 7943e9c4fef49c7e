"""Detection and masking of personal data; column expressions only.

Masking is stateless per row, so it also runs on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.frames import chunks, col, empty, is_text, local_table, union_all

# What counts as an e-mail address, phone number, SSN, card number, IP address.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(?:\+?\d{1,3}[\s\-]?)?(?:\(?\d{2,4}\)?[\s\-]?)?\d{3,5}[\s\-]?\d{3,5}"
SSN_PATTERN = r"\b\d{3}[\-\s]?\d{2}[\-\s]?\d{4}\b"
CREDIT_CARD_PATTERN = r"\b(?:\d{4}[\s\-]?){3}\d{4}\b"
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"

# Column names (lower case) that mark a PII type; the first type that lists a name wins.
PII_COLUMN_NAMES = {
    "email": ["email", "e_mail", "e-mail", "email_address", "emailaddress"],
    "phone": ["phone", "telephone", "mobile", "cell", "contact_number", "phone_number"],
    "name": ["name", "first_name", "last_name", "full_name", "firstname", "lastname",
             "fullname", "patient_name", "customer_name", "employee_name", "user_name"],
    "ssn": ["ssn", "social_security", "social_security_number", "sin"],
    "address": ["address", "street", "city", "zip", "zipcode", "zip_code", "postal",
                "postal_code", "state", "country"],
    "dob": ["dob", "date_of_birth", "birth_date", "birthdate", "birthday"],
    "credit_card": ["credit_card", "card_number", "cc_number", "ccnumber"],
    "ip": ["ip", "ip_address", "ipaddress"],
    "password": ["password", "passwd", "pwd", "secret", "token", "api_key"],
}

# Texts shown in place of sample values.
PLACEHOLDERS = {
    "email": "[email detected]",
    "phone": "[phone number detected]",
    "ssn": "[SSN detected]",
    "credit_card": "[credit card detected]",
    "name": "[personal name detected]",
    "address": "[address detected]",
    "dob": "[date of birth detected]",
    "ip": "[IP address detected]",
    "password": "[sensitive credential detected]",
}
UNKNOWN_PLACEHOLDER = "[PII detected]"

HIT_SHARE = 0.3
CONTENT_ORDER = ["email", "ssn", "credit_card", "ip", "phone"]


def pii_type_of_name(name: str) -> str | None:
    clean = name.lower().strip()
    return next((t for t, names in PII_COLUMN_NAMES.items() if clean in names), None)


def _whole(pattern: str) -> str:
    return r"(?U)\A\s*(?:" + pattern + r")\s*\z"


CONTENT_TESTS = {
    "email": EMAIL_PATTERN,
    "ssn": _whole(SSN_PATTERN),
    "credit_card": _whole(CREDIT_CARD_PATTERN),
    "ip": _whole(IP_PATTERN),
    "phone": _whole(PHONE_PATTERN),
}


def content_hits(df: DataFrame, cols: list[str] | None = None, sample_size: int | None = None,
                 order_by: list[str] | None = None) -> DataFrame:
    """(column, email, ssn, credit_card, ip, phone): share of values of each kind.

    One aggregate per eight columns.  By default every value counts;
    `sample_size` with `order_by` looks at the first rows only, ties by value.
    """
    spark = df.sparkSession
    if cols is None:
        cols = [f.name for f in df.schema.fields if is_text(f.dataType)]
    schema = "column string, " + ", ".join(f"{t} double" for t in CONTENT_ORDER)
    if not cols:
        return empty(spark, schema)
    if sample_size is None:
        return union_all([_hit_row(df, part) for part in chunks(cols, 8)])
    if not order_by:
        raise ValueError("sample_size needs order_by: the first rows of an unordered table are not defined")
    return union_all([
        _hit_row(df.where(col(c).isNotNull()).orderBy(*[col(o) for o in order_by], col(c)).limit(sample_size), [c])
        for c in cols
    ])


def _hit_row(df: DataFrame, cols: list[str]) -> DataFrame:
    aggs = [
        F.avg(F.when(col(c).isNotNull(), col(c).rlike(CONTENT_TESTS[t]).cast("double"))).alias(f"h{i}_{t}")
        for i, c in enumerate(cols) for t in CONTENT_ORDER
    ]
    structs = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"h{i}_{t}").alias(t) for t in CONTENT_ORDER])
        for i, c in enumerate(cols)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def detect_pii(df: DataFrame, sample_size: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """(column, pii_type, source, hit_rate): names first, then text content."""
    spark = df.sparkSession
    named = {c: pii_type_of_name(c) for c in df.columns}
    by_name = local_table(
            spark, [(c, t, "name", None) for c, t in named.items() if t],
        "column string, pii_type string, source string, hit_rate double",
    )
    rest = [f.name for f in df.schema.fields if is_text(f.dataType) and not named[f.name]]
    if not rest:
        return by_name
    hits = content_hits(df, rest, sample_size, order_by)
    kind, rate = None, None
    for t in CONTENT_ORDER:
        over = F.col(t) > HIT_SHARE
        kind = F.when(over, F.lit(t)) if kind is None else kind.when(over, F.lit(t))
        rate = F.when(over, F.col(t)) if rate is None else rate.when(over, F.col(t))
    by_content = hits.select(
        "column", kind.alias("pii_type"), F.lit("content").alias("source"), rate.alias("hit_rate")
    ).where("pii_type is not null")
    return by_name.unionByName(by_content)


def pii_map(df: DataFrame, **options) -> dict[str, str]:
    found = {r["column"]: r["pii_type"] for r in detect_pii(df, **options).collect()}
    return {c: found[c] for c in df.columns if c in found}


# --- masking ---------------------------------------------------------------

def as_text(df: DataFrame, name: str) -> Column:
    """The value as text; integral doubles lose their '.0' so digits do not shift."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 9e15)
        return F.when(F.isnan(c), None).when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def _hash(v: Column, length: int, salt: str | None) -> Column:
    salted = F.concat(F.lit(salt), v) if salt else v
    return F.substring(F.sha2(salted, 256), 1, length)


def _last_four(v: Column, shown: str, redacted: str) -> Column:
    digits = F.regexp_replace(v, r"(?U)\D", "")
    return F.when(F.length(digits) >= 4, F.concat(F.lit(shown), F.right(digits, F.lit(4)))).otherwise(redacted)


def mask_email(v: Column, salt: str | None = None) -> Column:
    found = F.regexp_extract(v, EMAIL_PATTERN, 0)
    domain = F.split_part(found, F.lit("@"), F.lit(2))
    first = F.split_part(domain, F.lit("."), F.lit(1))
    masked = F.concat(
        F.substring(found, 1, 1), F.lit("***@"), F.substring(first, 1, 1), F.lit("***."),
        F.split_part(domain, F.lit("."), F.lit(-1)),
    )
    return F.when(found != "", masked).otherwise(F.concat(F.lit("[EMAIL_"), _hash(v, 6, salt), F.lit("]")))


def mask_phone(v: Column, salt: str | None = None) -> Column:
    return _last_four(v, "***-***-", "[PHONE_REDACTED]")


def mask_ssn(v: Column, salt: str | None = None) -> Column:
    return _last_four(v, "***-**-", "[SSN_REDACTED]")


def mask_credit_card(v: Column, salt: str | None = None) -> Column:
    return _last_four(v, "****-****-****-", "[CC_REDACTED]")


def mask_name(v: Column, salt: str | None = None) -> Column:
    return F.concat(F.lit("PERSON_"), _hash(v, 8, salt))


def mask_generic(v: Column, salt: str | None = None) -> Column:
    return F.concat(F.lit("[REDACTED_"), _hash(v, 6, salt), F.lit("]"))


MASKS = {
    "email": mask_email,
    "phone": mask_phone,
    "ssn": mask_ssn,
    "credit_card": mask_credit_card,
    "name": mask_name,
}


def mask_columns(df: DataFrame, types: dict[str, str], salt: str | None = None) -> DataFrame:
    """Replace the listed columns by masked text; nulls stay null.

    Unsalted hashes can be linked by a dictionary of likely values; pass `salt`
    where that matters.
    """
    changed = {}
    for name, kind in types.items():
        if name in df.columns:
            text = as_text(df, name)
            changed[name] = F.when(text.isNotNull(), MASKS.get(kind, mask_generic)(text, salt))
    return df.withColumns(changed) if changed else df


def masking_summary(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """(line, text): the human-readable summary of detected columns, one line per row."""
    types = pii_map(df) if types is None else types
    if types:
        lines = [f"Detected {len(types)} PII column(s):"]
        lines += [f"  - {c}: {t}" for c, t in types.items()]
        lines.append("These columns have been masked to prevent data leakage.")
    else:
        lines = ["No PII detected."]
    return local_table(df.sparkSession, list(enumerate(lines)), "line int, text string")


def placeholder(kind: str) -> str:
    return PLACEHOLDERS.get(kind, UNKNOWN_PLACEHOLDER)
