import hashlib
import re

import pytest
from pyspark.sql import functions as F

from statloom.operators import pii, profile, roles


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, 1.5, "a", "5", True, None), (2, float("nan"), None, "x", False, None), (2, float("nan"), None, "x", False, None)]
    return spark.createDataFrame(rows, "id long, v double, t string, m string, b boolean, e double")


def test_profile_counts_nan_as_missing(mixed):
    got = {r["name"]: r for r in profile.column_profile(mixed, {}).collect()}
    assert got["v"]["null_count"] == 2 and got["v"]["unique_count"] == 1
    assert got["e"]["unique_count"] == 0 and got["e"]["null_rate"] == 1.0
    assert got["b"]["role"] == "boolean"
    approx = {r["name"]: r["unique_count"] for r in profile.column_profile(mixed, {}, approx=True).collect()}
    assert approx["id"] == 2


def test_profile_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "a long, b string")
    got = profile.column_profile(df, {}).collect()
    assert [r["null_rate"] for r in got] == [None, None]
    assert profile.duplicate_rows(df).first()["row_count"] == 0
    assert profile.describe(df, {}).first()["count"] == 0


def test_duplicates_and_quality(mixed):
    assert profile.duplicate_rows(mixed).first()["duplicate_rows"] == 1
    flags = {r["name"]: r for r in profile.quality_issues(mixed).collect()}
    assert flags["m"]["mixed_types"] and not flags["t"]["mixed_types"]
    assert flags["v"]["many_nulls"] and not flags["id"]["many_nulls"]


def test_roles_and_levels(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    used = roles.analysis_roles(part, max_levels=20)
    assert "p_type" in used.categorical and "p_name" not in used.categorical
    constant = spark.range(5).selectExpr("id", "cast(1 as int) as one")
    assert roles.analysis_roles(constant).numeric == ["id"]
    with pytest.raises(ValueError):
        roles.classify_data(constant.select("one"))


def test_names_are_matched_whole():
    assert pii.pii_type_of_name("  Email ") == "email"
    assert pii.pii_type_of_name("c_name") is None
    assert pii.pii_type_of_name("City") == "address"


def test_content_share_must_pass_thirty_percent(spark):
    rows = [(f"u{i}@example.com" if i < 3 else "none", f"u{i}@example.com" if i < 4 else "none") for i in range(10)]
    got = pii.pii_map(spark.createDataFrame(rows, "three string, four string"))
    assert got == {"four": "email"}


def test_masks_follow_the_rules_and_hide_the_input(spark):
    values = ["john.doe@mail.example.com", "see a@b.org now", "no address here", "Zoë Ångström", "+1 (555) 123-4567", "12", ""]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    got = df.select("v", *[pii.MASKS.get(k, pii.mask_generic)(F.col("v")).alias(k) for k in
                           ("email", "phone", "ssn", "credit_card", "name", "address")]).collect()
    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
    for r in got[:-1]:
        v = r["v"]
        digits = re.sub(r"\D", "", v)
        found = re.search(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", v)
        if found:
            local, domain = found.group().split("@")
            assert r["email"] == f"{local[0]}***@{domain[0]}***.{domain.split('.')[-1]}"
        else:
            assert r["email"] == f"[EMAIL_{sha(v)[:6]}]"
        assert r["phone"] == (f"***-***-{digits[-4:]}" if len(digits) >= 4 else "[PHONE_REDACTED]")
        assert r["ssn"] == (f"***-**-{digits[-4:]}" if len(digits) >= 4 else "[SSN_REDACTED]")
        assert r["credit_card"] == (f"****-****-****-{digits[-4:]}" if len(digits) >= 4 else "[CC_REDACTED]")
        assert r["name"] == f"PERSON_{sha(v)[:8]}"
        assert r["address"] == f"[REDACTED_{sha(v)[:6]}]"
        if len(v) > 4:
            assert all(v not in r[k] for k in ("email", "phone", "name", "address"))
    masked = pii.mask_columns(df, {"v": "name"}).collect()
    assert masked[-1]["v"] is None
    assert pii.mask_columns(df, {"v": "name"}, salt="s").first()["v"] != masked[0]["v"]


def test_float_phone_keeps_its_digits(spark):
    df = spark.createDataFrame([(5551234567.0,)], "phone double")
    assert pii.mask_columns(df, {"phone": "phone"}).first()["phone"] == "***-***-4567"


def test_samples_are_redacted(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(9)], "id long, name string")
    got = profile.sample_values(df, ["id"]).collect()
    assert [r["value"] for r in got if r["name"] == "name"] == ["[personal name detected]"] * 3
    assert [r["value"] for r in got if r["name"] == "id"] == ["0", "1", "2", "3", "4"]


def test_masking_runs_on_a_stream(spark, tmp_path):
    from statloom.streaming.masking import start_masked_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "Ann"), (2, None)], "id long, name string").write.parquet(src)
    stream = spark.readStream.schema("id long, name string").parquet(src)
    start_masked_stream(stream, {"name": "name"}, out, "people").awaitTermination()
    got = {r["id"]: r["name"] for r in spark.read.parquet(out).collect()}
    assert got[2] is None and got[1] == "PERSON_" + hashlib.sha256(b"Ann").hexdigest()[:8]
