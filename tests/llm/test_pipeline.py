import corpus_pipeline as p
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
from tests.llm.test_search_and_pairs import brute_classes
from tests.llm.test_texts import brute_lines, tiktoken_encoding


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """What each stage got and gave."""
    folder, out = tmp_path_factory.mktemp("pipeline"), []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_the_columns_and_only_drop_documents(steps):
    for before, after in steps[:-1]:
        assert after.columns == p.COLUMNS
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "mix_sources", "byte_level_bpe"]


def test_toxicity_stage_drops_few_and_changes_nothing(spark, sf, steps):
    before, after = steps[0]
    clean = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").select("doc_id")
    assert before.join(clean, "doc_id").count() == after.join(clean, "doc_id").count()
    assert after.subtract(before).count() == 0 and 0 < before.count() - after.count() < 0.2 * before.count()


def test_line_stage_agrees_with_brute_force(steps):
    before, after = steps[1]
    want = {(d, t) for d, t, *_ in brute_lines(before.collect())}
    assert {(r["doc_id"], r["text"]) for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_duplicate_stage_agrees_with_all_pairs(steps):
    before, after = steps[2]
    rows = sorted(before.collect(), key=lambda r: r["doc_id"])
    keep = {rows[i]["doc_id"] for i in set(brute_classes([r["text"] for r in rows]))}
    assert {r["doc_id"] for r in after.collect()} == keep and after.count() == len(keep)


def test_mixing_stage_is_repeatable(spark, sf, steps):
    before, after = steps[3]
    assert sorted(r["doc_id"] for r in p.mix_sources(spark, before, sf).collect()) == sorted(r["doc_id"] for r in after.collect())
    assert after.subtract(before).count() == 0 and after.count() > 0.3 * before.count()


def test_one_stray_row_does_not_thin_the_mix(spark, sf, steps):
    before, after = steps[3]
    stray = spark.createDataFrame([(-1, "three small words", None, None, 17)], before.schema)
    n = p.mix_sources(spark, before.unionByName(stray), sf).count()
    assert n > 0.6 * before.count() and abs(n - after.count()) < 0.05 * before.count()


def test_last_stage_agrees_with_tiktoken(steps):
    before, after = steps[4]
    enc, text = tiktoken_encoding(), {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["decodes"] and np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(text[r["doc_id"]])
    assert after.count() == before.count() and public_tokenizers.PATTERN


def test_all_eleven_are_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10))
