"""Spelling variants, repeated passages and phrases against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statloom.llm import phrases, spelling, substrings
from statloom.llm.bitmaps import Bitmap, bitmap_of
from statloom.llm.fm_index import FmIndex
from statloom.llm.words import Words, byte_classes

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOW = -(2**63)


# ---- spelling -------------------------------------------------------------------------------------------------------

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows, min_chars=6, min_count=5, ratio=5, damage=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{LOW if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    by_cut = {}
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_cut.setdefault(x, set()).add(w)
    out, forms = {}, {}
    for w, n in words.items():
        around = {v for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in by_cut[x] if near(v, w)}
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= ratio * n else None
        forms[w] = form
        out[w] = (form, n, len(around), words[form] if form else None)
    rows = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, form, root, n, k, m))
    return rows


def test_spelling_agrees_with_brute_force(spark, docs, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for df, options in ((table, {}), (table, {"min_count": 2, "damage": 7, "ratio": 2}), (docs, {"min_count": 1, "min_chars": 2, "damage": 3})):
        got = {tuple(r) for r in spelling.group_spellings(df, **{"damage": 199, **options}).collect()}
        assert got == brute_spelling(map(tuple, df.select("doc_id", "text").collect()), **{"damage": 199, **options})


def test_near_words_of_a_crowded_key_in_small_blocks(spark):
    rng = np.random.default_rng(2)
    words = sorted({"abc" + "".join(rng.choice(list("abé"), rng.integers(2, 8))) + t for _ in range(700) for t in ("", "xyz")})
    vocabulary = spark.createDataFrame([(w, 1 + zlib.crc32(w.encode()) % 9) for w in words], "word string, n long")
    count = dict(map(tuple, vocabulary.collect()))
    got = {r["word"]: r for r in spelling.variants(vocabulary, block_words=16).collect()}
    assert len(got) == len(words)
    for w in words:
        around = [v for v in words if near(v, w)]
        assert got[w]["n_near"] == len(around)
        assert got[w]["near"] == min(around, key=lambda v: (-count[v], v), default=None)


def test_long_runs_ties_chains_and_empty_tables(spark, no_docs):
    assert spelling.group_spellings(no_docs).count() == 0
    long = "k" * 90
    text = " ".join(["abcdef"] * 1 + ["abcdeg"] * 5 + ["abcdeh"] * 5 + ["abcdehi"] * 25 + [long] * 3 + [long + "k"] * 6)
    df = spark.createDataFrame([(i, text) for i in range(4)] + [(None, "QBCDZZ ÉtéÉté "), (9, None)], "doc_id long, text string")
    got = {r["word"]: r for r in spelling.group_spellings(df, min_count=1, ratio=5).collect()}
    assert (got["abcdef"]["form"], got["abcdef"]["n_near"], got["abcdef"]["root"]) == ("abcdeg", 2, "abcdeg")
    assert (got["abcdeh"]["form"], got["abcdeh"]["form_n"]) == ("abcdehi", 100) and got["abcdehi"]["form"] is None
    assert "ÉtéÉté" in got and got[long]["n_near"] == 1
    assert {tuple(r) for r in spelling.group_spellings(df, damage=2).collect()} == brute_spelling(map(tuple, df.collect()), damage=2)
    with pytest.raises(ValueError):
        spelling.group_spellings(df, ratio=1)


# ---- repeated passages ----------------------------------------------------------------------------------------------

def brute_passages(rows, n=13):
    key = lambda d: LOW if d is None else d
    split = [(key(d), re.findall("[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - n + 1):
            x = tuple(w[i : i + n])
            least[x] = min(least.get(x, d), d)
    out = Counter()
    for (d, _), (k, w) in zip(rows, split):
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < k:
                gone.update(range(i, i + n))
        out[d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)] += 1
    return out


def passages(df, n=13, **options):
    return Counter((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df, n, **options).collect())


def test_passages_agree_with_brute_force(spark, docs, sf):
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert passages(df) == brute_passages(rows)


@pytest.mark.parametrize("n", [2, 3, 7, 13, 16])
def test_passages_of_a_small_vocabulary_and_hot_anchors(spark, n):
    rng = np.random.default_rng(n)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(int(rng.integers(0, 60)) if i % 9 else None, " ".join(rng.choice(["a", "b", "cé"], rng.integers(0, 60)))) for i in range(80)]
    rows += [(100 + i, f"x{i} y{i} z{i} {passage} u{i} v{i} w{i} " + "same " * 70) for i in range(40)] + [(300, None), (301, "  \t"), (100, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    rows = [tuple(r) for r in df.collect()]
    assert passages(df, n) == brute_passages(rows, n)
    spans = substrings.repeated_spans(df, n, hot_docs=3, shard_words=500).collect()
    removed = Counter({(r["id"]): 0 for r in spans})
    for r in spans:
        removed[r["id"]] += int(np.diff(np.frombuffer(r["spans"], "<i4").reshape(-1, 2)).sum())
    expected = Counter()
    for (d, _, _, k), m in {(d, t, a, k): m for (d, t, a, k), m in brute_passages(rows, n).items()}.items():
        expected[LOW if d is None else d] += m * k
    assert removed == Counter({d: k for d, k in expected.items() if k})


def test_passages_keep_columns_and_take_empty_tables(docs, no_docs):
    got = substrings.remove_repeats(docs.withColumn("n_removed", F.lit("x")))
    assert got.columns == [*docs.columns, "n_words", "n_removed"] and dict(got.dtypes)["n_removed"] == "bigint"
    assert substrings.remove_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, 1)


def test_index_agrees_with_brute_force():
    rng = np.random.default_rng(4)
    none = np.iinfo(np.int64).max
    for _ in range(60):
        depth = int(rng.integers(2, 14))
        held = [rng.integers(1, int(rng.integers(2, 7)), rng.integers(0, 40)) for _ in range(rng.integers(1, 8))]
        row = np.concatenate([np.append(s, 0) for s in held])
        numbers = np.concatenate([np.full(len(s) + 1, int(rng.integers(0, 100))) for s in held])
        index = FmIndex(row, numbers, depth)
        asked = [rng.integers(1, 8, rng.integers(0, 30)) for _ in range(5)] + held
        size = np.array([len(x) for x in asked])
        got = index.least_of_windows(np.concatenate(asked).astype(np.int64), np.cumsum(size) - size, size, max(1, int(size.max())))
        least = {}
        for i in range(len(row) - depth + 1):
            if 0 not in row[i : i + depth]:
                least[tuple(row[i : i + depth])] = min(least.get(tuple(row[i : i + depth]), none), numbers[i])
        for j, x in enumerate(asked):
            for i in range(len(x) - depth + 1):
                assert got[j, i] == least.get(tuple(x[i : i + depth]), none)


# ---- phrases --------------------------------------------------------------------------------------------------------

def brute_phrases(rows, longest=3, min_count=10, inside_percent=50, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        c = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang if lang is not None else "und"] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    c[tuple(w[i : i + n])] += 1
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        around = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    around[p[i : i + n]] = max(around[p[i : i + n]], a)
        kept = []
        for p, a in found.items():
            if p not in around or 100 * around[p] < inside_percent * a:
                score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def test_phrases_agree_with_brute_force(spark, docs, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, "A b\ta  B,c É x"), ("und", "a b a b"), ("en", None), ("en", ""), ("fr", "Été a:b\x0bc d"), ("fr", "z " * 500)] * 4, "lang string, text string")
    cases = ((table, {}), (table, {"min_count": 2, "longest": 2, "top": 7}), (table, {"min_count": 3, "longest": 4, "inside_percent": 80}),
             (odd, {"min_count": 2}), (odd, {"min_count": 1, "longest": 4}), (docs, {"min_count": 2}))
    for df, options in cases:
        got = sorted(tuple(r) for r in phrases.collocations(df, **options).collect())
        assert got == brute_phrases(map(tuple, df.select("lang", "text").collect()), **options)


def test_phrases_of_an_empty_table(no_docs):
    assert phrases.collocations(no_docs).count() == 0


def test_summaries_keep_whatever_reaches_the_threshold():
    rng = np.random.default_rng(8)
    for threshold in (2, 5, 10):
        items = np.concatenate([rng.integers(0, 4000, 6000), np.repeat(np.arange(5000, 5040), threshold)]).astype(np.uint64)
        rng.shuffle(items)
        capacity = len(items) // threshold + 1
        hashes, counts, off = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for part in np.array_split(items, 23):
            hashes, counts, more = phrases.shrink(np.concatenate([hashes, part]), np.concatenate([counts, np.ones(len(part), np.int64)]), capacity)
            off += more
            assert len(hashes) <= capacity
        names, n = np.unique(items, return_counts=True)
        assert off < threshold and set(names[n >= threshold]) <= set(hashes[counts + off >= threshold])


def test_bitmaps_hold_every_hash(spark):
    hashes = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    part = (hashes >> np.uint64(61)).astype(int)
    rows = [(p, int((part == p).sum()), hashes[part == p].tobytes()) for p in range(8)]
    bits, data = bitmap_of(spark.createDataFrame(rows, "part int, n long, hashes binary"), 3)
    assert Bitmap(bits, data).holds(hashes).all() and Bitmap(bits, data).holds(hashes ^ np.uint64(1 << 50)).mean() < 0.1


def test_words_of_odd_texts():
    classes = byte_classes(b" \t\n\x0b\x0c\r")
    texts = ["", None, " a", "b ", "a  b\nc" * 50, "x" * 300 + " y", "é  z", "w" * 8 + " " + "w" * 9 + " " + "w" * 9]
    w = Words(pa.array(texts), classes)
    plain = [re.findall("[^ \t\n\x0b\x0c\r]+", t or "") for t in texts]
    assert w.strings().to_pylist() == [x for p in plain for x in p] and np.diff(w.first).tolist() == [len(p) for p in plain]
    assert w.strings(np.array([2, 0])).to_pylist() == [w.strings().to_pylist()[i] for i in (2, 0)]
    same = {}
    for word, h in zip(w.strings().to_pylist(), w.hash.tolist()):
        assert same.setdefault(word, h) == h
    assert len(set(same.values())) == len(same)
