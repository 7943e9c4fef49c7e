import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import hnsw, mixing, neardup, topk, toxicity, url_rules
from statloom.llm.graphs import components
from statloom.llm.sketch import Shingles, numbered, signatures

VECTORS = "vec_id long, embedding array<float>, label int, q string, score string"


def vectors(spark, n=400, copies=130, dim=8, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[:copies] = x[0]  # a third of all rows are one vector
    rows = [(i, [float(v) for v in x[i]], 0, "c", "c") for i in range(n)]
    rows += [(None, [1.0] * dim, 0, "c", "c"), (n + 1, None, 0, "c", None), (n + 2, [1.0, None] * (dim // 2), 0, None, "c"),
             (n + 3, [float("nan")] * dim, None, "c", "c"), (n + 4, [float("inf")] * dim, 0, "c", "c"), (7, [float(v) for v in x[7]], 0, "c", "c")]
    return spark.createDataFrame(rows, VECTORS)


def test_top_k_agrees_with_brute_force(spark):
    df = vectors(spark)
    x = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], dtype=np.float64)).astype(np.int64) for r in df.where("vec_id < 400").collect()}
    for k, block in ((5, 64), (200, 4096)):
        got = topk.exact_top_k(df, k=k, every=20, candidate_block=block, query_block=8, bins=16).collect()
        want = set()
        for a in x:
            if a % 20 == 0:
                best = sorted(((-int(x[a] @ x[b]), b) for b in x if b != a))[:k]
                want |= {(a, i + 1, b, -s) for i, (s, b) in enumerate(best)}
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_searches_of_tiny_tables(spark):
    for search in (topk.exact_top_k, hnsw.nearest):
        assert search(spark.createDataFrame([], VECTORS)).count() == 0
        one = spark.createDataFrame([(0, [1.0], 0, "", "")], VECTORS)
        assert search(one).count() == 0
        two = spark.createDataFrame([(0, [1.0, 2.0], 0, "", ""), (1, [3.0], 0, "", "")], VECTORS)
        assert [tuple(r)[:3] for r in search(two).collect()] == [(0, 1, 1)]


def test_nearest_finds_what_brute_force_finds(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = {}
    for r in hnsw.nearest(df, shard_rows=700).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        mine = sorted(got[ids[i]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(a["score"] >= b["score"] for a, b in zip(mine, mine[1:]))
        assert all(abs(r["score"] - x[i] @ x[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-12 for r in mine)
        hits, total = hits + len(best & {r["vec_id"] for r in mine}), total + 20
    assert hits / total >= 0.95


def test_nearest_keeps_copies_and_odd_rows_in_order(spark):
    df = vectors(spark).unionByName(spark.createDataFrame([(500, [0.0] * 8, 0, "", "")], VECTORS))
    got = [tuple(r) for r in hnsw.nearest(df).where("query_id = 0").orderBy("rank").collect()]
    x = np.array([r["embedding"] for r in df.where("vec_id < 400").dropDuplicates(["vec_id"]).orderBy("vec_id").collect()], dtype=np.float64)
    s = x @ x[0]
    s[0] = -np.inf
    assert [r[2] for r in got] == np.lexsort((np.arange(400), -np.round(s, 12)))[:20].tolist()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def shingles(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(texts, threshold=0.8):
    """Smallest member of the class of each text, from all pairs."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or (sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= threshold):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def family(rng, n, words, edits):
    base = [f"w{rng.integers(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for k in rng.choice(words, edits, replace=False):
            copy[k] = f"x{rng.integers(10**6)}"
        out.append(" ".join(copy))
    return out


def test_classes_agree_with_all_pairs(spark):
    rng = np.random.default_rng(8)
    # similarities around the threshold, one large family, exact copies, and boilerplate that is not a duplicate
    texts = family(rng, 90, 120, 3) + family(rng, 25, 60, 1) + ["same words here again and again"] * 40 + ["", None, "  "]
    shared = " ".join(f"b{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"u{i}v{j}" for j in range(40)) for i in range(30)]
    texts += [" ".join(["again and again the same five"] * n) for n in (5, 6, 30, 31)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.mark_near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = neardup.keep_first_of_class(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(texts))) and kept.columns == df.columns


def test_classes_of_odd_tables(spark, docs, no_docs):
    assert neardup.mark_near_duplicates(no_docs).count() == 0
    got = {(r["doc_id"], r["class_id"], r["is_first"]) for r in neardup.mark_near_duplicates(docs).collect()}
    assert {(4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False), (8, 8, True), (9, 8, False), (None, None, True)} <= got


def test_signatures_estimate_the_weighted_similarity():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = " ".join(f"t{i}" for i in range(40))
    texts = [base + " " + " ".join(["a b c d e"] * 40), base + " " + " ".join(["a b c d e"] * 25), " ".join(f"z{rng.integers(99)}" for _ in range(80))]
    s = Shingles(pa.array(texts))
    h = signatures(s, 4096)
    for i, j in ((0, 1), (0, 2), (0, 0)):
        true = jaccard(shingles(texts[i]), shingles(texts[j]))
        assert abs((h[i] == h[j]).mean() - true) < 4 * (0.25 / 4096) ** 0.5
        a, b = numbered(s, i), numbered(s, j)
        both = len(np.intersect1d(a, b))
        assert abs(both / (len(a) + len(b) - both) - true) < 1e-12


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(200))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    scorer = toxicity.learn(docs, seen)
    counts = {r["toxic"]: r for r in toxicity.score(docs.join(held, "doc_id"), scorer).groupBy("toxic").agg(
        F.count("*").alias("n"), F.count_if(F.col("p_toxic") >= 0.5).alias("found")).collect()}
    assert counts[1]["found"] >= 0.85 * counts[1]["n"] and counts[0]["found"] <= 0.01 * counts[0]["n"]


def test_toxicity_of_odd_tables(spark, docs, no_docs):
    none = toxicity.learn(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).where("p_toxic >= 0.5").count() == 0
    assert toxicity.score(no_docs, none).count() == 0
    bad = spark.createDataFrame([(i, "you idiot" if i % 2 else "hello there", "p") for i in range(60)], "doc_id long, text string, p_toxic string")
    learned = toxicity.learn(bad, bad.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    scored = toxicity.score(bad, learned).collect()
    assert all((r["p_toxic"] >= 0.5) == bool(r["doc_id"] % 2) for r in scored)


def test_later_models_lean_on_earlier_ones():
    rng = np.random.default_rng(0)
    y0 = rng.random(600) < 0.5
    places = [np.array([0] if v else [], dtype=np.int64) for v in y0]
    weights = toxicity.fit_chain(places, np.stack([y0, y0], axis=1).astype(float), 1, np.arange(600) % 3, 3)
    assert len(weights[0]) == 2 and len(weights[1]) == 3 and weights[1][1] > 0.1


def test_raking_meets_every_margin(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 7}" if i % 3 else "hot", "en" if i % 5 else "de", "p" if i % 2 else "q", int(rng.integers(1, 99))) for i in range(500)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("tokens"))
    targets = {m: mixing.tempered(cells, m, 0.5) for m in mixing.MARGINS}
    raked = mixing.rake(cells, targets, 12)
    assert mixing.residual(raked, targets) < 1e-3 < mixing.residual(mixing.rake(cells, targets, 1), targets) + 1e-3
    for m in mixing.MARGINS:
        got = {r[m]: r["w"] for r in raked.groupBy(m).agg(F.sum("weight").alias("w")).collect()}
        assert all(abs(got[r[m]] - r["target"]) < 1e-6 for r in targets[m].collect())


def test_mixing_odd_tables_and_given_targets(spark, docs, no_docs):
    assert mixing.mix(no_docs).count() == 0
    kept = mixing.mix(docs, sweeps=2)
    assert kept.columns == [*docs.columns, "rate"] and kept.where("rate > 1 or rate < 0 or rate is null").count() == 0
    even = mixing.mix(docs, targets={"source": {"a": 0.0, "b": 0.5, "c": 0.5}}, sweeps=2)
    assert even.where("source = 'a' and rate > 0").count() == 0


def test_one_rare_document_hardly_changes_the_rates_of_the_others(spark):
    rows = [(i, "word " * (5 + i % 7), ("en", "de")[i % 5 == 0], ("s0", "s1", "s2")[i % 7 % 3]) for i in range(2000)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stray = plain.unionByName(spark.createDataFrame([(9999, "three small words", None, None)], plain.schema))
    rates = []
    for df in (plain, stray):
        kept = mixing.mix(df, keep=0.7)
        rates.append({(r["source"], r["lang"]): r["rate"] for r in kept.select("source", "lang", "rate").distinct().collect() if r["source"]})
        tokens = mixing.count_tokens(F.col("text"))
        share = kept.agg(F.sum(tokens)).first()[0] / df.agg(F.sum(tokens)).first()[0]
        assert abs(share - 0.7) < 0.03
    assert rates[0].keys() == rates[1].keys() and all(abs(rates[0][k] - rates[1][k]) < 0.01 for k in rates[0])


def test_kept_share_is_met_exactly_or_as_far_as_rates_go(spark):
    cells = spark.createDataFrame([(900, 800.0), (90, 100.0), (9, 90.0), (1, 0.0)], "tokens long, weight double").withColumn("ratio", F.col("weight") / F.col("tokens"))
    for keep, top in ((0.1, 1.0), (0.5, 1.0), (0.9, 1.0), (0.2, 0.25), (0.0, 1.0)):
        c = mixing.scale_for(cells, keep, top)
        assert cells.agg(F.sum(F.least(F.lit(top), F.col("ratio") * c) * F.col("tokens"))).first()[0] == pytest.approx(keep * 1000)
    assert mixing.scale_for(cells, 1.0) is None and mixing.scale_for(cells, 0.5, 0.25) is None
    assert mixing.scale_for(cells.where("false"), 0.5) is None


URLS = [
    ("http://a.com/x?y", "a.com", "/x"), ("HTTPS://WWW.Example.COM/en/1#z", "www.example.com", "/en/1"), ("x://h", "h", ""),
    ("x://h?q=/a", "h", ""), ("no scheme", "", ""), (None, "", ""), ("", "", ""), ("a://b://c/d", "b:", "//c/d"),
]


def test_hosts_paths_and_fixed_rules(spark):
    df = spark.createDataFrame([(u, "x") for u, *_ in URLS], "url string, verdict string")
    rules = spark.createDataFrame([], "tokens array<string>, support long, confidence double")
    got = {r["url"]: r for r in url_rules.judge_urls(df, rules, url_rules.FIXED_RULES).collect()}
    for u, host, path in URLS:
        assert (got[u]["host"], got[u]["path"]) == (host, path)
        assert got[u]["verdict"] == "allow"
    cases = {"http://example.com/en/2": ("example.com/en/", "block"), "http://www.example.com/en/2": ("www.example.com/en/", "allow"),
             "http://a.example.com/en/": ("example.com/en/", "block"), "http://notexample.com/en/": ("com/", "allow"),
             "http://x.net/es/1": ("net/es/", "block"), "http://x.net/de/1": (None, "allow"), "http://x.com": (None, "allow")}
    out = url_rules.judge_urls(spark.createDataFrame([(u,) for u in cases], "url string"), rules, url_rules.FIXED_RULES)
    assert {r["url"]: (r["rule"], r["verdict"]) for r in out.collect()} == cases
    assert url_rules.judge_urls(df.where("false"), rules, url_rules.FIXED_RULES).count() == 0


def test_mined_rules_block_what_the_labels_say(spark):
    rows = [(f"http://h{i}.org/{'spam/pills' if i % 3 == 0 else 'news/pills' if i % 3 == 1 else 'spam/mail'}/{i}", i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_rules.mine_rules(df, "url", F.col("bad"), min_support=0.05)
    assert {tuple(r["tokens"]) for r in rules.collect()} == {("p:pills", "p:spam")}
    got = url_rules.judge_urls(df, rules, [])
    assert got.where("(verdict = 'block') <> bad").count() == 0
    assert url_rules.mine_rules(df.where("false"), "url", F.col("bad")).count() == 0


def test_rules_of_urls_with_many_frequent_tokens_are_those_of_all_their_token_sets(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        held = [t for t in ("spam", "pills") if rng.random() < 0.8] + [f"w{k}" for k in range(14) if rng.random() < 0.75] + ["same"]
        rows.append((f"http://x.org/{'/'.join(held)}/{i}", "spam" in held and "pills" in held and rng.random() < 0.95))
    sets = [({"h:x", "h:org", *(f"p:{t}" for t in url.split("/")[3:])}, bad) for url, bad in rows]
    items = sorted(set().union(*(s for s, _ in sets)))
    items = [t for t in items if sum(t in s for s, _ in sets) >= 60]
    assert max(sum(t in s for t in items) for s, _ in sets) > 12
    found = {}
    for size in (1, 2, 3):
        for c in itertools.combinations(items, size):
            held = [bad for s, bad in sets if s.issuperset(c)]
            if sum(held) >= 60 and sum(held) / len(held) >= 0.6:
                found[c] = (sum(held), sum(held) / len(held))
    kept = {c: v for c, v in found.items() if not any(
        found.get(part, (0, 0))[1] >= v[1] for size in range(1, len(c)) for part in itertools.combinations(c, size))}
    assert ("p:pills", "p:spam") in kept
    df = spark.createDataFrame(rows, "url string, bad boolean")
    got = url_rules.mine_rules(df, "url", F.col("bad"), min_support=0.25).collect()
    assert {tuple(r["tokens"]): (r["support"], r["confidence"]) for r in got} == kept


def test_rules_count_every_labelled_row_of_a_large_table(spark):
    n, k = 240_000, F.col("id")
    url = F.when(k % 3 == 0, "http://hot.example/x").when(k % 3 == 1, F.concat(F.lit("http://b.example/y/"), k.cast("string")))
    rules = url_rules.mine_rules(spark.range(n).select(url.alias("url"), ((k % 3 == 0) & (k % 12 != 0) | (k % 3 == 2)).alias("bad")), "url", F.col("bad"))
    got = {tuple(r["tokens"]): (r["support"], r["confidence"]) for r in rules.collect()}
    assert got == {("h:hot",): (n // 4, 0.75), ("p:x",): (n // 4, 0.75)}


def test_probes_find_every_link_that_connects():
    rng = np.random.default_rng(6)
    for trial in range(30):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = []
        for _ in range(40):
            keep = base[rng.random(60) < rng.choice([0.5, 0.85, 0.97])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)])))
        sets.append(np.zeros(0, dtype=np.uint64))
        roots = rng.integers(0, 12, len(sets)).tolist()
        common = max(set(roots), key=roots.count)
        probes = neardup.Probes(0.8)
        for k, r in enumerate(roots):
            if r != common:
                probes.add(k, r, sets[k])
        links = []
        for at in range(0, len(sets), 7):
            links += probes.pass_by(list(range(at, min(at + 7, len(sets)))), roots[at : at + 7], sets[at : at + 7])

        def joined(pairs):
            name = dict(zip(range(len(sets)), roots))
            for a, b in pairs:
                old, new = name[a], name[b]
                name = {k: new if v == old else v for k, v in name.items()}
            groups = {}
            for k, v in name.items():
                groups.setdefault(v, set()).add(k)
            return {frozenset(g) for g in groups.values()}

        every = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a]) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
        assert joined(links) == joined(every) and len(links) < len(set(roots))


def test_a_large_family_of_near_copies_and_very_long_texts(spark):
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(260):
        words = list(base)
        for at in rng.integers(0, 400, int(rng.integers(0, 14))):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    long = " ".join(f"v{j}" for j in range(400_000))
    rows += [(1000, long), (1001, long + " end"), (1002, "v5 " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in neardup.mark_near_duplicates(df).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(396)} for _, t in rows[:260]]
    parent = list(range(260))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(260):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert [got[i] for i in range(260)] == [find(i) for i in range(260)]
    assert got[1001] == 1000 and got[1002] == 1002
