"""Toxicity by a chain of linear classifiers over words and word beginnings.

Features are the distinct words of a text and their beginnings of four to seven letters.  Those that go with
toxic labels are selected by a z-score; all other words do not count, so that a long text is no more suspect than
a short one.  The categories form a chain: the model of each category also sees the probabilities of the
categories before it.  While training, these come from models that did not see the row (out of fold), so a later
model learns how far the earlier ones can be trusted.

Categories, in the order of the chain: "insult" (the text holds a word that hardly ever occurs outside toxic
texts), "repeated" (it holds two or more different ones), "toxic" (the label itself).  The first two are derived
from the labelled texts; a table that brings its own categories can name them instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import col, cut, fresh, on_workers

CATEGORIES = ("insult", "repeated", "toxic")
LETTERS = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 4, 7
CACHE_WORDS = 80_000  # about 16 MB in a task
ROWS = 512


def features_of(word: str) -> list[str]:
    """The word, and its beginnings, each marked as what it is."""
    return [word] + [word[:n] + "*" for n in range(SHORTEST, min(LONGEST, len(word)) + 1)]


def distinct_words(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def _text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many toxic and other texts hold each feature (partial counts)."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            for feature in {f for w in distinct_words(text.as_py()) for f in features_of(w)}:
                counts.setdefault(feature, [0, 0])[0 if toxic else 1] += 1
    yield pa.RecordBatch.from_arrays([
        pa.array(counts, pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
        pa.array([c[1] for c in counts.values()], pa.int64())], ["feature", "toxic", "other"])


class Scorer:
    """Selected features of a text, and the probabilities of the chain."""

    def __init__(self, names: list[str], weights: list[np.ndarray]):
        self.place = {f: i for i, f in enumerate(names)}
        self.weights = weights
        self.seen: dict[str, tuple[int, ...]] = {}

    def places(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        for w in distinct_words(text):
            hit = self.seen.get(w)
            if hit is None:
                if len(self.seen) >= CACHE_WORDS:
                    self.seen.clear()
                hit = self.seen[w] = tuple(self.place[f] for f in features_of(w) if f in self.place)
            if hit:
                found.update(hit)
        return np.array(sorted(found), dtype=np.int64)

    def chain(self, places: list[np.ndarray]) -> np.ndarray:
        """Probabilities (texts x categories); each model sees the log-odds of the ones before it."""
        n, base = len(places), len(self.place)
        out = np.zeros((n, len(self.weights)))
        sums = np.array([len(p) for p in places])
        flat = np.concatenate(places) if n else np.zeros(0, dtype=np.int64)
        row = np.repeat(np.arange(n), sums)
        for c, w in enumerate(self.weights):
            z = np.bincount(row, w[flat], minlength=n) + w[-1]
            for k in range(c):
                z += w[base + k] * log_odds(out[:, k])
            out[:, c] = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        return out


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 200) -> np.ndarray:
    """Logistic regression with an intercept (last weight), by accelerated gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    pull = np.full(x.shape[1], l2 / max(len(x), 1), dtype=x.dtype)
    pull[-1] = 0.0
    y = y.astype(x.dtype)
    vector = np.ones(x.shape[1], dtype=x.dtype) / np.sqrt(np.float32(x.shape[1]))
    for _ in range(20):  # largest eigenvalue of the Gram matrix, for the step
        vector = x.T @ (x @ vector)
        norm = np.linalg.norm(vector)
        if norm == 0:
            break
        vector /= norm
    rate = 1.0 / (0.25 * norm / max(len(x), 1) * 1.05 + pull.max() + 1e-9)
    w = ahead = np.zeros(x.shape[1], dtype=x.dtype)
    momentum = 1.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - x.dtype.type(rate) * (x.T @ (p - y) / max(len(x), 1) + pull * ahead)
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + x.dtype.type((momentum - 1) / following) * (new - w)
        w, momentum = new, following
    return w.astype(np.float64)


def fit_chain(places: list[np.ndarray], targets: np.ndarray, base: int, fold: np.ndarray, folds: int) -> list[np.ndarray]:
    """One weight vector per category: features, earlier categories, intercept."""
    x = np.zeros((len(places), base), dtype=np.float32)
    for i, p in enumerate(places):
        x[i, p] = 1.0
    weights = []
    for c in range(targets.shape[1]):
        weights.append(fit_linear(x, targets[:, c]))
        held_out = np.zeros(len(x))
        for k in range(folds):
            inside = fold != k
            if inside.all() or not inside.any():
                continue
            w = fit_linear(x[inside], targets[inside, c])
            held_out[~inside] = 1.0 / (1.0 + np.exp(-np.clip(x[~inside] @ w[:-1] + w[-1], -30, 30)))
        x = np.concatenate([x, log_odds(held_out)[:, None].astype(np.float32)], axis=1)
    return weights


def learn(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
    fit_rows: int = 12_000, max_features: int = 600, min_toxic: int = 4, min_z: float = 5.0, folds: int = 3, seed: int = 11,
) -> Scorer:
    """Fit the chain on about `fit_rows` labelled documents, chosen by a hash of their id.

    The bounded sample is the only data the model is made from; its size does not grow with the corpus.  A label
    that is null counts as not given; where labels repeat an id, the highest one holds.  Without toxic labels
    the model finds nothing toxic.
    """
    on_workers(df.sparkSession)
    known = labels.where(col(toxic_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).cast("long").alias("id")).agg(
        (F.max(col(toxic_col)) > 0).alias("toxic"))
    known = cut(known, "tox-labels")
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)) < fit_rows)
    sample = df.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).join(F.broadcast(known), "id")  # fit_rows rows at most, give or take chance
    sample = cut(sample, "tox-sample")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_other:
        return Scorer([], [np.array([-30.0]), np.array([0.0, -30.0]), np.array([0.0, 0.0, -30.0])])
    counted = sample.select("text", "toxic").mapInArrow(_text_features, "feature string, toxic long, other long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(F.col("toxic") >= min_toxic)
    p, q = F.col("toxic") / F.lit(n_toxic), F.col("other") / F.lit(n_other)
    pooled = (F.col("toxic") + F.col("other")) / F.lit(n_toxic + n_other)
    z = (p - q) / F.sqrt(pooled * (1 - pooled) * F.lit(1.0 / n_toxic + 1.0 / n_other) + F.lit(1e-12))
    best = counted.withColumn("z", z).where(F.col("z") >= min_z).orderBy(F.desc("z"), "feature").limit(max_features).toArrow().to_pylist()
    names = [r["feature"] for r in best]
    # words and beginnings that are hardly ever found elsewhere stand for insults
    strong = np.array([r["toxic"] / n_toxic > 20 * (r["other"] + 0.5) / n_other for r in best], dtype=bool)
    scorer = Scorer(names, [])

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Scorer(names, [])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([mine.places(t.as_py()) for t in batch.column(2)], pa.list_(pa.int64()))], ["id", "toxic", "places"])

    rows = sample.select("id", "toxic", "text").mapInArrow(selected, "id long, toxic boolean, places array<bigint>").orderBy("id").toArrow().to_pylist()
    places = [np.array(r["places"], dtype=np.int64) for r in rows]
    words = np.array([not f.endswith("*") for f in names], dtype=bool)
    hits = [p[strong[p]] for p in places]
    toxic = np.array([r["toxic"] for r in rows])
    several = np.array([max(int(words[h].sum()), int(len(h) > 4)) >= 2 for h in hits])
    targets = np.stack([np.array([len(h) > 0 for h in hits]), several, toxic], axis=1).astype(np.float64)
    fold = np.arange(len(rows)) % folds
    scorer.weights = fit_chain(places, targets, len(names), fold, folds)
    return scorer


def score(df: DataFrame, scorer: Scorer, text_col: str = "text", prefix: str = "p_", keep: list[str] | None = None) -> DataFrame:
    """Add the probability of each category.  Whole texts are read; a null or empty text has the lowest there are."""
    on_workers(df.sparkSession)
    outs = [prefix + c for c in CATEGORIES]
    keep = [c for c in (df.columns if keep is None else keep) if c not in outs]
    work = fresh(df, "tox_text")
    frame = df.select(*[col(c) for c in keep], col(text_col).alias(work))
    schema = T.StructType([*frame.schema.fields[:-1], *[T.StructField(c, T.DoubleType()) for c in outs]])
    names, weights = tuple(scorer.place), tuple(w.tobytes() for w in scorer.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Scorer(list(names), [np.frombuffer(w) for w in weights])  # of this task; what it has seen goes with it
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                p = mine.chain([mine.places(t.as_py()) for t in part.column(part.num_columns - 1)])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *[pa.array(p[:, k]) for k in range(len(outs))]], [*part.schema.names[:-1], *outs])

    return frame.mapInArrow(run, schema)
