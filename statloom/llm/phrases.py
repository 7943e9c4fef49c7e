"""Phrase collocations: frequent word sequences by Misra-Gries summaries, then exact counts and scores.

Level by level, from two words up to the longest phrases:

1. Every slice of the texts counts the hashes of its n-grams (those whose shorter parts survived the level before)
   and deals them out by hash range.  Such counts are a summary without error, and summaries can be merged.
2. One task per hash range merges its summaries into one of at most `capacity` counters, where
   capacity + 1 > mass / threshold for the mass (occurrences) of that range: whenever counters exceed the capacity,
   the (capacity + 1)-th largest count is taken off all of them.  That costs any n-gram less than the threshold in
   total, so every n-gram that is frequent enough still has a counter at the end.
3. The survivors of all ranges make a bitmap over the hash space that every task gets.  Its size is bounded; when
   it is too small for all survivors, more n-grams pass, none is lost.

The last pass counts the survivors exactly, by language and the words themselves.  Counts of a slice stop at the
threshold in the summaries, as one slice alone then shows that the n-gram is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.llm.bitmaps import Bitmap, bitmap_of
from statloom.llm.common import col, cut, on_workers
from statloom.llm.words import GOLD, Words, by_bytes, byte_classes, mixed

#: Fixed by the contract: the characters between words, and those that end a piece.
BLANKS, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"
NO_LANG = "und"
MASS_BITS = 12
#: Occurrences that one merging task should stand for.
RANGE_MASS = 8_000_000
HELD_ROWS = 150_000
#: Bytes of text that are counted at a time.
TEXT_BYTES = 2 << 20
_CLASSES = byte_classes(BLANKS, STOPS)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Slice:
    """The words of a slice of texts, the language of each, and the hashes of n-grams that begin at each word."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        self.words = Words(texts, _CLASSES, lower=True)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.words.text_of()]
        seeds = np.array([xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()], dtype=np.uint64)
        self.hash = mixed(self.words.hash ^ seeds[self.lang]) if len(self.lang) else self.words.hash
        self.at = np.arange(len(self.hash))
        self.n = 1

    def longer(self, keep: np.ndarray | None = None) -> None:
        """Go to n-grams of one word more, whose parts begin at places that `keep` marks among `at`."""
        total = len(self.words.hash)
        begins = np.zeros(total + 1, dtype=bool)
        begins[self.at if keep is None else self.at[keep]] = True
        by_place = np.zeros(total, dtype=np.uint64)
        by_place[self.at] = self.hash
        last = np.arange(total) + self.n
        inside = last < total
        inside[inside] = ~self.words.opens[last[inside]]
        at = np.flatnonzero(inside & begins[:-1] & begins[1:])
        with np.errstate(over="ignore"):
            self.hash = mixed(by_place[at] * _STEP + self.words.hash[at + self.n] + GOLD)
        self.at, self.n = at, self.n + 1

    def phrases(self, first: np.ndarray) -> pa.Array:
        """The n-grams that begin at the given words, joined by blanks."""
        parts = [self.words.strings(first + k) for k in range(self.n)]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if self.n > 1 else parts[0]


def shrink(hashes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One Misra-Gries summary of hash and count pairs that may repeat: hashes, counts, and what was taken off."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, dtype=np.int64)
    hashes, counts = hashes[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(hashes) <= capacity:
        return hashes, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > off
    return hashes[left], counts[left] - off, off


def _count_type(threshold: int) -> np.dtype:
    return np.dtype("u1" if threshold < 256 else "<u4")


def _words_and_masses(longest: int):
    """Per task: (lang, word, n), and rows without a word: n-grams of `size` words by leading bits of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masses = np.zeros((longest + 1, 1 << MASS_BITS), dtype=np.int64)
        held, rows = [], 0

        def out(t: pa.Table) -> list[pa.RecordBatch]:
            none = pa.nulls(t.num_rows, pa.int32())
            return pa.table({"lang": t["lang"].cast(pa.string()), "word": t["word"].cast(pa.string()), "size": none, "part": none, "n": t["n"]}).to_batches()

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")])
            return t.rename_columns(["lang", "word", "n"])

        for batch in batches:
            for part in by_bytes(batch, 1, TEXT_BYTES):
                s = Slice(part.column(0), part.column(1))
                if not len(s.at):
                    continue
                coded = s.phrases(s.at).dictionary_encode()
                key, n = np.unique(s.lang * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
                held.append(pa.table({"lang": s.langs.take(pa.array(key // len(coded.dictionary))).cast(pa.large_string()),
                                      "word": coded.dictionary.take(pa.array(key % len(coded.dictionary))), "n": n}))
                rows += len(n)
                while s.n < longest:
                    s.longer()
                    masses[s.n] += np.bincount((s.hash >> np.uint64(64 - MASS_BITS)).astype(np.int64), minlength=1 << MASS_BITS)
                if rows > 2 * HELD_ROWS:
                    held = [summed()]
                    rows = held[0].num_rows
                    if rows > HELD_ROWS:
                        yield from out(held[0])
                        held, rows = [], 0
        if held:
            yield from out(summed())
        size, place = np.nonzero(masses)
        none = pa.nulls(len(size), pa.string())
        yield from pa.table({"lang": none, "word": none, "size": pa.array(size, pa.int32()), "part": pa.array(place, pa.int32()), "n": masses[size, place]}).to_batches()

    return run


def _slices(batches: Iterator[pa.RecordBatch], maps: list[Bitmap]) -> Iterator[Slice]:
    """Slices taken to the n-grams of one word more than the last bitmap judges."""
    for batch in batches:
        for part in by_bytes(batch, 1, TEXT_BYTES):
            s = Slice(part.column(0), part.column(1))
            s.longer()
            for m in maps:
                s.longer(m.holds(s.hash))
            yield s


def _summaries(maps, bits: int, threshold: int):
    """Per slice and hash range: sorted hashes of its n-grams and their counts, which stop at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches, [Bitmap(*m.value) for m in maps]):
            hashes, counts = np.unique(s.hash, return_counts=True)
            counts = np.minimum(counts, threshold).astype(_count_type(threshold))
            part = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            names, first = np.unique(part, return_index=True)
            ends = np.append(first, len(part))[1:]
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.int32()), pa.array([hashes[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], ["part", "hashes", "counts"])

    return run


def _merged(capacity: np.ndarray, bits: int, threshold: int):
    """One summary per hash range, and of that the hashes that may have reached the threshold."""

    def per_range(part: int) -> int:
        first, end = part << MASS_BITS >> bits, (part + 1) << MASS_BITS >> bits
        return int(capacity[first : max(end, first + 1)].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pending, size, off = None, [], 0, 0

        def merged(room: int):
            nonlocal off, size
            hashes, counts, more = shrink(np.concatenate([h for h, _ in pending]), np.concatenate([c for _, c in pending]), room)
            off += more
            pending[:] = [(hashes, counts)]
            size = len(hashes)

        def done() -> pa.RecordBatch:
            merged(per_range(part))
            hashes, counts = pending[0]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([int((counts + off >= threshold).sum())], pa.int64()),
                 pa.array([hashes[counts + off >= threshold].tobytes()], pa.binary())], ["part", "n", "hashes"])

        for batch in batches:
            for p, h, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if p != part:
                    if pending:
                        yield done()
                    part, pending, size, off = p, [], 0, 0
                h = np.frombuffer(h.as_buffer(), dtype=np.uint64)
                pending.append((h, np.frombuffer(c.as_buffer(), dtype=_count_type(threshold)).astype(np.int32)))
                size += len(h)
                if len(pending) > 1 and size > 2 * len(pending[0][0]) + 500_000:
                    merged(per_range(p))
        if pending:
            yield done()

    return run


def _survivors(rows: DataFrame, masses: np.ndarray, maps: list, threshold: int):
    """The broadcast bitmap of the n-grams that one Misra-Gries round leaves."""
    spark = rows.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_bits = max(3, int(max(usual, int(masses.sum()) // RANGE_MASS) - 1).bit_length())
    capacity = masses // threshold + 1
    dealt = rows.mapInArrow(_summaries(maps, part_bits, threshold), "part int, hashes binary, counts binary")
    dealt = dealt.repartition(1 << part_bits, "part").sortWithinPartitions("part")
    kept = cut(dealt.mapInArrow(_merged(capacity, part_bits, threshold), "part int, n long, hashes binary"), "phrase-survivors")
    return spark.sparkContext.broadcast(bitmap_of(kept, part_bits))


def _exact(maps):
    """Per slice: the n-grams of every level that survived, in words, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = [Bitmap(*m.value) for m in maps]
        for batch in batches:
            for part in by_bytes(batch, 1, TEXT_BYTES):
                s = Slice(part.column(0), part.column(1))
                keep = None
                for m in judges:
                    s.longer(keep)
                    keep = m.holds(s.hash)
                    _, first, n = np.unique(s.hash[keep], return_index=True, return_counts=True)
                    first = s.at[keep][first]
                    yield pa.RecordBatch.from_arrays([
                        s.langs.take(pa.array(s.lang[first])).cast(pa.string()), pa.array(np.full(len(n), s.n), pa.int32()),
                        s.phrases(first).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "size", "phrase", "f"])

    return run


def _words_of(phrase: Column) -> Column:
    return F.split(phrase, " ", -1)


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, min_count: int = 10, inside_percent: int = 50,
    scale: int = 1_000_000, top: int | None = 2000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of two to `longest` words that belong together.

    a, l, r count the phrase and its parts before and after the cut with the lowest score
    floor(scale * a * a / (l * r)); n counts all words of the language.  A phrase that lies inside a longer
    candidate with at least `inside_percent` of its occurrences is dropped.  `top` phrases per language are
    returned (all, if None).  Defined cases: null and empty texts hold no words; a null language is "und"; rows
    that repeat count again; an empty table gives an empty result; other columns are ignored, whatever their
    names; texts of any length are read whole, and n-grams never span two texts.
    """
    spark = df.sparkSession
    on_workers(spark)
    rows = df.select(F.coalesce(col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), col(text_col).alias("text"))
    counted = cut(rows.mapInArrow(_words_and_masses(longest), "lang string, word string, size int, part int, n long"), "phrase-words")
    masses = np.zeros((longest + 1, 1 << MASS_BITS), dtype=np.int64)
    sums = counted.where("word is null").groupBy("size", "part").agg(F.sum("n").alias("n")).toArrow()  # 4096 numbers per level
    masses[sums["size"].to_numpy(), sums["part"].to_numpy()] = sums["n"].to_numpy()
    words = counted.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    totals = counted.where("word is not null").groupBy("lang").agg(F.sum("n").alias("n"))

    maps: list = []
    for size in range(2, longest + 1):
        maps.append(_survivors(rows, masses[size], maps, min_count))
    found = rows.mapInArrow(_exact(maps), "lang string, size int, phrase string, f long")
    candidates = cut(found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), "phrase-candidates")

    # every part of a candidate is at least as frequent as the candidate
    parts = cut(words.where(F.col("f") >= min_count).select("lang", F.col("word").alias("phrase"), "f").unionByName(
        candidates.select("lang", "phrase", "f")), "phrase-parts")
    ws = _words_of(F.col("phrase"))
    piece = lambda a, n: F.array_join(F.slice(ws, a, n), " ")
    cuts = candidates.select("lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).withColumns({
        "left": piece(F.lit(1), F.col("k")), "right": piece(F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    top_part = (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(scale).cast("decimal(7,0)")
    cuts = cuts.withColumn("over", top_part.cast("decimal(38,0)")).withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    best = cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    longer = candidates.where("size > 2").select("lang", F.col("f").alias("around"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
            F.sequence(F.lit(1), F.col("size") - n + 1), lambda a: F.array_join(F.slice(ws, a, n), " "))))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * inside_percent))
    kept = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
