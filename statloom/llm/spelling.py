"""Spelling variants: words that differ by one letter, grouped under the far more frequent form.

Near words are found by a bit-sliced position index.  For every (position, letter) a bitset over a block of the
vocabulary tells which words have that letter there.  A query word runs through its letters once and keeps four
bitsets: the words that agree so far without an error, and those with one replaced, one added or one missing
letter, which are compared at the same place, one place ahead, or one place behind.  Each step is a handful of
operations on whole bitsets, so a machine word carries 64 vocabulary words.

Only words that agree in their first or their last half can differ by one letter, so the vocabulary is dealt out
by halves: near words of lengths L and L or L + 1 meet under the first L // 2 letters if they agree in them, and
under the last L - L // 2 letters otherwise, each pair at one place only.  A key with many words is cut into index
blocks of bounded size; queries stream past a block.  What leaves a block is one row per query word, never pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import col, cut, on_workers
from statloom.llm.words import LOWER, Words, by_bytes

BLOCK_WORDS = 4096
#: Word counts that a task holds before it hands them on.
HELD_WORDS = 400_000
LEAST_ID = -(2**63)
_C3 = 0xC3

_RUN_BYTES = np.ones(256, dtype=np.uint8)
_RUN_BYTES[[*range(65, 91), *range(97, 123)]] = 0
#: One zero byte through the crc32 register.
_ZERO_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
LONGEST_STEP = 64


class Runs(Words):
    r"""Maximal runs of A-Z, a-z and U+00C0 to U+00FF; the latter are the byte C3 and the byte that follows it."""

    def _inside(self, kinds: np.ndarray) -> np.ndarray:
        lead = self.data == _C3
        inside = (kinds == 0) | lead
        inside[1:] |= lead[:-1]
        return inside


def _damaged(ids: np.ndarray, codes: np.ndarray, size: np.ndarray, crc: np.ndarray, doc: np.ndarray, names: list[bytes],
             per_mille: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences whose crc32 of `<id>:<word>` is divisible by `per_mille`, and that crc32.

    The crc32 of a joined text is the crc32 of its end xored with the register of its beginning after as many
    zero bytes, so that it takes one look-up per occurrence.
    """
    register = np.array([zlib.crc32(b"%d:" % i) for i in ids.tolist()], dtype=np.uint32)
    shifted = np.empty((LONGEST_STEP + 1, len(ids)), dtype=np.uint32)
    for n in range(LONGEST_STEP + 1):
        shifted[n] = register
        register = _ZERO_STEP[register & np.uint32(255)] ^ (register >> np.uint32(8))
    n = size[codes]
    h = shifted[np.minimum(n, LONGEST_STEP), doc] ^ crc[codes]
    for i in np.flatnonzero(n > LONGEST_STEP).tolist():
        h[i] = zlib.crc32(b"%d:%s" % (ids[doc[i]], names[codes[i]]))
    hit = np.flatnonzero(h % np.uint32(per_mille) == 0)
    return hit, h[hit]


def _counted(min_chars: int, damage: int):
    """Per task: words and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return t.rename_columns(["word", "n"]).select(["word", "n"])

        for batch in batches:
            for part in by_bytes(batch, 1):
                runs = Runs(part.column(1), _RUN_BYTES, lower=True, hashed=False)
                coded = runs.strings().dictionary_encode()
                names = coded.dictionary.cast(pa.large_binary()).to_pylist()
                if not names:
                    continue
                codes = coded.indices.to_numpy()
                size = np.array([len(w) for w in names], dtype=np.int64)
                chars = np.array([len(w) - w.count(b"\xc3") for w in names], dtype=np.int64)
                n = np.bincount(codes, minlength=len(names))
                if damage:
                    crc = np.array([zlib.crc32(w) for w in names], dtype=np.uint32)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    hit, h = _damaged(ids, codes, size, crc, runs.text_of(), names, damage)
                    n -= np.bincount(codes[hit], minlength=len(names))
                    short = []
                    for c, x in zip(codes[hit].tolist(), h.tolist()):
                        word = names[c].decode()
                        at = x % len(word)
                        if len(word) > min_chars:
                            short.append(word[:at] + word[at + 1 :])
                    held.append(pa.table({"word": pa.array(short, pa.large_string()), "n": pa.array(np.ones(len(short), dtype=np.int64))}))
                    rows += len(short)
                kept = np.flatnonzero((n > 0) & (chars >= min_chars))
                held.append(pa.table({"word": coded.dictionary.take(pa.array(kept)), "n": pa.array(n[kept])}))
                rows += len(kept)
                if rows > 2 * HELD_WORDS:
                    held = [summed()]
                    rows = held[0].num_rows
                    if rows > HELD_WORDS:
                        yield from held[0].cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()
                        held, rows = [], 0
        if held:
            yield from summed().cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()

    return run


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5,
                damage: int = 0) -> DataFrame:
    """(word, n): lower-cased runs of letters with `min_chars` code points and `min_count` occurrences at least.

    With `damage` = d, an occurrence loses one letter if the crc32 of `<id>:<run>` is divisible by d, so that
    documents hold known misspellings.  Counts are summed within tasks before the shuffle.
    """
    on_workers(df.sparkSession)
    rows = df.select(F.coalesce(col(id_col).cast("long"), F.lit(LEAST_ID)).alias("id"), col(text_col).alias("text"))
    counts = rows.mapInArrow(_counted(min_chars, damage), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class PositionIndex:
    """Bitsets (whole numbers) over a block of words: by position and letter, and by length."""

    def __init__(self, words: list[str]):
        at: dict[tuple[int, str], list[int]] = {}
        lengths: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            lengths.setdefault(len(w), []).append(i)
            for place in enumerate(w):
                at.setdefault(place, []).append(i)
        self.words = words
        self.every = (1 << len(words)) - 1
        self.at = {k: self._bits(v) for k, v in at.items()}
        self.of_length = {k: self._bits(v) for k, v in lengths.items()}

    def _bits(self, places: list[int]) -> int:
        if len(places) < 64:
            return sum(1 << i for i in places)
        flags = np.zeros(len(self.words), dtype=bool)
        flags[places] = True
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    def near(self, query: str) -> list[int]:
        """Places of the words that differ from the query by exactly one replaced, added or missing letter."""
        m, at, none = len(query), self.at, 0
        ends = [self.of_length.get(n, 0) for n in (m - 1, m, m + 1)]
        same = self.every  # no error; `replaced`, `added`, `missing`: one error
        replaced, added, missing = 0, self.every, 0
        for i, letter in enumerate(query):
            here = at.get((i, letter), none)
            replaced = (replaced & here) | (same & ~here)
            missing = (missing & at.get((i - 1, letter), none)) | same
            same &= here
            added = (added & at.get((i + 1, letter), none)) | same
            if not (same or replaced or added or missing):
                return []
        found = (missing & ends[0]) | (replaced & ends[1]) | (added & ends[2])
        out = []
        while found:
            low = found & -found
            out.append(low.bit_length() - 1)
            found ^= low
        return out


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, those of the index first; one row goes out per query word that has near words there."""
    cell, words, counts, index = None, [], [], None
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "form_n", "form"])

    for batch in batches:
        for size, suffix, affix, block, is_query, word, n in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if (size, suffix, affix, block) != cell:
                cell, words, counts, index = (size, suffix, affix, block), [], [], None
            if not is_query:
                words.append(word), counts.append(n)
                continue
            if index is None:
                index = PositionIndex(words)
            half = size // 2
            near = [i for i in index.near(word) if (len(words[i]) == size or len(word) == size) and (
                not suffix or words[i][:half] != word[:half])]
            if near:
                best = min(near, key=lambda i: (-counts[i], words[i]))
                out.append((word, len(near), counts[best], words[best]))
        yield flushed()


def variants(vocabulary: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, near_n, near): for every word of (word, n) its near words and the most frequent one.

    Ties go to the word that comes first in code-point order; words without near words have n_near 0 and nulls.
    Words are taken to have at least two letters and to be distinct.
    """
    spark = vocabulary.sparkSession
    on_workers(spark)
    m = F.char_length("word")
    keys = F.array(*[
        F.struct((m - back).alias("size"), F.lit(suffix).alias("suffix"), affix(m - back).alias("affix"))
        for back in (0, 1) for suffix, affix in (
            (False, lambda size: F.substring("word", F.lit(1), (size / 2).cast("int"))),
            (True, lambda size: F.right("word", size - (size / 2).cast("int"))))])
    keyed = vocabulary.select("word", "n", F.inline(keys)).where("size > 1")
    cell = ["size", "suffix", "affix"]
    sizes = keyed.groupBy(*cell).agg(F.count("*").alias("members")).where("members > 1")
    keyed = cut(keyed.join(sizes, cell).withColumn("blocks", F.ceil(F.col("members") / F.lit(block_words)).cast("int")), "spelling-keys")
    as_index = keyed.select(*cell, F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("block"), F.lit(False).alias("is_query"), "word", "n")
    as_query = keyed.select(*cell, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_query"), "word", "n")
    cells = as_index.union(as_query).repartition(*cell, "block").sortWithinPartitions(*cell, "block", "is_query")
    found = cells.mapInArrow(_searched, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return vocabulary.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near"))


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last one, twice as far each round.

    A form is more frequent than its word, so there are no cycles, and rounds are few: the length of a chain is
    at most the logarithm of the largest count.
    """
    steps = cut(forms, "spelling-forms")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
                     "spelling-roots")
        if not longer.where("moved").take(1):
            return longer.select("word", "root")
        steps = longer.select("word", "root")


def group_spellings(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, ratio: int = 5, damage: int = 0,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of the texts with the form it is a variant of.

    A word's form is its most frequent near word (ties: first in code-point order) if that occurs `ratio` times
    as often or more; the root is the last of the forms of forms.  Defined cases: null and empty texts hold no
    words; rows that repeat an id or a text count like any others; a null id counts as -2^63; an empty table
    gives an empty result; texts of any length are read whole; other columns are ignored, whatever their names.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent as its variants")
    vocabulary = cut(word_counts(df, id_col, text_col, min_chars, min_count, damage), "spelling-words")
    near = cut(variants(vocabulary), "spelling-near")
    is_variant = F.col("near_n") >= F.col("n") * F.lit(ratio)
    near = near.withColumns({"form": F.when(is_variant, F.col("near")), "form_n": F.when(is_variant, F.col("near_n"))})
    roots = _rooted(near.where("form is not null").select("word", F.col("form").alias("root")))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
