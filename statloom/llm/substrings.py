"""Repeated passages: windows of words that an earlier document holds are found by an FM-index per shard and removed.

1. The seeds of a window are its runs of SEED words; the one with the smallest hash is its anchor, so that equal
   windows have equal anchors and neighbouring windows mostly share theirs.  Anchors that occur in one document
   only cannot belong to a repeated window; the others are noted in a bitmap of bounded size.
2. Neighbouring windows with the same noted anchor make a stretch.  Equal stretches of a slice of documents are
   one entry with their smallest id, and entries are dealt out to shards by their anchor.  An anchor that very many
   documents hold would make one shard too large: its windows are entries of their own, dealt out by the whole window.
3. A shard indexes its distinct stretches and streams them through the index by backward search.  It reports, per
   entry, the smallest id with that stretch, and which of its windows an even smaller id holds.
4. The reports go back to the slices and become spans of words per document.

So every text crosses the network only as those stretches whose anchor repeats, and no pairs are ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.bitmaps import Bitmap, bitmap_of
from statloom.llm.common import col, cut, fresh, on_workers
from statloom.llm.fm_index import FmIndex
from statloom.llm.words import GOLD, Words, by_bytes, byte_classes, mixed

#: Fixed by the contract: the characters between words.
BLANKS = b" \t\n\x0b\x0c\r"
LEAST_ID = -(2**63)
SEED = 5
#: Most windows of a stretch; they fit the 16 bits of its report.
MOST_WINDOWS = 13
#: Words that a shard should hold, before equal stretches are put together.
SHARD_WORDS = 2_000_000
#: An anchor of so many documents has its windows dealt out one by one.
HOT_DOCS = 10_000
#: Spans of at most so many bytes in all are broadcast to the texts.
BROADCAST_BYTES = 32 << 20
_CLASSES = byte_classes(BLANKS)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

DEALT = "part int, block long, ids binary, hashes binary, firsts binary, sizes binary, words binary, codes binary"


class Windows:
    """The words of a slice of documents, and of each whole window of `n` words its document, hash and anchor."""

    def __init__(self, texts: pa.Array, n: int):
        self.words = Words(texts, _CLASSES)
        self.n = n
        h = self.words.hash
        seed = min(SEED, n)
        starts = max(len(h) - n + 1, 0)
        per_text = np.diff(self.words.first)
        last_start = np.repeat(self.words.first[1:], per_text) - n
        self.at = np.flatnonzero(np.arange(len(h)) <= last_start)  # first words of windows
        self.text = self.words.text_of()[self.at]
        if not starts:
            self.hash = self.anchor = np.zeros(0, dtype=np.uint64)
            return
        with np.errstate(over="ignore"):
            s = h[: len(h) - seed + 1]
            for k in range(1, seed):
                s = s * _A + h[k : len(h) - seed + 1 + k]
            s = mixed(s)
            whole = s[:starts]
            for k in range(seed, n, seed):
                whole = mixed(whole * _B + s[min(k, n - seed) :][:starts])
        least, reach, seeds = s, 1, n - seed + 1
        while reach < seeds:  # smallest of `seeds` neighbours, twice as many each time
            step = min(reach, seeds - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        self.hash, self.anchor = whole[self.at], least[self.at]

    def stretches(self, noted: Bitmap, hot: Bitmap) -> Stretches:
        return Stretches(self, noted, hot)


class Stretches:
    """Runs of neighbouring windows with one anchor that is noted: first window, number of windows, hash, shard hash."""

    def __init__(self, w: Windows, noted: Bitmap, hot: Bitmap):
        keep = np.flatnonzero(noted.holds(w.anchor))
        at, text, anchor = w.at[keep], w.text[keep], w.anchor[keep]
        alone = hot.holds(anchor)
        new = np.ones(len(keep), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | alone[1:]
        runs = np.flatnonzero(new)
        length = np.diff(np.append(runs, len(keep)))
        pieces = -(-length // MOST_WINDOWS)  # runs that are longer are cut
        piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(runs, pieces) + piece * MOST_WINDOWS
        self.windows = np.minimum(np.repeat(runs + length, pieces) - begin, MOST_WINDOWS)
        self.first, self.text = at[begin], text[begin]
        with np.errstate(over="ignore"):
            own = w.hash[keep]
            self.hash = mixed((own[begin] * _A + own[begin + self.windows - 1]) * _B + self.windows.astype(np.uint64))
            self.route = mixed(np.where(alone[begin], own[begin], anchor[begin]) + GOLD)

    def entries(self, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct stretches by (part, hash): one place of each, the smallest id, and the entry of every stretch."""
        part = (self.route >> np.uint64(64 - bits)).astype(np.int64)
        order = np.lexsort((ids[self.text], self.hash, part))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.hash[order[1:]] != self.hash[order[:-1]]) | (part[order[1:]] != part[order[:-1]])
        entry = np.empty(len(order), dtype=np.int64)
        entry[order] = np.cumsum(new) - 1
        self.part = part
        return order[new], ids[self.text[order[new]]], entry


def _anchors(n: int, bits: int):
    """Per slice and hash range: anchors, and in how many documents of the slice they occur (255 at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_ in by_bytes(batch, 2):
                ids = slice_.column(0).to_numpy(zero_copy_only=False)
                w = Windows(slice_.column(2), n)
                order = np.lexsort((ids[w.text], w.anchor))
                anchor, owner = w.anchor[order], ids[w.text[order]]
                new = np.ones(len(order), dtype=bool)
                new[1:] = anchor[1:] != anchor[:-1]
                docs = new.copy()
                docs[1:] |= owner[1:] != owner[:-1]
                at = np.flatnonzero(new)
                count = np.add.reduceat(docs.astype(np.int64), at) if len(at) else at
                anchor, count = anchor[at], np.minimum(count, 255).astype(np.uint8)
                part = (anchor >> np.uint64(64 - bits)).astype(np.int64)
                names, first = np.unique(part, return_index=True)
                ends = np.append(first, len(part))[1:]
                blobs = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), blobs(anchor), blobs(count)], ["part", "anchors", "counts"])

    return run


def _merged(hot_docs: int):
    """Per hash range: the anchors of two or more documents, and those of very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pending, size = None, [], 0

        def merged():
            nonlocal size
            a, c = (np.concatenate(x) for x in zip(*pending))
            order = np.argsort(a, kind="stable")
            a, c = a[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)
            a, c = a[at], np.add.reduceat(c, at) if len(at) else c
            pending[:] = [(a, c)]
            size = len(a)

        def done() -> pa.RecordBatch:
            merged()
            a, c = pending[0]
            more, many = a[c > 1], a[c > hot_docs]
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([len(more)], pa.int64()), pa.array([more.tobytes()], pa.binary()),
                pa.array([len(many)], pa.int64()), pa.array([many.tobytes()], pa.binary())], ["part", "n", "hashes", "n_hot", "hot"])

        for batch in batches:
            for p, a, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if p != part:
                    if pending:
                        yield done()
                    part, pending, size = p, [], 0
                pending.append((np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(c.as_buffer(), dtype=np.uint8).astype(np.int64)))
                size += len(pending[-1][0])
                if len(pending) > 1 and size > 2 * len(pending[0][0]) + 500_000:
                    merged()
        if pending:
            yield done()

    return run


def _dealt(n: int, bits: int, maps):
    """Per slice, one row for every shard with its entries, and one row (part -1) that tells what became an entry.

    Rows of a shard: smallest ids, hashes, numbers of windows and words of the entries, the words as codes of a list of
    hashes.  Row -1: ids and hashes of the texts, numbers of their words, and of all stretches the text, first word in
    it, number of windows, shard and entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noted, hot = (Bitmap(*m) for m in maps.value)
        task, count = TaskContext.get().partitionId(), 0
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        names = [x.split()[0] for x in DEALT.split(", ")]
        for batch in batches:
            for slice_ in by_bytes(batch, 2):
                ids, th = (slice_.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                w = Windows(slice_.column(2), n)
                s = w.stretches(noted, hot)
                if not len(s.first):
                    continue
                place, least, entry = s.entries(ids, bits)
                block = xxhash.xxh3_64_intdigest(ids.tobytes() + th.tobytes() + task.to_bytes(8, "little") + count.to_bytes(8, "little")) >> 1
                count += 1
                part = s.part[place]
                shards, first = np.unique(part, return_index=True)
                ends = np.append(first, len(part))[1:]
                rows = []
                for p, a, b in zip(shards.tolist(), first.tolist(), ends.tolist()):
                    size = s.windows[place[a:b]] + n - 1
                    at = np.repeat(s.first[place[a:b]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                    distinct, codes = np.unique(w.words.hash[at], return_inverse=True)
                    codes = codes.astype("<u2" if len(distinct) <= 1 << 16 else "<u4")
                    rows.append((p, block, least[a:b].tobytes(), s.hash[place[a:b]].tobytes(), b"", s.windows[place[a:b]].astype(np.uint8).tobytes(),
                                 distinct.tobytes(), codes.tobytes()))
                within = entry - first[np.searchsorted(shards, s.part)]
                own = np.stack([s.text, s.first - w.words.first[s.text], s.windows, s.part, within]).astype("<i4")
                rows.append((-1, block, ids.tobytes(), th.tobytes(), own.tobytes(), b"", b"", b""))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return run


def _reported(n: int):
    """Per shard, for the entries of every slice: smallest id of the stretch, and a bit for every window that an even
    smaller id holds.  Rows of part -1 pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def reports() -> Iterator[pa.RecordBatch]:
            number = lambda blob, kind: np.frombuffer(blob, dtype=kind)
            blocks = [h[0] for h in held]
            count = [len(h[2]) // 8 for h in held]
            ids, hashes = (np.concatenate([number(h[k], kind) for h in held]) for k, kind in ((1, np.int64), (2, np.uint64)))
            windows = np.concatenate([number(h[3], np.uint8) for h in held]).astype(np.int64)
            lists = [number(h[4], np.uint64) for h in held]
            vocabulary, code = np.unique(np.concatenate(lists), return_inverse=True)
            starts = np.cumsum([len(x) for x in lists]) - [len(x) for x in lists]
            words = np.concatenate([
                code[a + number(h[5], "<u2" if len(x) <= 1 << 16 else "<u4").astype(np.int64)] for h, a, x in zip(held, starts, lists)]).astype(np.int32)
            del lists, code
            held.clear()
            size = windows + n - 1
            begin = np.cumsum(size) - size
            # distinct stretches, each with its smallest id
            order = np.lexsort((ids, hashes))
            new = np.ones(len(order), dtype=bool)
            new[1:] = hashes[order[1:]] != hashes[order[:-1]]
            which = np.empty(len(order), dtype=np.int64)
            which[order] = np.cumsum(new) - 1
            one = order[new]
            least, size, begin = ids[one], size[one], begin[one]
            row = np.zeros(int(size.sum()) + len(one), dtype=np.int64)
            first = np.cumsum(size + 1) - size - 1
            to = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            row[to] = words[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] + 1
            del words
            index = FmIndex(row, np.repeat(least, size + 1), n)
            found = index.least_of_windows(row, first, size, MOST_WINDOWS)
            marks = ((found < least[:, None]) << np.arange(MOST_WINDOWS)).sum(axis=1).astype("<u2")
            ends = np.cumsum(count)
            for k, (block, e, c) in enumerate(zip(blocks, ends.tolist(), count)):
                mine = which[e - c : e]
                yield row_of(part, block, least[mine].tobytes(), marks[mine].tobytes(), b"")

        def row_of(*row) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["part", "block", "ids", "hashes", "firsts"])

        for batch in batches:
            for i, p in enumerate(batch.column(0).to_pylist()):
                value = lambda k: batch.column(k)[i].as_py()  # noqa: B023, E731
                if p != part and held:
                    yield from reports()
                part = p
                if p < 0:
                    yield row_of(p, *(value(k) for k in range(1, 5)))
                else:
                    held.append([value(k) for k in (1, 2, 3, 5, 6, 7)])
        if held:
            yield from reports()

    return run


def _spans(n: int):
    """Per document with repeated windows: the stretches of words to remove, as first and end words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, reports = None, None, {}

        def spans() -> pa.RecordBatch:
            ids, th, stretches = own
            ids, th = (np.frombuffer(x, dtype=np.int64) for x in (ids, th))
            text, first, windows, part, entry = np.frombuffer(stretches, dtype="<i4").reshape(5, -1).astype(np.int64)
            least, marks = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
            for p in np.unique(part).tolist():
                if p not in reports:
                    raise RuntimeError("a slice of documents was read differently the second time")
                mine = part == p
                least[mine] = np.frombuffer(reports[p][0], dtype=np.int64)[entry[mine]]
                marks[mine] = np.frombuffer(reports[p][1], dtype="<u2")[entry[mine]]
            gone = np.where(least < ids[text], (1 << windows) - 1, marks)
            stretch = np.repeat(np.arange(len(text)), windows)
            k = np.arange(len(stretch)) - np.repeat(np.cumsum(windows) - windows, windows)
            hit = ((gone[stretch] >> k) & 1).astype(bool)
            at, owner = first[stretch[hit]] + k[hit], text[stretch[hit]]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + n)
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(at)) - 1
            pairs = np.stack([at[begin], at[last] + n], axis=1).astype("<i4") if len(at) else np.zeros((0, 2), dtype="<i4")
            docs, start = np.unique(owner[begin], return_index=True)
            end = np.append(start, len(begin))[1:]
            return pa.RecordBatch.from_arrays([
                pa.array(ids[docs]), pa.array(th[docs]), pa.array([pairs[a:b].tobytes() for a, b in zip(start, end)], pa.binary())], ["id", "th", "spans"])

        for batch in batches:
            for i, (p, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if b != block:
                    if own:
                        yield spans()
                    block, own, reports = b, None, {}
                if p < 0:
                    own = [batch.column(k)[i].as_py() for k in (2, 3, 4)]
                else:
                    reports[p] = [batch.column(k)[i].as_py() for k in (2, 3)]
        if own:
            yield spans()

    return run


def repeated_spans(
    df: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, hot_docs: int = HOT_DOCS,
) -> DataFrame:
    """(id, th, spans): for documents (id, hash of the text) with windows of `words` words that also begin in a document
    with a smaller id, the words to remove: first and end word of each span, as pairs of 32-bit little-endian numbers.

    The table is read twice and must give the same rows both times, as stored tables do.
    """
    spark = df.sparkSession
    on_workers(spark)
    rows = _keyed(df, id_col, text_col)
    # shards by the size of the texts, at about six bytes a word
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(3, (usual - 1).bit_length(), int(n_bytes // 6 // shard_words).bit_length())
    counted = rows.mapInArrow(_anchors(words, bits), "part int, anchors binary, counts binary")
    counted = counted.repartition(1 << bits, "part").sortWithinPartitions("part")
    noted = cut(counted.mapInArrow(_merged(hot_docs), "part int, n long, hashes binary, n_hot long, hot binary"), "passage-anchors")
    maps = spark.sparkContext.broadcast((bitmap_of(noted, bits), bitmap_of(noted, bits, "hot", "n_hot")))
    dealt = rows.mapInArrow(_dealt(words, bits, maps), DEALT)
    # rows of part -1 are not bound for a shard: they go by their block
    dealt = dealt.repartition(1 << bits, "part", F.when(F.col("part") < 0, F.col("block"))).sortWithinPartitions("part")
    reports = cut(dealt.mapInArrow(_reported(words), "part int, block long, ids binary, hashes binary, firsts binary"), "passage-reports")
    by_block = reports.repartition("block").sortWithinPartitions("block")
    return by_block.mapInArrow(_spans(words), "id long, th long, spans binary")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    return df.select(F.coalesce(col(id_col).cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _cut_out(names: list[str]):
    """Texts without their spans, the number of their words, and how many were removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text, at_spans = batch.num_columns - 2, batch.num_columns - 1
            for part in by_bytes(batch, at_text):
                w = Words(part.column(at_text), _CLASSES, hashed=False)
                total = np.diff(w.first)
                keep = np.ones(len(w.start) + 1, dtype=np.int64)
                for i, spans in enumerate(part.column(at_spans)):
                    if spans.is_valid:
                        for a, b in np.frombuffer(spans.as_buffer(), dtype="<i4").reshape(-1, 2) + w.first[i]:
                            keep[a:b] = 0
                kept = np.flatnonzero(keep[:-1])
                bounds = np.searchsorted(kept, w.first)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), w.strings(None if len(kept) == len(w.start) else kept).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-2], pc.binary_join(lists, " "), pa.array(total, pa.int64()), pa.array(total - np.diff(bounds), pa.int64())], names)

    return run


def remove_repeats(
    df: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text", words_out: str = "n_words", removed_out: str = "n_removed",
) -> DataFrame:
    """All rows and columns, the text without passages that a document with a smaller id holds, and two counts.

    Words are what lies between blanks; a window is `words` consecutive words of one document, and every word of a
    window that also begins in a document with a smaller id is removed.  All windows are judged on the input.  The
    words that stay are joined by single blanks.  Defined cases: null and empty texts hold no words and come back
    empty; a null id is smaller than all others; rows that share an id are one document, so they lose nothing to one
    another; texts of fewer words than a window stay whole; columns of the input that bear the names of the counts
    are replaced; texts of any length are read whole; an empty table gives an empty result.  Words and windows are
    told apart by 64-bit hashes.
    """
    if words < 2:
        raise ValueError("a window has at least two words")
    df = df.drop(words_out, removed_out)
    spans = cut(repeated_spans(df, words, id_col, text_col), "passage-spans")
    # repeated rows of one id and text give equal spans
    spans = spans.groupBy("id", "th").agg(F.first("spans").alias("spans"))
    i, t, s, x = (fresh(df, f"passage_{name}") for name in ("id", "hash", "spans", "text"))
    text = F.coalesce(col(text_col), F.lit(""))
    spans = spans.select(F.col("id").alias(i), F.col("th").alias(t), F.col("spans").alias(s))
    size = spans.agg(F.sum(F.octet_length(s) + 40)).first()[0] or 0
    keyed = df.withColumns({i: F.coalesce(col(id_col).cast("long"), F.lit(LEAST_ID)), t: F.xxhash64(text), x: text})
    joined = keyed.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, [i, t], "left")
    others = [c for c in df.columns if c != text_col]
    frame = joined.select(*[col(c) for c in others], x, s)
    schema = T.StructType([*frame.schema.fields[:-2], T.StructField(text_col, T.StringType()), T.StructField(words_out, T.LongType()),
                           T.StructField(removed_out, T.LongType())])
    out = frame.mapInArrow(_cut_out([f.name for f in schema.fields]), schema)
    return out.select(*[col(c) for c in df.columns], words_out, removed_out)
