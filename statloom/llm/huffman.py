"""Token ids in files: canonical Huffman codes of limited length, decoded by table.

A file is a Parquet table of blocks.  A block holds whole documents in order: their ids and lengths, the
packed codes of their ids one after the other, and the bit offset of every CHECKPOINT-th id.  A block is
decoded without any other block, and within it the stretches between two checkpoints side by side.  The code
lengths, one byte per id, are a table of their own; they are all that is needed to rebuild the codes.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.chunks import ChunkCodes
from statloom.llm.common import col, cut, on_workers, saved_path
from statloom.llm.words import by_bytes

CHECKPOINT = 128
BLOCK_IDS = 1 << 18
LONGEST = 16

#: Letters of one script with at most one blank before them are a single pre-token, and the marks that follow
#: them are another; no apostrophe, which may begin a suffix.
PLAIN_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!\"#$%&()*+,\-./:;<=>?@\[\]^_`{|}~]*)")
#: The published spelling of bytes in byte-level vocabularies: printable ones stand for themselves, the others follow 0x100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SPELLING = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
BLANK = chr(BYTE_SPELLING[0x20])

RAW = "part int, block long, first long, doc_ids array<bigint>, lengths array<bigint>, ids binary"
BLOCK = "part int, block long, first long, doc_ids array<bigint>, lengths array<bigint>, bits long, payload binary, checkpoints binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    longest = max(longest, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, merged = [], weights
    is_leaf = np.ones(len(weights), dtype=bool)
    levels.append(is_leaf)
    for _ in range(longest - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        levels.append(rank < len(weights))
    take, lengths = 2 * len(weights) - 2, np.zeros(len(weights), dtype=np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: codes ascend by (length, id)."""
    codes, code, last = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits to look at, and by those bits the id and the length of its code."""
    top = max(int(lengths.max(initial=0)), 1)
    symbol, used = np.zeros(1 << top, dtype=np.uint32), np.ones(1 << top, dtype=np.uint8)
    codes = canonical(lengths)
    for i in np.flatnonzero(lengths):
        at, n = int(codes[i]) << (top - int(lengths[i])), 1 << (top - int(lengths[i]))
        symbol[at : at + n], used[at : at + n] = i, lengths[i]
    return top, symbol, used


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[int, bytes, bytes]:
    """Bits, packed bytes (most significant bit first) and bit offsets of the checkpoints."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ids) else 0
    word, bit = starts >> 5, starts & 31
    value = codes[ids] << (64 - n - bit).astype(np.uint64)
    size = (total >> 5) + 2
    # codes never share a bit, so adding is the same as setting
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size) + np.bincount(
        word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    data = words.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8]
    return total, data, starts[::CHECKPOINT].astype("<i8").tobytes()


def unpack(n: int, payload: bytes, checkpoints: bytes, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a block, all stretches between checkpoints in step."""
    top, symbol, used = table
    data = payload + bytes(12 - len(payload) % 4)
    words = np.frombuffer(data, dtype=">u4").astype(np.uint64)
    window = (words[:-1] << np.uint64(32)) | words[1:]
    at = np.frombuffer(checkpoints, dtype="<i8").copy()
    out = np.zeros((CHECKPOINT, len(at)), dtype=np.uint32)
    whole, rest = n // CHECKPOINT, n % CHECKPOINT
    down = np.uint64(64 - top)
    for step in range(CHECKPOINT if whole else rest):
        if step == rest and whole < len(at):
            at = at[:whole]  # the last stretch is over
        seen = (window[at >> 5] << (at & 31).astype(np.uint64)) >> down
        out[step, : len(at)] = symbol[seen]
        at += used[seen]
    return out.T.reshape(-1)[:n]


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    """One tokenizer per worker, as the library loads it; ids of plain words skip its pre-tokenizer."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    merges = t.model

    @functools.lru_cache(maxsize=4096)
    def marks(text: str) -> list[int]:
        return t.encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        plain = PLAIN_WORD.fullmatch(text)
        if plain is None:
            return t.encode(text, add_special_tokens=False).ids
        word, rest = plain.groups()  # one pre-token: straight to the merges
        if word.isascii():
            spelled = word.replace(" ", BLANK)
        else:
            spelled = word.encode().decode("latin-1").translate(BYTE_SPELLING)
        ids = [x.id for x in merges.tokenize(spelled)]
        return ids + marks(rest) if rest else ids

    return t, encode, np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4")


class TextIds:
    """Ids of whole texts.  Texts that hold the string of a special token are handed to the library as they are."""

    def __init__(self, path: str):
        self.tokenizer, encode, self.dtype = _tokenizer(path)
        self.codes = ChunkCodes(encode, self.dtype)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = "|".join(re.escape(x.content) for x in added if x.content)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        held = pc.match_substring_regex(texts, self.special) if self.special else pa.array(np.zeros(len(texts), dtype=bool))
        flat, n = self.codes(pc.if_else(held, "", texts))
        ends = np.cumsum(n)
        out = [flat[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
        for i in np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=self.dtype)
        return out


@functools.lru_cache(maxsize=2)
def _text_ids(path: str) -> TextIds:
    """One per worker: words that its earlier tasks met are not encoded again; what it keeps is bounded (see `chunks`)."""
    return TextIds(path)


def _raw_blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _text_ids(path)
        dtype = ids_of.dtype
        end, part = np.array([end_id], dtype=dtype).tobytes(), TaskContext.get().partitionId()
        docs, lengths, pieces, held, first, block = [], [], [], 0, 0, 0

        def flush():
            row = [[part], [block], [first], [docs], [lengths], [b"".join(pieces)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["part", "block", "first", "doc_ids", "lengths", "ids"])

        for batch in batches:
            for rows in by_bytes(batch, 1):
                for doc_id, ids in zip(rows.column(0).to_pylist(), ids_of(rows.column(1))):
                    docs.append(doc_id), lengths.append(len(ids) + 1), pieces.append(ids.tobytes() + end)
                    held += lengths[-1]
                    if held >= BLOCK_IDS:
                        yield flush()
                        first, block = first + held, block + 1
                        docs, lengths, pieces, held = [], [], [], 0
        if docs:
            yield flush()

    return run


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _, dtype = _tokenizer(path)
        size = t.get_vocab_size()
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), dtype=dtype), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return run


def _packed(path: str, lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = _tokenizer(path)[2]
        codes = canonical(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                bits, payload, marks = pack(np.frombuffer(batch.column(5)[i].as_buffer(), dtype=dtype), lengths, codes)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:5], pa.array([bits], pa.int64()), pa.array([payload], pa.binary()), pa.array([marks], pa.binary())],
                    [*row.schema.names[:5], "bits", "payload", "checkpoints"])

    return run


def write_ids(df: DataFrame, folder: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
              longest: int = LONGEST) -> None:
    """Encode every whole text, append `end_id`, and write the ids in ascending id order below `folder`.

    `path` is a tokenizer file installed on every worker.  Documents are range-partitioned on (id, hash of the
    text), so that not even a repeated id holds up one task, and encoded once; the counts of all ids make the
    code.  Only the counts (one number per vocabulary entry) and the ids per partition reach the driver.
    Defined cases: a null or empty text is the end id alone; a null id comes first; rows that repeat an id
    follow one another in the order of their text's hash; other columns are ignored, whatever their names; a very
    long text is one document of its block, encoded whole; an empty table makes empty files.  Strings of special
    tokens inside a text become those tokens, as the library has it by default.
    """
    spark = df.sparkSession
    on_workers(spark)
    rows = df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).withColumns({
        "th": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("salt")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    raw = cut(laid.select("doc_id", "text").mapInArrow(_raw_blocks(path, end_id), RAW), "token-ids")
    counted = raw.select("ids").mapInArrow(_counts(path), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    at, n = counted.column("id").to_numpy(), counted.column("n").to_numpy()
    counts = np.zeros(int(at.max(initial=0)) + 1, dtype=np.int64)
    counts[at] = n
    lengths = code_lengths(counts, longest)
    raw.mapInArrow(_packed(path, lengths), BLOCK).write.parquet(f"{folder}/blocks")
    spark.createDataFrame(pa.table({"code_lengths": pa.array([lengths.tobytes()], pa.binary())})).write.parquet(f"{folder}/code")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of the files, ids as unsigned 32-bit little-endian."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids binary", ("ids", pa.binary(), lambda x: x.astype("<u4").tobytes()))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """As read_ids, with the crc32 of each document's ids in place of the ids."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long",
                 ("ids_crc32", pa.int64(), lambda x: zlib.crc32(x.astype("<u4").tobytes())))


def _read(spark: SparkSession, folder: str, schema: str, last: tuple) -> DataFrame:
    on_workers(spark)
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/code").first()["code_lengths"], dtype=np.uint8)
    blocks = spark.read.parquet(f"{folder}/blocks")
    per_part = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    before, base = 0, {}
    for part, n in sorted(map(tuple, per_part.collect())):  # one number for each partition of the writer
        base[part], before = before, before + n
    name, kind, made = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time
                r = batch.slice(i, 1).to_pylist()[0]
                n = np.array(r["lengths"], dtype=np.int64)
                ids = unpack(int(n.sum()), r["payload"], r["checkpoints"], table)
                ends = np.cumsum(n)
                starts = ends - n + (base[r["part"]] + r["first"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(n),
                    pa.array([made(ids[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())], kind),
                ], ["doc_id", "start", "n_tokens", name])

    return blocks.mapInArrow(run, schema)


def store_ids(df: DataFrame, path: str, **options) -> str:
    """write_ids into a new folder of the cluster's shared storage; returns the folder."""
    folder = saved_path(df.sparkSession, "huffman")
    write_ids(df, folder, path, **options)
    return folder
