"""Byte-level BPE over a rank file, run by a sentencepiece model that is written directly from the ranks.

Every byte stands for one code point (0x100 + byte), every vocabulary entry for one piece of the model whose
score is its negative rank, and the normaliser does nothing.  Merging the best-scored pair first is then the
same as merging the lowest-ranked pair first.  A pre-token that is an entry itself is that entry, whether or
not merges reach it.  Ids are turned back into bytes by the inverse of the mapping.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from statloom.llm.chunks import ChunkCodes
from statloom.llm.common import fresh, on_workers
from statloom.llm.words import by_bytes

BYTE_BASE = 0x100


def read_ranks(path: str) -> dict[bytes, int]:
    """The entries of a rank file: base64 of the bytes, a blank, the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in lines if line.strip())}


def spelled(data: bytes) -> str:
    return data.decode("latin-1").translate(_SPELLING)


_SPELLING = {b: BYTE_BASE + b for b in range(256)}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose i-th piece is the i-th entry by rank; the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for entry, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece=spelled(entry), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t, n = model.trainer_spec, model.normalizer_spec
    t.model_type, t.vocab_size = pb.TrainerSpec.BPE, len(model.pieces)
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = len(ranks), -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


@functools.cache
def _classes() -> dict[str, str]:
    r"""Character classes \p{L}, \p{N} and \s as the tiktoken library has them; its Unicode version may differ
    from that of the regex module."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        found = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        points = sorted(set(map(ord, bytes(found.encode_ordinary(every)).decode())))
        spans: list[list[int]] = []
        for p in points:
            if spans and spans[-1][1] == p - 1:
                spans[-1][1] = p
            else:
                spans.append([p, p])
        out[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return out


def pre_token_pattern(pattern: str):
    r"""The pattern with its classes spelled out; \S stands for what \s leaves."""
    import regex

    c = _classes()
    inside = lambda m: m[0].replace(r"\p{L}", c[r"\p{L}"]).replace(r"\p{N}", c[r"\p{N}"]).replace(r"\s", c[r"\s"])
    text = regex.sub(r"\[[^\]]*\]", inside, pattern.replace(r"\S", "\0"))
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        text = text.replace(name, f"[{c[name]}]")
    return regex.compile(text.replace("\0", f"[^{c[chr(92) + 's']}]"))


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.by_piece = array("I", sorted(ranks.values()))
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.pattern = pre_token_pattern(pattern)
        self.entry = {rank: entry for entry, rank in ranks.items()}

    def ids(self, text: str) -> array:
        """The ids of one text."""
        out = array("I")
        for token in self.pattern.findall(text):
            data = token.encode()
            rank = self.ranks.get(data)
            if rank is None:
                out.extend(map(self.by_piece.__getitem__, self.pieces.encode(spelled(data), num_threads=1)))
            else:
                out.append(rank)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return np.array(self.ids(text), dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entry.__getitem__, array("I", ids)))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary file; workers keep it, but no codes of texts, between tasks."""
    return Codec(read_ranks(path), pattern)


def encode_and_decode(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", n_out: str = "n_tokens", ids_out: str = "ids",
    decoded_out: str = "decoded", keep: list[str] | None = None,
) -> DataFrame:
    """Add the ids of every text (unsigned 32-bit, little-endian), their number, and the bytes they decode to.

    `path` is a rank file that is installed on every worker.  `keep` names the input columns to carry along
    (all by default).  Defined cases: a null or empty text has no ids and decodes to no bytes; columns of the
    input that bear the names of the outputs are replaced; texts of any length are encoded whole.
    """
    on_workers(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in (n_out, ids_out, decoded_out)]
    work = fresh(df, "bpe_text")
    frame = df.select(*[df[f"`{c.replace('`', '``')}`"] for c in keep], df[f"`{text_col}`"].alias(work))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField(n_out, T.LongType()), T.StructField(ids_out, T.BinaryType()),
                           T.StructField(decoded_out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        codes = ChunkCodes(c.ids, "<u4")
        for batch in batches:
            for part in by_bytes(batch, batch.num_columns - 1):
                flat, n = codes(part.column(part.num_columns - 1))
                ends = np.cumsum(n)
                ids = [flat[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                new = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], [*part.schema.names[:-1], n_out, ids_out, decoded_out])

    return frame.mapInArrow(run, schema)
