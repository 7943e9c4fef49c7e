"""Words of whole batches of texts as arrays: byte positions, texts they belong to, and 64-bit hashes.

Texts are joined by line feeds, so no word spans two texts.  A hash stands for a word; two different words of one
vocabulary of a million share a hash with a probability of 3e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LETTER, BREAK, END = 0, 1, 2
SLICE_BYTES = 4 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of more bytes are hashed one by one.
LONG = 128


def byte_classes(breaks: bytes, ends: bytes = b"") -> np.ndarray:
    """The class of every byte: part of a word, between words, or the end of a piece of words."""
    out = np.zeros(256, dtype=np.uint8)
    out[list(breaks)] = BREAK
    out[list(ends)] = END
    return out


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix)."""
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows whose texts hold at most `limit` bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a slice of texts; `first[t]` is the first word of text t, `first[-1]` their number."""

    def __init__(self, texts: pa.Array, classes: np.ndarray, lower: bool = False, hashed: bool = True):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), pa.scalar("\n", pa.large_string()))[0]
        data = np.frombuffer(whole.as_buffer(), dtype=np.uint8) if len(texts) else np.zeros(0, dtype=np.uint8)
        self.data = LOWER[data] if lower else data
        kinds = classes[self.data]
        text_start = np.cumsum(lengths + 1) - lengths - 1
        self.start, self.end = self._bounds(kinds, text_start, lengths)
        self.first = np.append(np.searchsorted(self.start, text_start), len(self.start))
        #: whether a word begins a piece: no word before it belongs to the same piece
        self.opens = np.zeros(len(self.start) + 1, dtype=bool)
        self.opens[np.searchsorted(self.start, np.flatnonzero(kinds == END))] = True
        self.opens[self.first] = True
        self.opens = self.opens[:-1]
        if hashed:
            self.hash = self._hashes()

    def _bounds(self, kinds: np.ndarray, text_start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and ends of the words."""
        inside = np.zeros(len(kinds) + 2, dtype=bool)
        inside[1:-1] = self._inside(kinds)
        return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])

    def _inside(self, kinds: np.ndarray) -> np.ndarray:
        return kinds == LETTER

    def _hashes(self) -> np.ndarray:
        """One number per word, from its bytes in steps of eight."""
        size = self.end - self.start
        padded = np.zeros(len(self.data) + 16, dtype=np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray((len(self.data) + 8,), dtype="<u8", buffer=padded, strides=(1,))
        keep = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
        out = size.astype(np.uint64) * GOLD
        with np.errstate(over="ignore"):
            out = mixed(out ^ (eight[self.start] & keep[np.minimum(size, 8)]))
            live = np.flatnonzero((size > 8) & (size <= LONG))
            at = 8
            while len(live):
                out[live] = mixed((out[live] + GOLD) ^ (eight[self.start[live] + at] & keep[np.minimum(size[live] - at, 8)]))
                at += 8
                live = live[size[live] > at]
        for i in np.flatnonzero(size > LONG):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return out

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def strings(self, which: np.ndarray | None = None) -> pa.Array:
        """The words at the places `which` (all, if none are named)."""
        start, end = (self.start, self.end) if which is None else (self.start[which], self.end[which])
        size = end - start
        offsets = np.concatenate([[0], np.cumsum(size)])
        if which is None:
            marks = np.zeros(len(self.data) + 1, dtype=np.int8)
            marks[start] += 1
            marks[end] -= 1
            taken = self.data[np.cumsum(marks[:-1], dtype=np.int8).view(bool)]
        else:
            taken = self.data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken))
