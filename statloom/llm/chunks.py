"""Tokenize whole texts by looking up their blank-separated chunks.

A single blank between two other characters that are not white space always begins a new pre-token under
the byte-level patterns, so a text may be cut there and the ids of the chunks put together.  Chunks repeat
far more often than texts: each distinct chunk of a slice of texts is encoded once, and the ids of all
chunks are then gathered by position.  The codes of chunks seen before are kept in sorted arrays of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa

from statloom.llm.words import Words

CACHE_BYTES = 20 << 20
#: Longer chunks seldom repeat.
KEPT_BYTES = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes of characters some of which are white space; no text is cut beside any of them.
_TWO, _THREE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_TWO[0xC2] = True
_THREE[[0xE1, 0xE2, 0xE3]] = True
_NO_CLASSES = np.zeros(256, dtype=np.uint8)


class Chunks(Words):
    """The chunks of a slice of texts; all but the first of a text begin with their blank."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, _NO_CLASSES)

    def _bounds(self, kinds: np.ndarray, text_start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.data
        blank = np.flatnonzero(d == 0x20)
        inner = (blank > 0) & (blank < len(d) - 1)
        blank = blank[inner]
        last, following = d[blank - 1], d[blank + 1]
        apart = _SPACE[last] | _SPACE[following] | _TWO[following] | _THREE[following]
        apart |= (last >= 0x80) & (_TWO[d[np.maximum(blank - 2, 0)]] | _THREE[d[np.maximum(blank - 3, 0)]])
        start = np.sort(np.concatenate([blank[~apart], text_start[lengths > 0]]))
        ends = np.append(start[1:], 0)
        if len(start):
            ends[-1] = len(d)
        # the last chunk of a text ends before the line feed that joins the texts
        text_end = text_start + lengths
        ends = np.minimum(ends, text_end[np.searchsorted(text_start, start, side="right") - 1])
        return start, ends


class ChunkCodes:
    """Ids of whole texts; `encode` maps a piece of text to its ids.  One object serves one task."""

    def __init__(self, encode: Callable[[str], list[int]], dtype, cache_bytes: int = CACHE_BYTES):
        self.encode, self.dtype, self.most = encode, np.dtype(dtype), cache_bytes
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.at, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(0, dtype=self.dtype)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        c = Chunks(texts)
        if not len(c.start):
            return np.zeros(0, dtype=self.dtype), np.zeros(len(texts), dtype=np.int64)
        code, distinct = pd.factorize(c.hash)
        first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
        place = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        seen = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), dtype=bool)
        new = first[~seen]
        lists = [self.encode(x) for x in c.strings(new).to_pylist()]
        sizes = np.array([len(x) for x in lists], dtype=np.int32)
        fresh = np.fromiter((i for x in lists for i in x), dtype=self.dtype, count=int(sizes.sum()))
        ids = np.concatenate([self.ids, fresh])
        at, size = np.empty(len(distinct), dtype=np.int64), np.empty(len(distinct), dtype=np.int32)
        at[seen], size[seen] = self.at[place[seen]], self.size[place[seen]]
        at[~seen], size[~seen] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        n = size[code].astype(np.int64)
        ends = np.cumsum(n)
        out = ids[np.repeat(at[code] - ends + n, n) + np.arange(int(ends[-1]))]
        per_text = np.diff(np.concatenate([[0], ends])[c.first])
        self._keep(distinct[~seen], at[~seen], sizes, ids, (c.end - c.start)[new] <= KEPT_BYTES)
        return out, per_text

    def _keep(self, hashes: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray, short: np.ndarray) -> None:
        if ids.nbytes + 20 * (len(self.known) + len(hashes)) > self.most:
            self._forget()
            return
        known, at, size = (np.concatenate(x) for x in ((self.known, hashes[short]), (self.at, at[short]), (self.size, size[short])))
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.size, self.ids = known[order], at[order], size[order], ids
