"""Word shingles and BagMinHash signatures of texts, for whole batches at a time.

A text is the multiset of its runs of five words (lower-cased, split at white space); a shorter text is the one
run of the words it has.  BagMinHash lets every shingle of weight w drive Poisson processes over the discretised
weights 0, 1, 2, 4, 8, ...: the process of the interval [2^k, 2^(k+1)) has rate 2^k, so that heavy shingles cost
a logarithm of their weight.  A point falls into a random slot of the signature and a random place of its
interval; it counts if that place lies under w, which needs a look below the interval only where the interval
straddles w.  A slot keeps its earliest point.  Equal slots of two texts then have exactly the weighted Jaccard
similarity as their probability.  Points come in ascending order, and a process ends once its next point is later
than every slot of its text, so most shingles cost one point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5
GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix)."""
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


class Shingles:
    """Distinct shingles of a batch of texts, text by text, each with its count."""

    def __init__(self, texts: pa.Array, words: int = WORDS):
        with np.errstate(over="ignore"):
            self._build(texts, words)

    def _build(self, texts: pa.Array, words: int) -> None:
        flat = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
        ends = flat.offsets.to_numpy().astype(np.int64)
        coded = flat.values.dictionary_encode()
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
        word = hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, dtype=np.uint64)
        lengths = np.diff(ends)
        empty = pc.binary_length(flat.values).to_numpy(zero_copy_only=False) == 0
        lengths = np.where(lengths == 1, lengths - empty[ends[:-1]], lengths)  # an empty text splits into one empty word
        starts = ends[:-1]
        self.n_words = lengths
        self.digests = [xxhash.xxh3_128_digest(word[s : s + n].tobytes()) for s, n in zip(starts.tolist(), lengths.tolist())]
        count = np.where(lengths >= words, lengths - words + 1, np.minimum(lengths, 1))
        self.owner = np.repeat(np.arange(len(lengths)), count)
        first = np.cumsum(count) - count
        at = np.arange(int(count.sum())) - np.repeat(first - starts, count)
        size = np.minimum(lengths, words)[self.owner]
        total = size.astype(np.uint64) * GOLD
        for k in range(words):
            inside = size > k
            if inside.all():
                total += mixed(word[at + k] * _ODD[k % 5] + np.uint64(k))
            else:
                total[inside] += mixed(word[at[inside] + k] * _ODD[k % 5] + np.uint64(k))
        hashed = mixed(total)
        for a, n in zip(first.tolist(), count.tolist()):
            hashed[a : a + n].sort()
        new = np.ones(len(hashed), dtype=bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (self.owner[1:] != self.owner[:-1])
        place = np.flatnonzero(new)
        self.weight = np.diff(np.append(place, len(hashed)))
        self.hash, self.text = hashed[place], self.owner[place]
        self.size = count  # shingles with repeats


def signatures(s: Shingles, slots: int, chunk: int = 150_000) -> np.ndarray:
    """The signatures (texts x slots) of a batch; rows of texts without shingles stay infinite."""
    out = np.full((len(s.size), slots), np.inf)
    bounds = np.searchsorted(s.text, np.arange(len(s.size) + 1))
    at = 0
    with np.errstate(over="ignore"):
        while at < len(s.size):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + chunk)) - 1)
            a, b = bounds[at], bounds[to]
            if b > a:
                out[at:to] = _run(s.hash[a:b], s.weight[a:b], s.text[a:b] - at, to - at, slots)
            at = to
    return out


def _run(element: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """All processes of a stretch of texts, one point of each in every step."""
    parts, level, low = [], 0, 0
    live = np.arange(len(element))
    while len(live):
        parts.append((mixed(element[live] + GOLD * np.uint64(level + 1)), live, np.full(len(live), low), np.full(len(live), max(low, 1))))
        low = max(1, 2 * low)
        level += 1
        live = live[weight[live] > low]
    seed, origin, lows, width = (np.concatenate(x) for x in zip(*parts))
    row, weight = row[origin], weight[origin]
    early = np.full(rows * slots, np.inf)
    last = np.full(rows, np.inf)
    x = np.zeros(len(seed))
    step = 0
    straddles = (width > 1).any()
    while len(seed):
        step += 1
        z = mixed(seed + GOLD * np.uint64(2 * step))
        x = x - np.log(((z >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width
        keep = x < last[row]
        if not keep.all():
            seed, row, weight, lows, width, x, z = (v[keep] for v in (seed, row, weight, lows, width, x, z))
            if not len(seed):
                break
        z = mixed(z ^ GOLD)
        slot = row * slots + (((z >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
        if straddles:
            place = lows + (((z & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * width).astype(np.int64)
            counts = place < weight
            np.minimum.at(early, slot[counts], x[counts])
        else:
            np.minimum.at(early, slot, x)
        touched = np.unique(row) if len(row) < rows else slice(None)
        last[touched] = early.reshape(rows, slots)[touched].max(axis=1)
    return early.reshape(rows, slots)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of consecutive slots."""
    rows, slots = signature.shape
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(rows, bands, slots // bands)
    key = np.arange(1, bands + 1, dtype=np.uint64) * GOLD * np.ones((rows, 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(slots // bands):
            key = mixed(key + bits[:, :, k])
    return key.view(np.int64)


def numbered(s: Shingles, text: int) -> np.ndarray:
    """The multiset of one text as a sorted set: the j-th copy of a shingle is an element of its own."""
    a, b = np.searchsorted(s.text, [text, text + 1])
    h, w = s.hash[a:b], s.weight[a:b]
    copy = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    with np.errstate(over="ignore"):
        return np.sort(mixed(np.repeat(h, w) + copy.astype(np.uint64) * GOLD))
