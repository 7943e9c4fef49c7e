"""Bounded bitmaps over a hash space, made from tables of hashes that are dealt out by their leading bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bitmap has about so many bits for each hash, and 64 MB at most.
BITS_EACH, MOST_BITS = 32, 29


class Bitmap:
    """Which hashes may be among those noted, by their leading bits; no noted hash is missing."""

    def __init__(self, bits: int, data: bytes):
        self.shift, self.data = np.uint64(64 - bits), np.frombuffer(data, dtype=np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> self.shift
        return ((self.data[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).view(bool)


def _marks(bits: int, part_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, h in zip(batch.column(0).to_pylist(), batch.column(1)):
                marks = np.zeros(1 << (bits - part_bits), dtype=bool)
                marks[(np.frombuffer(h.as_buffer(), dtype=np.uint64) >> np.uint64(64 - bits)) & np.uint64(len(marks) - 1)] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["part", "marks"])

    return run


def bitmap_of(table: DataFrame, part_bits: int, hashes: str = "hashes", n: str = "n") -> tuple[int, bytes]:
    """Bits and bytes of a Bitmap from rows (part, n, hashes), one row for each value of the leading `part_bits` bits
    that occurs, with its hashes as 64-bit numbers.  At most 64 MB reach the driver."""
    total = table.agg(F.sum(n)).first()[0] or 0
    bits = max(min(MOST_BITS, (total * BITS_EACH).bit_length()), part_bits + 3)
    data = bytearray(1 << (bits - 3))
    each = 1 << (bits - 3 - part_bits)
    rows = table.where(f"{n} > 0").select("part", hashes).mapInArrow(_marks(bits, part_bits), "part int, marks binary").toArrow()
    for p, marks in zip(rows.column(0).to_pylist(), rows.column(1)):
        data[p * each : (p + 1) * each] = marks.as_buffer()
    return bits, bytes(data)
