"""A hashed bitmap of fixed size that tells which rows a later step may need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits (a power of two) of the map: 1 MB, whatever the number of rows.
MARK_BITS = 23
_CHUNK = 1 << 16


def mark_of(*columns: str) -> Column:
    """The bit that a row's key falls on."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << MARK_BITS))


def marked_ids(keys: DataFrame) -> np.ndarray:
    """The map of the keys in all columns of ``keys``, packed.  Runs a job; only bits reach the driver."""
    bits = keys.select(mark_of(*keys.columns).alias("bit")).distinct()
    chunks = bits.groupBy(F.floor(F.col("bit") / _CHUNK).alias("chunk")).agg(F.collect_set(F.col("bit") % _CHUNK).alias("bits"))
    marks = np.zeros(1 << MARK_BITS, bool)
    for row in chunks.toLocalIterator():
        marks[int(row["chunk"]) * _CHUNK + np.asarray(row["bits"], np.int64)] = True
    return np.packbits(marks)


def in_marks(marks: np.ndarray, bit: pa.Array) -> np.ndarray:
    """Whether each bit is set."""
    bit = bit.to_numpy(zero_copy_only=False)
    return (marks[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
