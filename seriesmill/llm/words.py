"""Words, hashes and blocks of bytes of whole Arrow batches, without a loop over words.

A word is a run of bytes outside ``0x20`` and ``0x09``-``0x0D``.  Hashes are 64 bits
wide and depend on the bytes only, so that every task and every run agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_CHARACTERS = " \t\n\x0b\x0c\r"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RANDOM_LOWER = RANDOM.copy()
RANDOM_LOWER[65:91] = RANDOM[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of text that one vectorised step works on; bounds the memory of a task.
STEP_BYTES = 2_000_000
#: Rows of an Arrow batch, so that a batch of very long texts still fits a worker.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches of texts at ``BATCH_ROWS`` rows at most; returns ``df``."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def word_array(text: Column) -> Column:
    """The words of a text as an array column; empty for NULL."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARACTERS, " " * len(SPACE_CHARACTERS))
    return F.array_remove(F.split(plain, " "), "")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; NULL counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column, kind, wide = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else ""), None, np.int64
    else:
        kind = pa.binary() if pa.types.is_binary(column.type) else pa.string()
        column, wide = pc.fill_null(column.cast(kind), b"" if kind == pa.binary() else ""), np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, rows)
        first = last


@dataclass
class Words:
    """Words of some rows: first and last byte (exclusive), row, hash and the rows' first word."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """The words of rows ``offsets`` in ``data``; ``lower`` takes A-Z as a-z in the hash."""
    rows = len(offsets) - 1
    inside = ~_IS_SPACE[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    if len(data):
        before[filled] = False
        after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    return Words(start, end, row, hash_spans(data, start, end, lower), first)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hash of the bytes of every span; ``lower`` takes A-Z as a-z."""
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    table = RANDOM_LOWER if lower else RANDOM
    powers = np.cumprod(np.full(int(length.max()), _STEP, np.uint64))
    # bytes of words only, one after the other
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    values = table[data[place + np.repeat(start, length)]] * powers[place]
    return mix(np.add.reduceat(values, begin) + length.astype(np.uint64) * _STEP)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words; a row with fewer words has one run, a row without words none."""
    total = len(words.hash)
    counts = np.diff(words.first)
    parts = [np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 % 2**64) for k in range(size)]
    hashes, rows = [], []
    if total >= size:
        value = np.zeros(total - size + 1, np.uint64)
        for k in range(size):
            value = mix(value + words.hash[k : total - size + 1 + k] * parts[k])
        whole = words.row[: total - size + 1] == words.row[size - 1 :]
        hashes.append(value[whole])
        rows.append(words.row[: total - size + 1][whole])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = counts[short] > k
            value[there] = mix(value[there] + words.hash[words.first[short[there]] + k] * parts[k])
        hashes.append(mix(value + counts[short].astype(np.uint64)))
        rows.append(short)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    if len(short) and total >= size:
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, and the ``count + 1`` offsets of the rows; ``rows`` ascends."""
    bounds = np.searchsorted(rows, np.arange(count + 1))
    hashes = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    if not len(hashes):
        return hashes, bounds
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[bounds]
