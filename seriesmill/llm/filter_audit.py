"""What each of several filters removes in every order, with a counting-Bloom prepass for copies."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.words import mix, word_array
from seriesmill.session import cut_lineage

#: A sketch has about this many counters of two bits per row; ``2**MOST_BITS`` counters (a repeat map of 32 MB) bound a broadcast.
ROW_COUNTERS, LEAST_BITS, MOST_BITS = 8, 16, 28
#: Counters that a text adds to.
PROBES = 3
#: The letter of the filter that drops copies.
COPIES = "E"

_CHUNK_BITS = 14
_GATHER = 1_000_000
_SALTS = [np.uint64((k + 1) * 0xD1342543DE82EF95 % 2**64) for k in range(PROBES)]


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text; NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = word_array(text)
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 65,
        "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The counters of every text hash, one row per probe."""
    shift = np.uint64(64 - bits)
    return np.stack([(mix(hashes + salt) >> shift).astype(np.int64) for salt in _SALTS])


def _chunks(slots: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counters as rows (chunk, cells), packed; ``slots`` ascends."""
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(slots >> _CHUNK_BITS) != 0, [True]])) if len(slots) else []
    numbers, cells = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        numbers.append(int(slots[a] >> _CHUNK_BITS))
        low = (slots[a:b] & ((1 << _CHUNK_BITS) - 1)).astype(np.uint16)
        cells.append(zlib.compress(low.tobytes() + counts[a:b].astype(np.uint8).tobytes(), 1))
    for at in range(0, len(numbers), 1024):
        yield pa.record_batch({"chunk": pa.array(numbers[at : at + 1024], pa.int64()), "cells": pa.array(cells[at : at + 1024], pa.binary())})


def _add(slots: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct counters and their sums, which stop at two."""
    if not slots:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    flat, numbers = np.concatenate(slots), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat, numbers = flat[order], numbers[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
    sums = np.add.reduceat(numbers, new) if len(new) else np.empty(0, np.int64)
    return flat[new], np.minimum(sums, 2).astype(np.uint8)


def repeat_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits of the counters that two rows or more add to, from the merged sketches of all tasks.

    ``hashes`` has one long column.  Every task counts its own rows in a sketch of
    two-bit counters and sends the filled ones, packed by range of counters; equal
    ranges meet and are added.  Runs a job; the driver gets ``2**bits`` bits.
    """
    shape = "chunk long, cells binary"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts, held = [], [], 0
        for batch in batches:
            own = _slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits).reshape(-1)
            slots.append(own)
            counts.append(np.ones(len(own), np.uint8))
            held += len(own)
            if held > _GATHER:
                merged = _add(slots, counts)
                slots, counts, held = [merged[0]], [merged[1]], 0
        yield from _chunks(*_add(slots, counts))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = zlib.decompress(raw)
                size = len(raw) // 3
                sums = cells.setdefault(chunk, np.zeros(1 << _CHUNK_BITS, np.uint8))
                low = np.frombuffer(raw, np.uint16, size)
                sums[low] = np.minimum(sums[low] + np.frombuffer(raw, np.uint8, size, 2 * size), 2)
        for chunk, sums in cells.items():
            yield pa.record_batch({"chunk": pa.array([chunk], pa.int64()), "cells": pa.array([np.packbits(sums > 1).tobytes()], pa.binary())})

    parts = hashes.mapInArrow(sketch, shape).repartition("chunk").mapInArrow(merge, shape)
    packed = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.toLocalIterator():
        at = row["chunk"] << (_CHUNK_BITS - 3)
        packed[at : at + (1 << (_CHUNK_BITS - 3))] = np.frombuffer(bytes(row["cells"]), np.uint8)
    return packed


def possible_repeats(rows: DataFrame, hash_col: str, most_bits: int = MOST_BITS) -> DataFrame:
    """Rows of ``rows`` whose text hash may stand in another row; the others are certain to be alone.

    A text with a counter that nobody else added to is alone.  The sketch grows
    with the counted rows; beyond ``2**most_bits`` counters the hashes are dealt
    into slices with a sketch each and ``rows`` is read once per slice, so that no
    broadcast grows and no sketch fills up.  ``rows`` should be materialised.  Runs jobs.
    """
    spark = rows.sparkSession
    number = rows.count()
    slices = max(1, -(-number * ROW_COUNTERS >> most_bits))
    bits = min(most_bits, max(LEAST_BITS, (-(-number * ROW_COUNTERS // slices)).bit_length()))
    slice_of = F.pmod(F.shiftrightunsigned(hash_col, 7), F.lit(slices))
    kept = []
    for nth in range(slices):
        part = rows.filter(slice_of == nth) if slices > 1 else rows
        shared = spark.sparkContext.broadcast(repeat_map(part.select(hash_col), bits))
        at = rows.columns.index(hash_col)

        def hold(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            packed = shared.value
            for batch in batches:
                slots = _slots(batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64), bits)
                twice = np.logical_and.reduce((packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1, axis=0)
                yield batch.filter(pa.array(twice))

        kept.append(part.mapInArrow(hold, rows.schema))
        if slices > 1:
            kept[-1] = cut_lineage(kept[-1])
            shared.destroy()
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    return found


def mask_counts(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    failures: Mapping[str, Column] | None = None,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """Rows per part and set of failed filters: ``part``, ``mask``, ``n``, ``good``, ``toxic``.

    Bit k of ``mask`` stands for the k-th filter of ``failures`` (by default
    :func:`text_failures`); the bit after them stands for copies: the text is
    identical, as a whole, to that of a smaller identifier anywhere in the table.
    Only rows that the merged sketches cannot clear (see :func:`possible_repeats`)
    are shuffled by text, known by its SHA-256 and length, to find the smallest
    identifier; the counts of those that follow it are then moved to masks with the
    copies' bit, so flags never travel back to the rows.

    NULL texts count as empty, NULL parts as the empty string.  A row without
    identifier is never a copy and has no label, and no row is a copy of it; rows
    that repeat one identifier and text are not copies of each other.  Of several
    labels of an identifier any 1 counts.  Extra columns are ignored.  Empty tables
    give no row.  Runs jobs (one narrow row per document is checkpointed).
    """
    failures = failures or text_failures(F.col(text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(failures.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.xxhash64(text).alias("hash"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.octet_length(text).alias("size"),
    )
    known = labels.select(F.col(id_col).alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    known = known.filter("id IS NOT NULL AND (good OR toxic)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = rows.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)).cast("long") for c in ("good", "toxic")})
    rows = cut_lineage(rows)

    repeats = possible_repeats(rows.filter("id IS NOT NULL"), "hash", most_bits)
    # a hot text spreads by identifier first and then has one row per part and kind, so that no join meets its rows
    kind = ["sha", "size", "part", "mask", "good", "toxic"]
    single = repeats.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("c"))
    kinds = single.groupBy(*kind).agg(F.min(F.struct("id", "c")).alias("low"), F.sum("c").alias("c"))
    first = kinds.groupBy("sha", "size").agg(F.min("low.id").alias("first"), F.sum("c").alias("copies")).filter("copies > 1").drop("copies")
    staying = F.when(F.col("low.id") == F.col("first"), F.col("low.c")).otherwise(F.lit(0))
    later = kinds.join(first, ["sha", "size"]).withColumn("c", F.col("c") - staying).filter("c > 0")

    copies = 1 << len(failures)
    entry = lambda n, mask: F.struct(mask.alias("mask"), n.alias("n"), (F.col("good") * n).alias("good"), (F.col("toxic") * n).alias("toxic"))
    every = rows.select("part", entry(F.lit(1).cast("long"), F.col("mask")).alias("e")).select("part", "e.*")
    moved = later.select("part", F.explode(F.array(entry(-F.col("c"), F.col("mask")), entry(F.col("c"), F.col("mask") + copies))).alias("e")).select("part", "e.*")
    added = every.unionByName(moved).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # a part whose rows have all moved keeps its other masks; masks without rows say nothing
    return added.filter("n > 0")


def audit(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Per part, order of the filters and step: what the step's filter keeps, removes and shares with others.

    ``counts`` is what :func:`mask_counts` returns, at most ``2**len(letters)``
    rows per part; all orders follow from them, the documents are not read again.
    Returns ``part``, ``filter_order``, ``step``, ``kept``, ``removed``,
    ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley``
    (removals of the step's filter, summed over all orders).  Zeros are included.
    """
    orders = [F.lit("".join(p)) for p in permutations(letters)]
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = parts.select("part", "masks", F.explode(F.array(*orders)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))

    places = ", ".join(f"'{letter}', {1 << k}" for k, letter in enumerate(letters))
    with_bits = steps.withColumn("bits", F.expr(f"transform(split(filter_order, ''), x -> element_at(map({places}), x))"))
    with_bits = with_bits.withColumns(
        {
            "own": F.expr("element_at(bits, step)"),
            "before": F.expr("aggregate(slice(bits, 1, step - 1), 0, (a, x) -> a + x)"),
        }
    )

    def total(condition: str, value: str = "n") -> Column:
        return F.expr(f"aggregate(masks, 0L, (a, x) -> a + if({condition}, x.{value}, 0L))")

    removed = "x.mask & own <> 0 AND x.mask & before = 0"
    rounds = 1
    for k in range(2, len(letters) + 1):
        rounds *= k
    return with_bits.select(
        "part",
        "filter_order",
        "step",
        total("x.mask & (own | before) = 0").alias("kept"),
        total(removed).alias("removed"),
        total("x.mask & own <> 0 AND x.mask & before <> 0").alias("redundant"),
        total("x.mask = own").alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        # of the orders, one in as many as the mask has filters puts this filter first
        F.expr(f"aggregate(masks, 0L, (a, x) -> a + if(x.mask & own <> 0, x.n * {rounds} div bit_count(x.mask), 0L))").alias("shapley"),
    )
