"""Repeated byte strings across documents, found by suffix order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.induced import sorted_suffixes
from seriesmill.llm.marks import in_marks, mark_of, marked_ids
from seriesmill.llm.words import RANDOM, hash_spans, mix, small_batches, steps, utf8
from seriesmill.session import cut_lineage

#: Bytes of a string that counts as repeated, and of the grams that it is known by (a power of two).
WINDOW, GRAM = 50, 16
#: Bytes beside a gram that a window over it surely holds, on its left or on its right (no more than a gram and one).
BESIDE = (WINDOW - GRAM) // 2
#: Bits of the map of widened grams that several documents have: 32 MB, whatever the input.
FILTER_BITS = 28
#: Bytes of one vectorised step, grams that a task gathers, pieces that it gathers, bytes that one suffix order takes.
_STEP, _GATHER, _PIECES, _SORT = 500_000, 2_000_000, 200_000, 3_000_000
_BLOCK = 8192
#: Grams are counted in ``2**bits`` shards: four to a shuffle partition, within these limits.
LEAST_SHARD_BITS, MOST_SHARD_BITS = 8, 16
_LAST = np.int64(2**63 - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on."""
    value, reach = RANDOM[data], 1
    while reach < GRAM:
        value = value[:-reach] * np.uint64(0x9E3779B97F4A7C15 + 2 * reach) + value[reach:]
        reach *= 2
    return mix(value)


def _sliding(extreme: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The extreme of every ``width`` neighbours, by windows of doubling reach."""
    reach = 1
    while 2 * reach <= width:
        values = extreme(values[:-reach], values[reach:])
        reach *= 2
    return extreme(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


@dataclass
class _Grams:
    """Grams of some rows and what their windows make of them.

    ``least`` is the smallest gram of each window, ``valid`` whether the window lies
    in one row.  ``place`` has the grams that are the smallest of some window; equal
    windows choose the same ones wherever they stand.  ``left`` and ``right`` are
    hashes of such a gram with the ``BESIDE`` bytes before or after it: every window
    over it holds one of the two (``has_left``, ``has_right``: within the row).
    """

    grams: np.ndarray
    least: np.ndarray
    valid: np.ndarray
    place: np.ndarray
    row: np.ndarray
    left: np.ndarray
    right: np.ndarray
    has_left: np.ndarray
    has_right: np.ndarray


_SPAN = WINDOW - GRAM + 1
_SIDES = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407)]


def _chosen_grams(data: np.ndarray, offsets: np.ndarray) -> _Grams | None:
    if len(data) < WINDOW:
        return None
    grams = _gram_hashes(data)
    least = _sliding(np.minimum, grams, _SPAN)
    valid = np.ones(len(least), bool)
    # a window may not reach over the end of its row
    cut = (offsets[1:, None] - np.arange(1, WINDOW)[None, :]).ravel()
    valid[cut[(cut >= 0) & (cut < len(least))]] = False
    # a gram is the smallest of a window over it where the largest of their smallest is itself
    edge = np.zeros(_SPAN - 1, np.uint64)
    largest = _sliding(np.maximum, np.concatenate([edge, np.where(valid, least, 0), edge]), _SPAN)
    place = np.flatnonzero(grams == largest[: len(grams)])
    row = np.searchsorted(offsets, place, "right") - 1
    has_left, has_right = place - BESIDE >= offsets[:-1][row], place + GRAM + BESIDE <= offsets[1:][row]
    last = len(grams) - 1
    own = grams[place]
    left = mix(grams[np.maximum(place - BESIDE, 0)] * _SIDES[0] + mix(grams[np.maximum(place - 1, 0)] * _SIDES[1] + own))
    right = mix(grams[np.minimum(place + BESIDE, last)] * _SIDES[2] + mix(grams[np.minimum(place + GRAM, last)] * _SIDES[3] + own))
    return _Grams(grams, least, valid, place, row, left, right, has_left, has_right)


def whole_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``key`` of the rows of ``WINDOW`` bytes or more whose whole text stands in a row with a smaller identifier."""
    digests = docs.select(_identifier(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.sha2(text_col, 256).alias("sha"), F.octet_length(text_col).alias("n"))
    digests = cut_lineage(digests.filter(F.col("n") >= WINDOW).drop("n"))
    least = digests.groupBy("sha").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return digests.join(least, "sha").filter("id > low").select("id", "key").distinct()


def _identifier(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST)))


@dataclass
class _Rows:
    """Rows without whole copies: ``table`` has id, key, text and bit, ``copies`` is a bitmap of fixed size.

    A row whose bit is in the map is a copy and left out.  The few other rows that
    fall on its bits were set apart with an exact join and have bit -1.
    """

    table: DataFrame
    copies: Broadcast

    def map(self, function, shape: str) -> DataFrame:
        """``function`` over the batches that are left."""
        copies = self.copies

        def left(batch: pa.RecordBatch) -> pa.RecordBatch:
            bit = batch.column(3)
            apart = bit.to_numpy(zero_copy_only=False) < 0
            return batch.filter(pa.array(apart | ~in_marks(copies.value, pc.max_element_wise(bit, 0))))

        return self.table.mapInArrow(lambda batches: function(map(left, batches)), shape)


def _rows_without(copies: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> _Rows:
    rows = small_batches(docs).select(_identifier(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    rows = rows.withColumn("bit", mark_of("id", "key"))
    marks = docs.sparkSession.sparkContext.broadcast(marked_ids(copies))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_marks(marks.value, batch.column(3)))).select([0, 1, 2])

    apart = rows.mapInArrow(choose, "id long, key long, text string").join(copies, ["id", "key"], "left_anti")
    apart = cut_lineage(apart).select("id", "key", "text", F.lit(-1).cast(rows.schema["bit"].dataType).alias("bit"))
    return _Rows(rows.unionByName(apart), marks)


def _shared_grams(rows: _Rows) -> np.ndarray:
    """A packed map of the widened grams that two rows or more have (and of some others, by chance).

    Each task sends a widened gram once, with whether it saw several rows; the
    shards add up and send their part of the map.
    """
    partitions = int(rows.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard_bits = min(MOST_SHARD_BITS, max(LEAST_SHARD_BITS, (4 * partitions - 1).bit_length()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, owners, size, base = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not grams:
                return
            gram, row = np.concatenate(grams), np.concatenate(owners)
            order = np.lexsort((row, gram))
            gram, row = gram[order], row[order]
            new = np.concatenate([[True], gram[1:] != gram[:-1]])
            several = np.zeros(len(gram), bool)
            several[1:] = ~new[1:] & (row[1:] != row[:-1])
            start = np.flatnonzero(new)
            twice = np.logical_or.reduceat(several, start)
            gram = gram[start]
            value = ((gram >> np.uint64(33 - shard_bits)).astype(np.uint32) & np.uint32(0x7FFFFFFF)) << np.uint32(1) | twice.astype(np.uint32)
            bounds = np.searchsorted(gram >> np.uint64(64 - shard_bits), np.arange((1 << shard_bits) + 1, dtype=np.uint64))
            found = [(s, value[at : min(at + _BLOCK, b)].tobytes()) for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) for at in range(a, b, _BLOCK)]
            for at in range(0, len(found), 256):
                part = found[at : at + 256]
                yield pa.record_batch({"shard": pa.array([s for s, _ in part], pa.int32()), "block": pa.array([v for _, v in part], pa.binary())})
            grams.clear()
            owners.clear()

        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in steps(offsets, _STEP):
                found = _chosen_grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if found is not None:
                    grams += [found.left[found.has_left], found.right[found.has_right]]
                    owners += [found.row[found.has_left] + base, found.row[found.has_right] + base]
                    size += 2 * len(found.place)
                base += b - a
                if size >= _GATHER:
                    yield from flush()
                    size = 0
        yield from flush()

    per_shard = FILTER_BITS - shard_bits

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(shard, []).append(np.frombuffer(raw.as_py(), np.uint32))
        for shard, parts in held.items():
            value = np.concatenate(parts)
            value.sort()
            gram = value >> np.uint32(1)
            again = (value & np.uint32(1)).astype(bool)
            again[1:] |= gram[1:] == gram[:-1]
            marks = np.zeros(1 << per_shard, bool)
            marks[gram[again] >> np.uint32(31 - per_shard)] = True
            yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "block": pa.array([zlib.compress(np.packbits(marks).tobytes(), 1)], pa.binary())})

    shape = "shard int, block binary"
    parts = rows.map(gather, shape).repartition("shard").mapInArrow(merge, shape)
    size = (1 << per_shard) // 8
    out = np.zeros(size << shard_bits, np.uint8)
    for row in parts.toLocalIterator():
        out[row["shard"] * size : (row["shard"] + 1) * size] = np.frombuffer(zlib.decompress(bytes(row["block"])), np.uint8)
    return out


def _marked_runs(marks: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Runs of windows that may stand in several rows: smallest gram, hash of the bytes, first byte, end and row.

    A run's windows share their smallest gram, widened to a side that the map knows.
    """
    none = np.empty(0, np.int64)
    found = _chosen_grams(data, offsets)
    if found is None:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), none, none, none

    def known(side: np.ndarray, there: np.ndarray) -> np.ndarray:
        bit = (side >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return there & ((marks[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1)

    place = found.place[known(found.left, found.has_left) | known(found.right, found.has_right)]
    shared = np.full(len(found.grams), np.uint64(2**64 - 1))
    shared[place] = found.grams[place]
    least = found.least
    good = found.valid & (_sliding(np.minimum, shared, _SPAN) == least)
    change = least[1:] != least[:-1]
    first = np.flatnonzero(good & np.concatenate([[True], change | ~good[:-1]]))
    end = np.flatnonzero(good & np.concatenate([change | ~good[1:], [True]])) + WINDOW
    row = np.searchsorted(offsets, first, "right") - 1
    # windows of neighbouring rows with one gram between them are two runs: invalid ones lie between
    return least[first], hash_spans(data, first, end, lower=False), first, end, row


def _spans_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first window, last window and smallest identifier of the windows' strings among all pieces.

    The pieces, each ended by a byte of its own, are one text; strings that several
    pieces hold stand together in its suffix order, with common prefixes of
    ``WINDOW`` bytes or more between them.  Runs that no document can lose are left out.
    """
    lengths = end - begin
    starts = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    inside = np.arange(len(owner)) - starts[owner]
    text = np.zeros(len(owner) + 1, np.uint8)
    text[:-1] = np.where(inside < lengths[owner], data[np.minimum(begin[owner] + inside, len(data) - 1)] + np.uint8(2), 1)
    value = np.full(len(text) - 1, _LAST)
    group: list[np.ndarray] = []

    def close() -> None:
        if group:
            place = np.concatenate(group)
            place = place[inside[place] + WINDOW <= lengths[owner[place]]]
            if len(place):
                value[place] = least[owner[place]].min()
            group.clear()

    for place, prefix in sorted_suffixes(text):
        new = np.flatnonzero(prefix < WINDOW)
        if not len(new):
            group.append(place)
            continue
        if new[0]:
            group.append(place[: new[0]])
        close()
        # whole groups inside the chunk at once, the last one may go on
        body, starts_at = place[new[0] : new[-1]], new[:-1] - new[0]
        if len(body):
            low = np.minimum.reduceat(np.where(inside[body] + WINDOW <= lengths[owner[body]], least[owner[body]], _LAST), starts_at)
            value[body] = np.repeat(low, np.diff(new))
        group.append(place[new[-1] :])
    close()
    window = np.flatnonzero(inside + WINDOW <= lengths[owner])
    kind, worth = owner[window], value[window]
    first = np.concatenate([[True], (kind[1:] != kind[:-1]) | (worth[1:] != worth[:-1])])
    last = np.concatenate([first[1:], [True]])
    kind, worth, first, last = kind[first], worth[first], inside[window[first]], inside[window[last]]
    keep = worth < most[kind]
    return kind[keep], first[keep], last[keep], worth[keep]


def _order_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window runs with the smallest identifier of their strings, from pieces sorted by gram and hash."""
    held: list[pa.RecordBatch] = []

    def emit(gram, digest, begin, end, worth) -> pa.RecordBatch:
        return pa.record_batch({"m": pa.array(gram), "h": pa.array(digest), "begin": pa.array(begin.astype(np.int32)), "end": pa.array(end.astype(np.int32)), "worth": pa.array(worth)})

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, digest, low, high = (table.column(k).to_numpy() for k in range(4))
        data, offsets = utf8(table.column(4).combine_chunks())
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (digest[1:] != digest[:-1])]))
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        gram, digest = gram[first], digest[first]
        begin, end = offsets[:-1][first], offsets[1:][first]
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        number = np.cumsum(new) - 1
        alone = np.bincount(number)[number] == 1
        # a gram with one piece: all its windows are the same everywhere
        single = np.flatnonzero(alone & (low < high))
        if len(single):
            yield emit(gram[single], digest[single], np.zeros(len(single)), (end - begin)[single] - WINDOW, low[single])
        several = np.flatnonzero(~alone)
        size = np.cumsum((end - begin)[several])
        at = 0
        while at < len(several):
            # pieces of one gram stay together
            stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + _SORT)) + 1
            while stop < len(several) and number[several[stop]] == number[several[stop - 1]]:
                stop += 1
            part = several[at:stop]
            kind, a, b, worth = _spans_of(data, begin[part], end[part], low[part], high[part])
            yield emit(gram[part][kind], digest[part][kind], a, b, worth)
            at = stop

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > 4 * _SORT:
            table = pa.Table.from_batches(held)
            grams = table.column(0).to_numpy()
            cut = int(np.searchsorted(grams, grams[-1]))
            if cut:
                yield from work(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        table = pa.Table.from_batches(held)
        if len(table):
            yield from work(table)


def _without(text: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and the remaining bytes, given intervals in any order."""
    depth = np.zeros(len(text) + 1, np.int32)
    np.add.at(depth, begin, 1)
    np.add.at(depth, end, -1)
    gone = np.cumsum(depth)[:-1] > 0
    runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def repeated_intervals(docs: DataFrame, copies: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``key``, ``begin`` and ``end`` (exclusive) of byte runs whose strings start in a document with a smaller identifier.

    ``copies`` (:func:`whole_copies`) lose all bytes and take part no further: what
    they hold stands in a smaller document too.

    Every window of ``WINDOW`` bytes belongs to its smallest gram, so equal windows
    meet in one shard.  A map of fixed size first drops windows whose gram, with the
    bytes left or right of it, one row alone has.  The rest travel as pieces (runs of windows with one smallest gram), each
    text once per task; the shards order the suffixes of those pieces whose gram has
    several.  Occurrences never meet in one task: they join the verdicts by piece.
    """
    rows = _rows_without(copies, docs, id_col, text_col)
    marks = docs.sparkSession.sparkContext.broadcast(_shared_grams(rows))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = utf8(batch.column(2))
            for a, b in steps(offsets, _STEP):
                gram, digest, first, _, row = _marked_runs(marks.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(gram):
                    place = first - (offsets[a:b] - offsets[a])[row]
                    yield pa.record_batch({"m": pa.array(gram.view(np.int64)), "h": pa.array(digest.view(np.int64)), "id": pa.array(ids[a + row]), "key": pa.array(keys[a + row]), "at": pa.array(place.astype(np.int32))})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        texts: list[pa.Array] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not texts:
                return
            gram, digest, low, high = (np.concatenate(h) for h in held)
            text = pa.chunked_array(texts).combine_chunks()
            order = np.lexsort((digest, gram))
            gram, digest, low, high = gram[order], digest[order], low[order], high[order]
            first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (digest[1:] != digest[:-1])]))
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            out = pa.record_batch({"m": pa.array(gram[first].view(np.int64)), "h": pa.array(digest[first].view(np.int64)), "low": pa.array(low), "high": pa.array(high), "piece": text.take(pa.array(order[first]))})
            for at in range(0, len(out), 20_000):
                yield out.slice(at, 20_000)
            for h in held:
                h.clear()
            texts.clear()

        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(2))
            for a, b in steps(offsets, _STEP):
                part = data[offsets[a] : offsets[b]]
                gram, digest, first, end, row = _marked_runs(marks.value, part, offsets[a : b + 1] - offsets[a])
                if not len(gram):
                    continue
                # the step's distinct pieces
                _, chosen, back = np.unique(digest, return_index=True, return_inverse=True)
                low, high = np.full(len(chosen), _LAST), np.full(len(chosen), np.int64(-(2**63)))
                np.minimum.at(low, back, ids[a + row])
                np.maximum.at(high, back, ids[a + row])
                length = (end - first)[chosen]
                ends = np.cumsum(length)
                flat = part[np.arange(int(ends[-1])) + np.repeat(first[chosen] - ends + length, length)]
                texts.append(pa.Array.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(flat)]))
                for h, v in zip(held, (gram[chosen], digest[chosen], low, high)):
                    h.append(v)
                size += len(chosen)
                if size >= _PIECES:
                    yield from flush()
                    size = 0
        yield from flush()

    sent = rows.map(pieces, "m long, h long, low long, high long, piece binary")
    verdicts = sent.repartition("m").sortWithinPartitions("m", "h").mapInArrow(_order_shard, "m long, h long, begin int, end int, worth long")
    found = rows.map(occurrences, "m long, h long, id long, key long, at int").join(verdicts, ["m", "h"]).filter("worth < id")
    return found.select("id", "key", (F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("end") + WINDOW).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "remaining") -> DataFrame:
    """The rows that lose bytes: ``id``, ``key``, ``n_removed``, ``n_spans``, and the remaining bytes ``into``, once per distinct row.

    Whole copies have NULL for ``n_removed``: nothing remains of them.
    """
    copies = cut_lineage(whole_copies(docs, id_col, text_col))
    intervals = repeated_intervals(docs, copies, id_col, text_col)
    lists = intervals.groupBy("id", "key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    lists = cut_lineage(lists)
    marks = docs.sparkSession.sparkContext.broadcast(marked_ids(lists.select("id", "key")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_marks(marks.value, batch.column(3)))).select([0, 1, 2])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, rest = [], [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3)):
                spans = spans.values
                n, k, left = _without((text or "").encode(), spans.field("begin").to_numpy(), spans.field("end").to_numpy())
                removed.append(n)
                runs.append(k)
                rest.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(rest, pa.binary())], ["id", "key", "n_removed", "n_spans", into])

    texts = small_batches(docs).select(_identifier(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    texts = texts.withColumn("bit", mark_of("id", "key")).mapInArrow(choose, "id long, key long, text string")
    joined = texts.join(lists, ["id", "key"]).select("id", "key", "text", "spans")
    partly = joined.mapInArrow(cut, f"id long, key long, n_removed long, n_spans long, `{into}` binary")
    wholly = copies.select("id", "key", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias(into))
    return partly.unionByName(wholly)


def measure_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row.

    A byte goes when a ``WINDOW``-byte string over it also starts in a document with
    a smaller identifier.  NULL counts as empty.  Texts below ``WINDOW`` bytes lose
    nothing.  Rows with the same identifier take nothing from one another; rows
    without identifier come after all others and take nothing from one another.
    Extra columns are ignored.  Runs several jobs.
    """
    lost = remove_repeats(docs, id_col, text_col, "remaining").select("id", "key", "n_removed", "n_spans", F.sha2("remaining", 256).alias("rest"), F.lit(True).alias("hit"))
    lost = lost.dropDuplicates(["id", "key"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("own"), _identifier(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return rows.join(lost, ["id", "key"], "left").select(
        F.col("own").alias(id_col), "n_bytes", F.when(F.col("hit"), F.coalesce("n_removed", "n_bytes")).otherwise(zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("rest", "whole").alias("kept_sha256")
    )
