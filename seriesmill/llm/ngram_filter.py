"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.words import find_words, mix, small_batches, steps, utf8
from seriesmill.session import cut_lineage

#: N-grams are counted in ``2**bits`` shards, each of which owns its part of the filter: four to a shuffle
#: partition, within these limits.
LEAST_SHARD_BITS, MOST_SHARD_BITS = 8, 16
#: The filter takes about this many bits per entry; one of up to ``2**MOST_BITS`` bits (64 MB) goes out whole, a larger one stays in its shards.
ENTRY_BITS, MOST_BITS = 6, 29
#: Bits that an entry sets.
PROBES = 3
#: Tokens with at least 1 / 2**FREQUENT_BITS of all occurrences are broadcast with their counts: that many at most.
#: Where the filter stays in its shards, n-grams of every order as frequent are broadcast with their levels.
FREQUENT_BITS = 22
#: Pseudo-count of the next lower order in an n-gram's probability, and of a token in a unigram's.
BACK_OFF, ADDED = 4.0, 0.1
#: N-grams that a task gathers before it adds them up, and entries of one block.
_GATHER, _BLOCK = 3_000_000, 4096

_START, _END = mix(np.array([101, 202], np.uint64))
_PAIR = np.uint64(0x9FB21C651E98DF25)
_TURN = 0xC2B2AE3D27D4EB4F
#: Kinds of blocks: n-grams of order n are of kind n; questions come after all counts, filter parts before.
PART, UNIGRAM, QUESTION, ANSWER = 0, 1, 1 << 20, 1 << 21
#: Longest n-grams of the model.
ORDER = 2


def held_out(id_col: str) -> Column:
    """Rows that the model may not learn from; a row without identifier is not held out (nor learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (the words, lower-cased, then one end) and the offsets of the rows."""
    words = find_words(data, offsets)
    rows = len(offsets) - 1
    counts = np.diff(words.first)
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(int(first[-1]), np.uint64)
    out[first[1:] - 1] = _END
    out[np.arange(len(words.hash)) + words.row] = words.hash
    return out, first[: rows + 1]


def _grams(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of orders 1 to ``order`` that end at each token; before a row's first token stand starts."""
    out = [tokens]
    for k in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = out[-1][:-1]
        before[first[:-1]] = _START + np.uint64(k - 2)
        out.append(mix(before * _PAIR + tokens))
    return out


def _shard_bits(docs: DataFrame) -> int:
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_SHARD_BITS, max(LEAST_SHARD_BITS, (4 * partitions - 1).bit_length()))


def _shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays as bytes: their number, kinds and contents."""
    return b"".join([np.int32(len(arrays[0])).tobytes(), *[a.tobytes() for a in arrays]])


def _unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    size, at, out = int(np.frombuffer(raw, np.int32, 1)[0]), 4, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _pack_counts(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Hashes with their counts; a count takes one byte, and eight more from 255 on."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return _pack(hashes, small) + counts[small == 255].astype(np.int64).tobytes()


def _unpack_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes, small = _unpack(raw, np.uint64, np.uint8)
    counts = small.astype(np.int64)
    counts[small == 255] = np.frombuffer(raw, np.int64, -1, 4 + 9 * len(hashes))
    return hashes, counts


_BLOCKS = "kind int, shard int, block binary"
#: Columns of scored rows.
_SCORED = ("id", "key", "n_tokens", "known", "base", "score")


def _cuts(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Shards of sorted hashes and what to cut out for each of their blocks."""
    shards = _shard(hashes, bits)
    starts = np.flatnonzero(np.concatenate([[len(shards) > 0], shards[1:] != shards[:-1]]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shards)]):
        for at in range(a, b, _BLOCK):
            yield int(shards[a]), slice(at, min(b, at + _BLOCK))


def _batches(kind: int, blocks: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, shard, block)."""
    left = iter(blocks)
    while part := list(islice(left, 256)):
        yield pa.record_batch([pa.array([kind] * len(part), pa.int32()), pa.array([s for s, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], ["kind", "shard", "block"])


def _blocks(kind: int, hashes: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, shard, block) of sorted hashes with their counts."""
    yield from _batches(kind, ((shard, _pack_counts(hashes[part], counts[part])) for shard, part in _cuts(hashes, bits)))


def _add_up(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their summed counts."""
    if not sum(map(len, hashes)):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    flat, numbers = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(flat)
    flat, numbers = flat[order], numbers[order]
    new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[new], np.add.reduceat(numbers, new)


def _sorted_counts(blocks: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kind, sorted hashes and summed counts of each run of blocks (kind, shard, block) of one kind and shard.

    What was gathered is added up whenever it has doubled, so about three times the distinct n-grams of one kind and shard are held.
    """
    own, hashes, counts, size, enough = None, [], [], 0, _GATHER
    for kind, shard, raw in blocks:
        if own != (kind, shard) and hashes:
            yield own[0], *_add_up(hashes, counts)
            hashes, counts, size, enough = [], [], 0, _GATHER
        own = kind, shard
        part = _unpack_counts(raw)
        hashes.append(part[0])
        counts.append(part[1])
        size += len(part[0])
        if size >= enough:
            flat, numbers = _add_up(hashes, counts)
            hashes, counts, size = [flat], [numbers], len(flat)
            enough = max(_GATHER, 2 * size)
    if hashes:
        yield own[0], *_add_up(hashes, counts)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for kind, shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            yield kind, shard, raw.as_py()


def count_ngrams(docs: DataFrame, text_col: str, bits: int, order: int = ORDER) -> DataFrame:
    """Exact counts of all n-grams up to ``order`` in blocks per kind and shard; tasks add up what they gather first."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {k: [] for k in range(1, order + 1)}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
                    yield from _blocks(kind, hashes, counts, bits)
                parts.clear()

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in steps(offsets):
                tokens, first = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for kind, found in enumerate(_grams(tokens, first, order), 1):
                    held[kind].append(found)
                size += len(tokens)
                if size >= _GATHER:
                    yield from flush()
                    size = 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, flat, numbers in _sorted_counts(_rows_of(batches)):
            yield from _blocks(kind, flat, numbers, bits)

    found = small_batches(docs).select(text_col).mapInArrow(gather, _BLOCKS)
    return cut_lineage(_by_shard(found).mapInArrow(merge, _BLOCKS))


def _by_shard(blocks: DataFrame) -> DataFrame:
    """A shard's blocks together, by kind; how many tasks share the shards is left to adaptive execution."""
    return blocks.repartition("shard").sortWithinPartitions("shard", "kind")


def _level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 for one, 2 for two and three, 3 up to seven, and so on."""
    return np.frexp(counts.astype(np.float64))[1]


def _middle(level: np.ndarray) -> np.ndarray:
    return np.where(level > 1, 1.5 * np.exp2(level - 1.0), level)


@dataclass
class Filter:
    """The log-frequency Bloom filter: an n-gram of level q is entered with each of 1, ..., q.

    ``bits`` are those of the shards from ``first`` on: all shards, or one of them.
    """

    bits: np.ndarray
    shard_size: int
    shard_bits: int
    first: int = 0

    def place(self, hashes: np.ndarray, level: int, probe: int) -> np.ndarray:
        """Bit number inside the shard of one probe of entry (n-gram, level)."""
        turn = np.uint64(_TURN * (level * PROBES + probe) % 2**64)
        return (mix(hashes + turn) & np.uint64(self.shard_size - 1)).astype(np.int64)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each n-gram of these shards: probes go up from 1 until an entry is missing."""
        out = np.zeros(len(hashes), np.int64)
        active = np.arange(len(hashes))
        base = (_shard(hashes, self.shard_bits) - self.first) * self.shard_size
        level = 1
        while len(active):
            for probe in range(PROBES):
                at = base[active] + self.place(hashes[active], level, probe)
                active = active[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            out[active] = level
            level += 1
        return out

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """The middle of each n-gram's quantised count; 0 if its first entry is missing."""
        return _middle(self.levels(hashes))


@dataclass
class Model:
    """The filter (without bits where it stays in its shards), the number of training tokens and of distinct ones, and what is frequent.

    ``frequent`` are tokens with exact counts; ``common`` are n-grams of all orders with their levels, only where the filter stays in its shards.
    """

    filter: Filter
    total: int
    distinct: int
    frequent: np.ndarray
    frequent_counts: np.ndarray
    common: np.ndarray
    common_levels: np.ndarray
    order: int = ORDER
    sharded: bool = False

    @property
    def norm(self) -> float:
        return self.total + ADDED * (self.distinct + 1)

    def score(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each row: n-gram counts smoothed with the next lower order."""
        grams = _grams(tokens, first, self.order)
        distinct, place = np.unique(tokens, return_inverse=True)
        return self.smoothed([self.filter.counts(distinct)[place], *map(self.filter.counts, grams[1:])], first)

    def smoothed(self, counts: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """log10 probability of each row from the counts of the n-grams that end at each token, order by order.

        No n-gram is more frequent than its history or its shorter end; collisions,
        which only raise counts, are held below both.
        """
        own = counts[0]
        # every text has one start, and each ends once: its last token is the end
        starts = own[first[1:] - 1]
        shorter, value = own, (own + ADDED) / self.norm
        for longer in counts[1:]:
            before = np.empty_like(own)
            before[1:] = shorter[:-1]
            before[first[:-1]] = starts
            longer = np.minimum(longer, np.minimum(before, shorter))
            value = (longer + BACK_OFF * value) / (before + BACK_OFF)
            shorter = longer
        return np.add.reduceat(np.log10(value), first[:-1])

    def common_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels of the common n-grams among ``hashes`` (0 for others), and which are common."""
        level = np.zeros(len(hashes), np.uint8)
        at = np.searchsorted(self.common, hashes)
        known = at < len(self.common)
        known[known] = self.common[at[known]] == hashes[known]
        level[known] = self.common_levels[at[known]]
        return level, known


def _summary(blocks: DataFrame, order: int) -> tuple[int, int, np.ndarray]:
    """Training tokens, distinct ones, and how many n-grams of each kind have each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, total, distinct = np.zeros((order, 64), np.int64), 0, 0
        for batch in batches:
            for kind, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
                hashes, counts = _unpack_counts(raw.as_py())
                levels[kind - 1] += np.bincount(_level(counts), minlength=64)
                if kind == UNIGRAM:
                    total += int(counts.sum())
                    distinct += len(hashes)
        yield pa.record_batch({"total": pa.array([total]), "distinct": pa.array([distinct]), "levels": pa.array([levels.ravel().tolist()], pa.list_(pa.int64()))})

    parts = blocks.mapInArrow(run, "total long, distinct long, levels array<long>")
    sums = parts.select("total", "distinct", F.posexplode("levels").alias("k", "n")).groupBy("k").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"), F.sum("n").alias("n")).collect()
    levels = np.zeros(order * 64, np.int64)
    for row in sums:
        levels[row["k"]] = row["n"]
    return (int(sums[0]["total"]), int(sums[0]["distinct"]), levels.reshape(order, 64)) if sums else (0, 0, levels.reshape(order, 64))


def _whole(parts: DataFrame, like: Filter) -> Filter:
    """All parts of the filter, put together on the driver."""
    bits = np.zeros((like.shard_size << like.shard_bits) // 8, np.uint8)
    for row in parts.filter("shard >= 0").toLocalIterator():
        part = np.frombuffer(zlib.decompress(bytes(row["part"])), np.uint8)
        at = row["shard"] * (like.shard_size // 8)
        bits[at : at + len(part)] = part
    return replace(like, bits=bits)


def _build(docs: DataFrame, text_col: str, entry_bits: int, most_bits: int, order: int) -> tuple[Model, DataFrame, DataFrame]:
    """The model without bits, the parts of the filter by shard and the exact counts in blocks."""
    shard_bits = _shard_bits(docs)
    blocks = count_ngrams(docs, text_col, shard_bits, order)
    total, distinct, levels = _summary(blocks, order)
    # an n-gram of level q makes q entries
    wanted = int((np.arange(64) * levels).sum())
    size_bits = max(shard_bits + 6, int(np.ceil(np.log2(max(2, wanted * entry_bits)))))
    shard_size = 1 << (size_bits - shard_bits)
    sharded = size_bits > max(most_bits, shard_bits + 6)
    least = max(1, -(-total >> FREQUENT_BITS))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(np.empty(0, np.uint8), shard_size, shard_bits)
        for shard, group in groupby(_rows_of(batches), key=lambda row: row[1]):
            marks = np.zeros(shard_size, bool)
            frequent, common = [], []
            for kind, _, raw in group:
                hashes, counts = _unpack_counts(raw)
                level = _level(counts)
                chosen = counts >= least
                if kind == UNIGRAM:
                    frequent.append((hashes[chosen], counts[chosen]))
                if sharded:
                    common.append(hashes[chosen])
                for q in range(1, int(level.max(initial=0)) + 1):
                    for probe in range(PROBES):
                        marks[own.place(hashes[level >= q], q, probe)] = True
            bits = np.packbits(marks, bitorder="little")
            known = np.unique(np.concatenate(common)) if common else np.empty(0, np.uint64)
            levels = replace(own, bits=bits, first=shard).levels(known).astype(np.uint8)
            out = [(shard, zlib.compress(bits.tobytes(), 1), b"", b""), (-1, b"", _pack_counts(*map(np.concatenate, zip(*frequent))) if frequent else b"", _pack(known, levels))]
            yield pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*out), [pa.int32(), pa.binary(), pa.binary(), pa.binary()])], ["shard", "part", "frequent", "common"])

    # the counts already lie by shard and kind; a shard's blocks are in one partition
    parts = cut_lineage(blocks.mapInArrow(fill, "shard int, part binary, frequent binary, common binary"))
    told = [(bytes(row["frequent"]), bytes(row["common"])) for row in parts.filter("shard < 0").toLocalIterator()]
    found = [_unpack_counts(raw) for raw, _ in told if raw]
    frequent, numbers = _add_up([h for h, _ in found], [c for _, c in found])
    found = [_unpack(raw, np.uint64, np.uint8) for _, raw in told]
    common, at = np.unique(np.concatenate([h for h, _ in found] or [np.empty(0, np.uint64)]), return_index=True)
    levels = np.concatenate([v for _, v in found] or [np.empty(0, np.uint8)])[at]
    return Model(Filter(np.empty(0, np.uint8), shard_size, shard_bits), total, distinct, frequent, numbers, common, levels, order, sharded), parts, blocks


def build(docs: DataFrame, text_col: str = "text", entry_bits: int = ENTRY_BITS, most_bits: int = MOST_BITS, order: int = ORDER) -> tuple[Model, DataFrame, DataFrame]:
    """The model of all texts of ``docs``, the parts of its filter by shard and the exact counts in blocks.

    The filter grows with its entries and leaves none out.  Each shard fills its own
    part where its counts are.  Up to ``2**most_bits`` bits the parts go to the
    driver and out to the workers with the model; a larger filter is ``sharded``:
    its parts stay where they are, and the model carries the levels of the common
    n-grams, a bounded number, only.
    """
    model, parts, blocks = _build(docs, text_col, entry_bits, most_bits, order)
    return (model if model.sharded else replace(model, filter=_whole(parts, model.filter))), parts, blocks


def _question_blocks(bits: int, hashes: np.ndarray, keys: np.ndarray, *places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of n-grams for the shards that own them, each with the texts (and the places there, if given) that ask."""
    order = np.argsort(hashes)
    hashes, keys, places = hashes[order], keys[order], [p[order] for p in places]
    found = []
    for shard, part in _cuts(hashes, bits):
        names, which = np.unique(keys[part], return_inverse=True)
        found.append((shard, _pack(hashes[part], which.astype(np.uint16), *[p[part] for p in places]) + names.tobytes()))
    yield from _batches(QUESTION, found)


def _sharded_levels(rows: DataFrame, shared, parts: DataFrame) -> DataFrame:
    """``key`` and ``found``: places in the text and levels of the n-grams that are not common, from the shards that own them.

    The texts are read once however many shards there are.  An n-gram is asked for
    with the hash of its text and its place there; common n-grams are not, so no
    shard answers for a hot one.  A shard holds its own part of the filter and
    answers block by block; n-grams that the filter lacks get no answer.
    """
    like = shared.value.filter

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        held: list[tuple] = []
        size = 0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            keys = batch.column(1).to_numpy()
            for a, b in steps(offsets):
                tokens, first = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lengths = np.diff(first)
                owner = np.repeat(np.arange(a, b), lengths)
                place = np.arange(len(tokens)) - np.repeat(first[:-1], lengths)
                for k, hashes in enumerate(_grams(tokens, first, model.order)):
                    other = np.flatnonzero(~model.common_of(hashes)[1])
                    held.append((hashes[other], keys[owner[other]], (place[other] + k * lengths[owner[other] - a]).astype(np.uint32)))
                    size += len(other)
                if size >= _GATHER:
                    yield from _question_blocks(like.shard_bits, *map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if size:
            yield from _question_blocks(like.shard_bits, *map(np.concatenate, zip(*held)))

    def out(told: list[tuple]) -> pa.RecordBatch:
        keys, places, levels = map(np.concatenate, zip(*told))
        order = np.lexsort((places, keys))
        keys, places, levels = keys[order], places[order], levels[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])
        keys, places, levels = keys[new], places[new], levels[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        return pa.record_batch({"key": pa.array(keys[starts]), "found": pa.array([_pack(places[x:y], levels[x:y]) for x, y in zip(starts.tolist(), ends.tolist())], pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, told, size = like, [], 0
        for kind, shard, raw in _rows_of(batches):
            if kind == PART:
                own = replace(like, bits=np.frombuffer(zlib.decompress(raw), np.uint8), first=shard)
            elif own.first == shard and len(own.bits):
                hashes, which, places = _unpack(raw, np.uint64, np.uint16, np.uint32)
                level = own.levels(hashes)
                there = np.flatnonzero(level)
                told.append((np.frombuffer(raw, np.int64, -1, 4 + 14 * len(hashes))[which[there]], places[there], level[there].astype(np.uint8)))
                size += len(there)
                if size >= 1_000_000:
                    yield out(told)
                    told, size = [], 0
        if size:
            yield out(told)

    asked = rows.select("text", "key").mapInArrow(ask, _BLOCKS)
    filters = parts.filter("shard >= 0").select(F.lit(PART).alias("kind"), "shard", F.col("part").alias("block"))
    return _by_shard(asked.unionByName(filters)).mapInArrow(answer, "key long, found binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, most_bits: int = MOST_BITS, order: int = ORDER) -> DataFrame:
    """Scores of all whole texts by a model of the rows where ``train`` holds (those not held out, unless given).

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-0.1 unigrams from exact counts) and ``score`` (log10
    probability by the filter's n-grams up to ``order``).  Tokens are the words with A-Z
    lower-cased, then one end; NULL and empty texts are one end.  A row without
    identifier is scored, not learned from and not held out.  Repeated rows stay.
    Without training rows every token is unknown.  Runs several jobs.

    Exact counts of frequent tokens (a bounded number) travel with the model; the
    other tokens go to the shards that hold their counts, and the sums come back.
    A filter above ``2**most_bits`` bits stays in its shards: the n-grams go to the
    shards that own them, and the levels come back by text and place; the scores
    are those of the whole filter.
    """
    if train is None:
        train = F.col(id_col).isNotNull() & ~held_out(id_col)
    model, parts, blocks = build(docs.filter(train), text_col, ENTRY_BITS, most_bits, order)
    sharded = model.sharded
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a row is known by a hash of its identifier and text; equal rows have equal sums
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("key"))
    kind = docs.schema[id_col].dataType.simpleString()

    def frequent_sums(model: Model, tokens: np.ndarray, first: np.ndarray):
        """Sum of log10(count + 0.1) over each row's frequent tokens, their number, and which tokens are others."""
        distinct, place = np.unique(tokens, return_inverse=True)
        at = np.searchsorted(model.frequent, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(model.frequent)
        known[inside] = model.frequent[at[inside]] == distinct[inside]
        value = np.zeros(len(distinct))
        value[known] = np.log10(model.frequent_counts[at[known]] + ADDED)
        known = known[place]
        return np.add.reduceat(value[place], first[:-1]), np.add.reduceat(known.astype(np.int64), first[:-1]), ~known

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in steps(offsets):
                tokens, first = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                base, known, _ = frequent_sums(model, tokens, first)
                noted = [None] * (b - a)
                if sharded:
                    levels = [model.common_of(hashes)[0] for hashes in _grams(tokens, first, order)]
                    noted = [zlib.compress(b"".join(level[x:y].tobytes() for level in levels), 1) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.record_batch(
                    {
                        "id": batch.column(0).slice(a, b - a),
                        "key": batch.column(2).slice(a, b - a),
                        "n_tokens": pa.array(np.diff(first)),
                        "known": pa.array(known),
                        "base": pa.array(base),
                        "score": pa.nulls(b - a, pa.float64()) if sharded else pa.array(model.score(tokens, first)),
                        "noted": pa.array(noted, pa.binary()),
                    }
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        held: list[tuple] = []
        size = 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            keys = batch.column(2).to_numpy()
            for a, b in steps(offsets):
                tokens, first = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                other = frequent_sums(model, tokens, first)[2]
                held.append((tokens[other], np.repeat(keys[a:b], np.diff(first))[other]))
                size += len(held[-1][0])
                if size >= _GATHER:
                    yield from _question_blocks(model.filter.shard_bits, *map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if size:
            yield from _question_blocks(model.filter.shard_bits, *map(np.concatenate, zip(*held)))

    bits = model.filter.shard_bits

    def add_sums(key: list[np.ndarray], base: list[np.ndarray], known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted texts with their summed logarithms and numbers of known tokens."""
        keys, place = np.unique(np.concatenate(key), return_inverse=True)
        return keys, np.bincount(place, np.concatenate(base)), np.bincount(place, np.concatenate(known)).astype(np.int64)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each text's tokens of a shard, in blocks of texts: a row per text and shard would be most of the shuffle."""
        sums: dict[str, list[np.ndarray]] = {"key": [], "base": [], "known": []}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, base, known = add_sums(**sums)
            for part in sums.values():
                part.clear()
            yield from _batches(ANSWER, ((slot, _pack(keys[part], base[part], known[part])) for slot, part in _cuts(keys, bits)))

        nothing = np.empty(0, np.uint64), np.empty(0, np.int64)
        own, counted = None, nothing
        for (shard, kind), group in groupby(_rows_of(batches), key=lambda row: (row[1], row[0])):
            if shard != own:
                own, counted = shard, nothing
            if kind == UNIGRAM:
                _, *counted = next(_sorted_counts(group))
                continue
            flat, numbers = counted
            for _, _, raw in group:
                h, which = _unpack(raw, np.uint64, np.uint16)
                keys = np.frombuffer(raw, np.uint64, -1, 4 + 10 * len(h))
                at = np.searchsorted(flat, h)
                there = at < len(flat)
                there[there] = flat[at[there]] == h[there]
                count = np.zeros(len(h))
                count[there] = numbers[at[there]]
                sums["key"].append(keys)
                sums["base"].append(np.bincount(which, np.log10(count + ADDED), len(keys)))
                sums["known"].append(np.bincount(which, there, len(keys)))
                size += len(keys)
                if size >= 1_000_000:
                    yield from out()
                    size = 0
        if size:
            yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text: the sums of what the shards answered, added up whenever they have doubled."""
        for _, group in groupby(_rows_of(batches), key=lambda row: row[1]):
            sums: dict[str, list[np.ndarray]] = {"key": [], "base": [], "known": []}
            size, enough = 0, _GATHER
            for _, _, raw in group:
                for part, values in zip(sums.values(), _unpack(raw, np.uint64, np.float64, np.int64)):
                    part.append(values)
                size += len(sums["key"][-1])
                if size >= enough:
                    sums = {name: [values] for name, values in zip(sums, add_sums(**sums))}
                    size = len(sums["key"][0])
                    enough = max(_GATHER, 2 * size)
            keys, base, known = add_sums(**sums)
            for at in range(0, len(keys), _BLOCK):
                part = slice(at, at + _BLOCK)
                yield pa.record_batch({"key": pa.array(keys[part].view(np.int64)), "rest": pa.array(base[part]), "rest_known": pa.array(known[part])})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their score from the levels noted at the text and those that the shards found."""
        for batch in batches:
            scores = []
            for noted, found in zip(batch.column("noted"), batch.column("found")):
                level = np.frombuffer(zlib.decompress(noted.as_py()), np.uint8).copy()
                for raw in found.values if found.is_valid else []:
                    places, levels = _unpack(raw.as_py(), np.uint32, np.uint8)
                    level[places] = levels
                counts = _middle(level.reshape(order, -1).astype(np.int64))
                scores.append(shared_bare.value.smoothed(list(counts), np.array([0, counts.shape[1]]))[0])
            columns = [pa.array(scores, pa.float64()) if name == "score" else batch.column(name) for name in _SCORED]
            yield pa.record_batch(columns, list(_SCORED))

    scored = cut_lineage(rows.mapInArrow(local, f"id {kind}, key long, n_tokens long, known long, base double, score double, noted binary"))
    if sharded:
        shared_bare = docs.sparkSession.sparkContext.broadcast(replace(model, frequent=None, frequent_counts=None, common=None, common_levels=None))
        levels = _sharded_levels(rows, shared, parts).groupBy("key").agg(F.collect_list("found").alias("found"))
        scored = cut_lineage(scored.join(levels, "key", "left").mapInArrow(meet, f"id {kind}, key long, n_tokens long, known long, base double, score double"))
    asked = rows.mapInArrow(ask, _BLOCKS).unionByName(blocks.filter(F.col("kind") == UNIGRAM))
    answers = _by_shard(_by_shard(asked).mapInArrow(answer, _BLOCKS)).mapInArrow(add, "key long, rest double, rest_known long")
    answers = answers.join(scored.groupBy("key").agg(F.count("*").alias("same")), "key")
    whole = scored.join(answers, "key", "left")
    base = F.col("base") + F.coalesce(F.col("rest") / F.col("same"), F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(model.norm)))
    known = F.col("known") + F.coalesce((F.col("rest_known") / F.col("same")).cast("long"), F.lit(0))
    return whole.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
