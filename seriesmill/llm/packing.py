"""Pack token pieces into sequences by patterns of few lengths, fitted by non-negative least squares."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.words import small_batches
from seriesmill.session import cut_lineage

#: Triples that a length takes part in, besides its pair.
SPREAD = 12
#: Steps of the projected gradient.
FIT_STEPS = 400
#: Fixed value: how byte-level vocabularies of this kind split a text before they merge bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself where it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class Encoder:
    """Token ids of a byte-level vocabulary file, as little-endian unsigned 32-bit bytes.

    The file's ids are in merge order, so they serve as merge ranks; added tokens are
    found in a text first, as the file's own library does.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as source:
            content = json.load(source)
        alphabet = byte_alphabet()
        added = {token["content"]: token["id"] for token in content.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): number for token, number in content["model"]["vocab"].items() if token not in added}
        self._table = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> bytes:
        return self._table.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Token ids of every row's whole text, then ``end_id``, in pieces of at most ``capacity`` tokens.

    Returns ``id_col``, ``piece``, ``start`` (tokens before the piece), ``length``
    and ``ids`` (binary, little-endian unsigned 32 bits each).  Only longer texts
    are cut; all pieces but the first are full.  NULL counts as empty and gives one
    piece of the end alone, a repeated row or a NULL identifier gives its own
    pieces, extra columns are ignored, an empty table gives none.  Long texts are
    encoded whole, a few batches of rows at a time.
    """
    identifier = docs.schema[id_col].dataType
    from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

    shape = StructType(
        [
            StructField(id_col, identifier),
            StructField("piece", IntegerType()),
            StructField("start", LongType()),
            StructField("length", LongType()),
            StructField("ids", BinaryType()),
        ]
    )
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                rows, piece, start, length, ids = [], [], [], [], []
                for k, text in enumerate(part.column(1)):
                    raw = encoder.encode(text.as_py() or "") + end
                    total = len(raw) // 4
                    first = total % capacity or min(total, capacity)
                    places = [0, *range(first, total, capacity)]
                    for nth, a in enumerate(places):
                        b = first + nth * capacity
                        rows.append(k)
                        piece.append(nth)
                        start.append(a)
                        length.append(b - a)
                        ids.append(raw[4 * a : 4 * b])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=shape.names,
                )

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(cut, shape)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def few_length_patterns(lengths: np.ndarray, capacity: int, spread: int = SPREAD) -> np.ndarray:
    """Patterns of one to three lengths (0: none) that fill a sequence.

    For every length its best partner, and ``spread`` evenly spaced second lengths,
    each with the best third one; of the patterns with the same longest length those
    that leave the least room are kept.
    """
    lengths = np.unique(lengths)

    def largest(room: np.ndarray) -> np.ndarray:
        at = np.searchsorted(lengths, room, "right")
        return np.where(at > 0, lengths[np.maximum(at - 1, 0)], 0)

    number = len(lengths)
    # seconds start one further for every first, so that all lengths are used about as often
    second = lengths[(np.arange(number)[:, None] + np.linspace(0, number, spread, endpoint=False).astype(int)) % max(1, number)]
    a = np.repeat(lengths, spread + 1)
    b = np.column_stack([second, largest(capacity - lengths)]).reshape(-1)
    b = np.where(a + b <= capacity, b, 0)
    c = largest(capacity - a - b)
    found = np.sort(np.stack([a, b, c], 1), axis=1)[:, ::-1]
    found = np.unique(found, axis=0)
    waste = capacity - found.sum(1)
    least = np.full(capacity + 1, capacity)
    np.minimum.at(least, found[:, 0], waste)
    return found[waste <= least[found[:, 0]]]


def fit_repeats(patterns: np.ndarray, lengths: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeats ``x >= 0`` of the patterns for which the lengths they use come nearest to ``counts`` in least squares.

    Accelerated projected gradient on the sparse pattern matrix, three entries a column.
    """
    if not len(patterns):
        return np.zeros(0)
    size = int(lengths.max()) + 1
    target = np.zeros(size)
    target[lengths] = counts
    flat = patterns.reshape(-1)

    def use(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, patterns.shape[1]), size)
        out[0] = 0
        return out

    # power steps bound the largest eigenvalue of the normal matrix
    probe = np.ones(len(patterns))
    for _ in range(20):
        image = use(probe / np.linalg.norm(probe))
        probe = image[patterns].sum(1)
    rate = 1 / (1.1 * np.linalg.norm(probe))
    x = last = np.zeros(len(patterns))
    pace = 1.0
    for _ in range(steps):
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = x + (pace - 1) / following * (x - last)
        miss = target - use(ahead)
        last, x, pace = x, np.maximum(0, ahead + rate * miss[patterns].sum(1)), following
    return x


@dataclass
class Plan:
    """Where the pieces of every length go, in order of their ranks.

    Entry k serves ranks ``first[k]`` and on of length ``length[k]``: ``times[k]``
    of them to each of the sequences from ``sequence[k]`` on, one after the other
    from ``offset[k]``.
    """

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0

    def arrays(self) -> list[np.ndarray]:
        order = np.lexsort((self.first, self.length))
        return [np.asarray(x, np.int64)[order] for x in (self.length, self.first, self.times, self.sequence, self.offset)]


def plan_sequences(lengths: Sequence[int], counts: Sequence[int], capacity: int) -> Plan:
    """A plan for ``counts`` pieces of each length; its size follows the number of lengths, not of pieces.

    Full pieces stand alone.  Patterns of few lengths are repeated as the fit says,
    rounded and never beyond what is there.  What is left over is packed from the
    longest piece on: the length that fills the room exactly, else two that do, else
    the longest that fits; equal fillings are laid out at once.
    """
    left = np.zeros(capacity + 1, np.int64)
    np.add.at(left, np.asarray(lengths, np.int64), np.asarray(counts, np.int64))
    used = np.zeros(capacity + 1, np.int64)
    plan = Plan()

    def lay(pattern: list[int], repeats: int) -> None:
        place = 0
        for length in dict.fromkeys(pattern):
            times = pattern.count(length)
            plan.length.append(length)
            plan.first.append(int(used[length]))
            plan.times.append(times)
            plan.sequence.append(plan.sequences)
            plan.offset.append(place)
            used[length] += times * repeats
            left[length] -= times * repeats
            place += times * length
        plan.sequences += repeats

    if left[capacity]:
        lay([capacity], int(left[capacity]))
    there = np.flatnonzero(left)
    patterns = few_length_patterns(there, capacity)
    repeats = fit_repeats(patterns, there, left[there]) if len(there) else np.zeros(0)
    # patterns that waste nothing, most repeated first
    for k in np.lexsort((patterns[:, 0], -repeats)) if len(patterns) else []:
        pattern = [int(x) for x in patterns[k] if x]
        if sum(pattern) < capacity:
            continue
        wanted = int(repeats[k] + 0.5)
        possible = min(int(left[x]) // pattern.count(x) for x in pattern)
        if min(wanted, possible) > 0:
            lay(pattern, min(wanted, possible))
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return plan
        pattern = [int(there[-1])]
        room = capacity - pattern[0]
        spare = left.copy()
        spare[pattern[0]] -= 1
        while room:
            fitting = np.flatnonzero(spare[: room + 1])
            if not len(fitting):
                break
            best = int(fitting[-1])
            if best < room:
                # two lengths that fill the room, the longest such pair
                other = room - fitting
                pairs = fitting[(spare[other] > 0) & ((other != fitting) | (spare[fitting] > 1))]
                if len(pairs):
                    best = int(pairs[-1])
            times = min(room // best, int(spare[best])) if best == int(fitting[-1]) else 1
            pattern += [best] * times
            spare[best] -= times
            room -= best * times
        lay(pattern, min(int(left[x]) // pattern.count(x) for x in set(pattern)))


def place_pieces(pieces: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: as few sequences of ``capacity`` tokens as the plan finds, without gaps.

    ``length_col`` lies between 1 and ``capacity``.  The driver gets one number per
    length and sends back the plan, whose size follows the lengths too.  Pieces of a
    length are ranked task by task (a hot length is cut by the tasks that hold it),
    so nothing is sorted as a whole.  All other columns stay; an empty table gives
    an empty table.  Runs jobs (``pieces`` is checkpointed).
    """
    rows = cut_lineage(pieces.withColumns({"__task": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    rows = rows.withColumn("__length", F.col(length_col).cast("long"))
    parts = cut_lineage(rows.groupBy("__length", "__task").agg(F.count(F.lit(1)).alias("__n")))
    histogram = parts.groupBy("__length").agg(F.sum("__n").alias("n")).collect()  # at most one row per length
    if any(not 1 <= row["__length"] <= capacity for row in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = plan_sequences([r["__length"] for r in histogram], [r["n"] for r in histogram], capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(plan.arrays())
    before = F.sum("__n").over(Window.partitionBy("__length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("__length", "__task", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__length", "__task").orderBy("__row"))
    ranked = rows.withColumn("__nth", nth).join(starts, ["__length", "__task"]).withColumn("__rank", F.col("__before") + F.col("__nth") - 1)
    ranked = ranked.drop("__before", "__nth", "__task", "__row")
    at = [ranked.columns.index(c) for c in ("__length", "__rank")]
    kept = [k for k in range(len(ranked.columns)) if k not in at]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, times, sequence, offset = shared.value
        key = (length << 48) + first
        for batch in batches:
            own, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in at)
            entry = np.searchsorted(key, (own << 48) + rank, "right") - 1
            copy, nth = np.divmod(rank - first[entry], times[entry])
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in kept] + [pa.array(sequence[entry] + copy), pa.array(offset[entry] + nth * own)],
                names=[batch.schema.names[k] for k in kept] + ["sequence_id", "offset"],
            )

    from pyspark.sql.types import LongType, StructField, StructType

    shape = StructType([ranked.schema[k] for k in kept] + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(place, shape)


def fill_sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id``, ``length`` and ``ids`` of every sequence, from placed pieces with their ``ids``."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.expr("aggregate(parts, cast('' as binary), (a, x) -> a || x.ids)")
    return placed.groupBy("sequence_id").agg(joined.alias("parts")).select("sequence_id", ids.alias("ids")).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")
