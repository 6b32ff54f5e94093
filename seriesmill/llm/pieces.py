"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiling joins three machines into one that reads raw characters: the normaliser
(a space becomes the word mark), the vocabulary (a path of characters that emits
a piece) and the byte fallback (a character without a piece emits its bytes, at a
high cost).  Encoding composes the machine with a text, position by position, and
takes the shortest path in the tropical semiring (costs add up along a path, the
least path wins).  A unigram vocabulary costs its negative scores.  A merge
vocabulary has a second machine that remembers the last piece and lets a piece
follow only where merging the two texts gives these two pieces again; exactly one
path is left, the one that the merges make.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.words import small_batches

# Fixed values of the model file format.
WORD_MARK = "▁"
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: Words whose pieces a worker remembers; the memory starts anew when it is full.
REMEMBERED = 200_000
#: Pairs of pieces whose verdict a worker remembers.
REMEMBERED_PAIRS = 1_000_000
_LONGEST_REMEMBERED = 40
_UNKNOWN_COST = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one message of the model file."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 2: None, 5: 4}[key & 7]
            size = number() if size is None else size
            yield key >> 3, raw[at : at + size]
            at += size


@dataclass
class Vocabulary:
    """Pieces with scores and kinds, and the settings of the normaliser, as a model file states them."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model: int = UNIGRAM
    byte_fallback: bool = False
    mark_first: bool = True


def read_vocabulary(path: str) -> Vocabulary:
    """Read a model file.  Only the identity normaliser is known; others raise."""
    with open(path, "rb") as file:
        raw = file.read()
    own = Vocabulary()
    for number, value in _fields(raw):
        if number == 1:
            parts = dict(_fields(value))
            own.pieces.append(parts[1].decode())
            own.scores.append(float(np.frombuffer(parts.get(2, b"\0\0\0\0"), np.float32)[0]))
            own.kinds.append(parts.get(3, NORMAL))
        elif number == 2:
            parts = dict(_fields(value))
            own.model, own.byte_fallback = parts.get(3, UNIGRAM), bool(parts.get(35, 0))
        elif number == 3:
            parts = dict(_fields(value))
            own.mark_first = bool(parts.get(3, 1))
            if parts.get(2) or parts.get(4, 1) or not parts.get(5, 1):
                raise ValueError("only the identity normaliser that keeps all white space is supported")
    if own.model not in (UNIGRAM, MERGES):
        raise ValueError(f"vocabulary of kind {own.model} is not supported")
    if USER_DEFINED in own.kinds:
        raise ValueError("user-defined pieces are not supported")
    return own


class Transducer:
    """The compiled machine; small enough to broadcast (a few MB for 32,000 pieces)."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.merges = vocabulary.model == MERGES
        self.mark_first = vocabulary.mark_first
        self.texts = [p.replace(WORD_MARK, " ") for p in vocabulary.pieces]
        usable = [k for k, kind in enumerate(vocabulary.kinds) if kind == NORMAL]
        self.longest = max((len(self.texts[k]) for k in usable), default=1)
        self.score = {self.texts[k]: vocabulary.scores[k] for k in usable}
        # a state is a dictionary from character to [next state, piece that is emitted there or -1]
        self.start: dict = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for k in usable:
            text = self.texts[k]
            if self.merges:
                parts, last = self.merge(text)
                if parts != [text]:
                    continue
                if last is not None:
                    self.halves[text] = last
            arc = [self.start, -1]
            for character in text:
                arc = arc[0].setdefault(character, [{}, -1])
            arc[1] = k
        self.cost = [0.0 if self.merges else -s for s in vocabulary.scores]
        self.least = max((-s for s in vocabulary.scores), default=0.0) + _UNKNOWN_COST
        self.byte = {}
        self.bytes: list[bytes] = []
        for k, (text, kind) in enumerate(zip(self.texts, vocabulary.kinds)):
            value = int(text[3:5], 16) if kind == BYTE else None
            self.bytes.append(bytes([value]) if kind == BYTE else text.encode() if kind == NORMAL else b"")
            if kind == BYTE and vocabulary.byte_fallback:
                self.byte[value] = k
        self.unknown = vocabulary.kinds.index(UNKNOWN) if UNKNOWN in vocabulary.kinds else 0
        self.single = {c for c, arc in self.start.items() if arc[1] >= 0}
        # no piece goes on after a word's end: words can be encoded one by one,
        # and so can the parts between ASCII characters that no piece has
        self.by_word = all(" " not in self.texts[k].lstrip(" ") for k in usable)
        letters = set().union(*self.score)
        apart = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in letters)
        self.word = re.compile(f" *[^ {apart}]+| +|[{apart}]" if apart else " *[^ ]+| +")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces that greedy merging makes of a short text (best score first, from the left), and the last merge."""
        parts, last = list(text), None
        score = self.score
        while len(parts) > 1:
            best, place = None, -1
            for k in range(len(parts) - 1):
                now = score.get(parts[k] + parts[k + 1])
                if now is not None and (best is None or now > best):
                    best, place = now, k
            if best is None:
                break
            last = parts[place], parts[place + 1]
            parts[place : place + 2] = [last[0] + last[1]]
        return parts, last

    def follows(self, last: int, piece: int) -> bool:
        """Whether ``piece`` may come after ``last`` (-1: after a start or a fallback, always).

        The merges that made the two are undone from the latest on.  Had the parts
        that then touch been merged before the merge just undone, the two pieces
        would not have come about; of equal scores the merge further left is first.
        """
        if last < 0 or not self.merges:
            return True
        a, b = self.texts[last], self.texts[piece]
        score, halves = self.score, self.halves
        bound, right = float("-inf"), False
        while True:
            across = score.get(a + b)
            if across is not None and (across > bound or (right and across == bound)):
                return False
            made_a, made_b = halves.get(a), halves.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or (made_a is not None and score[a] < score[b]):
                bound, right, a = score[a], False, made_a[1]
            else:
                bound, right, b = score[b], True, made_b[0]

    def _may_follow(self, last: int, piece: int) -> bool:
        good = self.pairs.get((last, piece))
        if good is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            good = self.pairs[last, piece] = self.follows(last, piece)
        return good

    def _arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """End and piece of the machine's paths that read ``text`` from ``at`` on and emit one piece, by length."""
        state, out, end = self.start, [], at
        for character in text[at : at + self.longest]:
            arc = state.get(character)
            if arc is None:
                break
            state, piece = arc
            end += 1
            if piece >= 0:
                out.append((end, piece))
        return out

    def shortest_path(self, text: str) -> list[int]:
        """Pieces of the cheapest path through the machine that reads ``text``."""
        if self.merges and self.single.issuperset(text):
            path = self._only_path(text)
            if path is not None:
                return path
        size = len(text)
        cost: list[float | None] = [None] * (size + 1)
        came: list[tuple[int, int]] = [(0, -1)] * (size + 1)
        cost[0] = 0.0
        for at in range(size):
            so_far, last = cost[at], came[at][1]
            if so_far is None:
                continue
            for end, piece in self._arcs(text, at):
                weight = self.cost[piece]
                if (cost[end] is None or so_far + weight < cost[end]) and (not self.merges or self._may_follow(last, piece)):
                    cost[end], came[end] = so_far + weight, (at, piece)
            if text[at] not in self.single and (cost[at + 1] is None or so_far + self.least < cost[at + 1]):
                cost[at + 1], came[at + 1] = so_far + self.least, (at, -1)
        back, at = [], size
        while at:
            begin, piece = came[at]
            if piece < 0:
                raw = text[begin:at].encode("utf-8", "replace")
                back += [self.byte[b] for b in reversed(raw)] if self.byte else [self.unknown]
            else:
                back.append(piece)
            at = begin
        back.reverse()
        return back

    def _only_path(self, text: str) -> list[int] | None:
        """The one path that the pair machine leaves where every character has a piece.

        All its arcs cost nothing, so the first whole path that a search finds is the
        cheapest; longer pieces are tried first, and dead ends only once.
        """
        path, ends, open_arcs, dead = [], [0], [self._arcs(text, 0)], set()
        size, pairs, last = len(text), self.pairs, -1
        while ends[-1] < size:
            arcs = open_arcs[-1]
            while arcs:
                end, piece = arcs.pop()
                good = pairs.get((last, piece))
                if good is None:
                    good = self._may_follow(last, piece)
                if good and (end, piece) not in dead:
                    path.append(piece)
                    ends.append(end)
                    open_arcs.append(self._arcs(text, end))
                    last = piece
                    break
            else:
                if not path:
                    return None
                dead.add((ends.pop(), path.pop()))
                open_arcs.pop()
                last = path[-1] if path else -1
        return path

    def encode(self, text: str) -> np.ndarray:
        """Piece numbers of a text; an empty text has none."""
        if not text:
            return np.empty(0, np.int32)
        whole = " " + text if self.mark_first else text
        if not self.by_word:
            return np.asarray(self.shortest_path(whole), np.int32)
        words = self.word.findall(whole)
        out = list(map(self.known.get, words))
        if None in out:
            for k, packed in enumerate(out):
                if packed is None:
                    out[k] = self._word(words[k])
        return np.frombuffer(b"".join(out), np.int32)

    def _word(self, word: str) -> bytes:
        """A word's pieces as bytes; words seen lately are remembered, in two halves of which the older goes."""
        packed = self.known.get(word) or self.older.get(word)
        if packed is None:
            packed = array("i", self.shortest_path(word)).tobytes()
        if len(word) <= _LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[word] = packed
        return packed

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece numbers: the machine read backwards."""
        table = self.bytes
        text = b"".join([table[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.mark_first and text.startswith(" ") else text


def _encoded(batch: pa.RecordBatch, encoder: Transducer, into: str) -> pa.RecordBatch:
    """``batch`` without its first column, the texts, and with their pieces."""
    found = [None if t is None else encoder.encode(t) for t in batch.column(0).to_pylist()]
    ends = np.concatenate([[0], np.cumsum([0 if f is None else len(f) for f in found])]).astype(np.int32)
    flat = np.concatenate([f for f in found if f is not None] or [np.empty(0, np.int32)])
    absent = pa.array([f is None for f in found], pa.bool_())
    return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=absent)], [*batch.schema.names[1:], into])


def _decoded(batch: pa.RecordBatch, decoder: Transducer, into: str) -> pa.RecordBatch:
    """``batch`` without its first column, the pieces, and with their texts."""
    ids = batch.column(0)
    flat = ids.flatten().to_numpy()
    ends = np.cumsum([0 if n is None else n for n in pc.list_value_length(ids).to_pylist()])
    texts = [None if not there else decoder.decode(flat[a:b]) for there, a, b in zip(ids.is_valid().to_pylist(), [0, *ends[:-1].tolist()], ends.tolist())]
    return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], into])


def encode(docs: DataFrame, path: str, text_col: str = "text", into: str = "pieces") -> DataFrame:
    """``docs`` without ``text_col`` and with ``into``: the piece numbers of every whole text (``array<int>``).

    ``path`` names the model file; the driver reads it and broadcasts the compiled
    machine.  NULL stays NULL, an empty text has no pieces.  A literal word mark in
    a text goes through the byte fallback, so that decoding gives the text back.
    Other columns, repeated rows and NULLs in them pass through; a column that is
    called ``into`` already is replaced.
    """
    machine = docs.sparkSession.sparkContext.broadcast(Transducer(read_vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _encoded(batch, machine.value, into)

    others = [c for c in docs.columns if c not in (text_col, into)]
    source = small_batches(docs).select(text_col, *others)
    shape = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in others)
    return source.mapInArrow(run, f"{shape}{', ' if shape else ''}`{into}` array<int>")


def decode(encoded: DataFrame, path: str, pieces_col: str = "pieces", into: str = "text") -> DataFrame:
    """``encoded`` without ``pieces_col`` and with ``into``: the text of the piece numbers; NULL stays NULL."""
    machine = encoded.sparkSession.sparkContext.broadcast(Transducer(read_vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _decoded(batch, machine.value, into)

    others = [c for c in encoded.columns if c not in (pieces_col, into)]
    source = small_batches(encoded).select(pieces_col, *others)
    shape = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in others)
    return source.mapInArrow(run, f"{shape}{', ' if shape else ''}`{into}` string")


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text, unless given), ``n_pieces``, ``pieces`` and ``decoded_sha256``.

    The last is the digest of the text that the pieces decode to: that of the whole
    text, and NULL for NULL, which has 0 pieces.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    keep = [c for c in keep if c not in ("pieces", "n_pieces", "decoded_sha256")]
    machine = docs.sparkSession.sparkContext.broadcast(Transducer(read_vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one worker, hence one machine in memory, for both ways
        for batch in batches:
            there = _encoded(batch, machine.value, "pieces")
            last = there.num_columns - 1
            yield _decoded(there.select([last, *range(last), last]), machine.value, "__decoded")

    source = small_batches(docs).select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    shape = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    decoded = source.mapInArrow(run, f"{shape}`pieces` array<int>, `__decoded` string")
    count = F.when(F.col("pieces").isNull(), 0).otherwise(F.size("pieces")).cast("long")
    return decoded.select(*[F.col(f"`{c}`") for c in keep], count.alias("n_pieces"), "pieces", F.sha2("__decoded", 256).alias("decoded_sha256"))
