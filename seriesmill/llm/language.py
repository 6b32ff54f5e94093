"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The sequences are words with the space before them, so the state of the network does
not cross a space; a word of more than ``SEGMENT`` bytes goes on in further sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.words import find_words, small_batches, steps, utf8

#: Texts per language, and characters of each, that the network learns from at most.
SAMPLE_TEXTS = 300
SAMPLE_CHARACTERS = 400
#: Bytes of one sequence; a longer word goes on in the next one.
SEGMENT = 24
HIDDEN = 16
EPOCHS = 4
UNDETERMINED = "und"
#: How far from an even share of the labels towards 1 a pooled probability must be for a filter to take a text for
#: one of the languages that the network knows.
LEAST_ABOVE_EVEN = 0.05


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Direction:
    """Weights of one direction: a row of the three gates per byte value, and the recurrent matrix."""

    table: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray


@dataclass
class Network:
    """Two directions, a bias per label and the labels."""

    ahead: Direction
    back: Direction
    bias: np.ndarray
    labels: list[str]


def new_network(labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    draw = np.random.default_rng(seed)

    def direction() -> Direction:
        size = 1 / np.sqrt(hidden)
        return Direction(
            draw.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            draw.normal(0, size, (hidden, 3 * hidden)).astype(np.float32),
            draw.normal(0, size, (hidden, len(labels))).astype(np.float32),
        )

    return Network(direction(), direction(), np.zeros(len(labels), np.float32), labels)


def _run(side: Direction, x: np.ndarray, active: list[int], keep: bool):
    """Hidden states after each step; ``x`` has a sequence per row, longest first, ``active[t]`` of them reach step t."""
    hidden = side.recurrent.shape[0]
    h = np.zeros((len(x), hidden), np.float32)
    states, gates = [], []
    for t, n in enumerate(active):
        now = h[:n]
        given = side.table[x[:n, t]]
        own = now @ side.recurrent
        zr = _sigmoid(given[:, : 2 * hidden] + own[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        candidate = np.tanh(given[:, 2 * hidden :] + r * own[:, 2 * hidden :])
        after = candidate + z * (now - candidate)
        if keep:
            gates.append((now.copy(), z, r, candidate, own[:, 2 * hidden :]))
        h[:n] = after
        states.append(after)
    return states, gates


def _back_through(side: Direction, x: np.ndarray, active: list[int], gates: list, into: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and of the recurrent matrix, given those of the states."""
    hidden = side.recurrent.shape[0]
    table, recurrent = np.zeros_like(side.table), np.zeros_like(side.recurrent)
    carried = np.zeros((len(x), hidden), np.float32)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        now, z, r, candidate, own = gates[t]
        g = carried[:n] + into[t]
        gz = g * (now - candidate) * z * (1 - z)
        gc = g * (1 - z) * (1 - candidate * candidate)
        gr = gc * own * r * (1 - r)
        given = np.concatenate([gz, gr, gc], 1)
        inner = np.concatenate([gz, gr, gc * r], 1)
        np.add.at(table, x[:n, t], given)
        recurrent += now.T @ inner
        carried[:n] = g * z + inner @ side.recurrent.T
    return table, recurrent


def _both_ways(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The sequences read from their end, and how many reach each step."""
    place = np.clip(length[:, None] - 1 - np.arange(x.shape[1])[None, :], 0, None)
    active = [int(np.count_nonzero(length > t)) for t in range(int(length.max()))]
    return np.take_along_axis(x, place, 1), active


def label_positions(net: Network, x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sum over its positions of every sequence's label probabilities; rows go from the longest to the shortest."""
    reverse, active = _both_ways(x, length)
    ahead, _ = _run(net.ahead, x, active, False)
    back, _ = _run(net.back, reverse, active, False)
    scores = np.zeros((len(x), len(active), len(net.labels)), np.float32)
    for t, n in enumerate(active):
        scores[:n, t] += ahead[t] @ net.ahead.out
        scores[np.arange(n), length[:n] - 1 - t] += back[t] @ net.back.out
    scores += net.bias
    scores -= scores.max(2, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(2, keepdims=True)
    scores *= (np.arange(len(active))[None, :] < length[:, None])[:, :, None]
    return scores.sum(1)


def train(net: Network, x: np.ndarray, length: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = 512, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit by backpropagation through time: every position has the label of its text (Adam steps)."""
    draw = np.random.default_rng(seed)
    weights = [net.ahead.table, net.ahead.recurrent, net.ahead.out, net.back.table, net.back.recurrent, net.back.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    done, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        shuffled = draw.permutation(len(x))
        for begin in range(0, len(x), batch):
            rows = shuffled[begin : begin + batch]
            rows = rows[np.argsort(-length[rows], kind="stable")]
            xs, ls, ys = x[rows], length[rows], label[rows]
            reverse, active = _both_ways(xs, ls)
            ahead, ahead_gates = _run(net.ahead, xs, active, True)
            back, back_gates = _run(net.back, reverse, active, True)
            grads = [np.zeros_like(w) for w in weights]
            into_ahead = [np.zeros_like(s) for s in ahead]
            into_back = [np.zeros_like(s) for s in back]
            count = float(ls.sum())
            for t, n in enumerate(active):
                # position t of a sequence is step length - 1 - t from its end
                step = ls[:n] - 1 - t
                other = np.empty_like(ahead[t])
                for u in np.unique(step):
                    at = np.flatnonzero(step == u)
                    other[at] = back[u][at]
                scores = ahead[t] @ net.ahead.out + other @ net.back.out + net.bias
                scores -= scores.max(1, keepdims=True)
                p = np.exp(scores)
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), ys[:n]] -= 1
                p /= count
                grads[2] += ahead[t].T @ p
                grads[5] += other.T @ p
                grads[6] += p.sum(0)
                into_ahead[t] += p @ net.ahead.out.T
                for u in np.unique(step):
                    at = np.flatnonzero(step == u)
                    into_back[u][at] += p[at] @ net.back.out.T
            grads[0], grads[1] = _back_through(net.ahead, xs, active, ahead_gates, into_ahead)
            grads[3], grads[4] = _back_through(net.back, reverse, active, back_gates, into_back)
            done += 1
            speed = rate * (1 - 0.9 * done / total)
            for w, g, a, b in zip(weights, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= speed * (a / (1 - 0.9**done)) / (np.sqrt(b / (1 - 0.99**done)) + 1e-8)
    return net


def _segments(data: np.ndarray, offsets: np.ndarray):
    """The distinct sequences of some rows: padded bytes and lengths, and for every sequence in the rows its row and which it is.

    A sequence is a word with the space before it, cut at ``SEGMENT`` bytes.
    """
    words = find_words(data, offsets, lower=False)
    length = words.end - words.start
    _, which, back = np.unique(words.hash, return_index=True, return_inverse=True)
    # distinct words, then their segments
    pieces = np.maximum(1, -(-(length[which] + 1) // SEGMENT))
    word = np.repeat(np.arange(len(which)), pieces)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = words.start[which][word] + nth * SEGMENT - 1
    size = np.minimum(SEGMENT, length[which][word] + 1 - nth * SEGMENT)
    place = begin[:, None] + np.arange(SEGMENT)[None, :]
    there = np.arange(SEGMENT)[None, :] < size[:, None]
    x = np.where(there, data[np.clip(place, 0, max(0, len(data) - 1))], 0).astype(np.uint8)
    x[nth == 0, 0] = 0x20
    return x, size, word, words, back


def _pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean label probabilities over all positions of each row; zero for a row without words."""
    rows, kinds = len(offsets) - 1, len(net.labels)
    out = np.zeros((rows, kinds))
    x, size, word, words, back = _segments(data, offsets)
    if not len(x):
        return out
    order = np.argsort(-size, kind="stable")
    sums = np.empty((len(x), kinds), np.float32)
    for a in range(0, len(order), 8192):
        part = order[a : a + 8192]
        sums[part] = label_positions(net, x[part], size[part])
    of_word = np.zeros((int(word[-1]) + 1, kinds))
    np.add.at(of_word, word, sums)
    for k in range(kinds):
        out[:, k] = np.bincount(words.row, of_word[back, k], rows)
    positions = np.bincount(words.row, words.end - words.start + 1, rows)
    return out / np.maximum(positions, 1)[:, None]


def held_out(id_col: str) -> Column:
    """Rows that the network may not learn from; a row without identifier is not held out (nor learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, characters: int = SAMPLE_CHARACTERS) -> Network | None:
    """The network, from a sample of labelled texts that is bounded by ``texts`` per language; None without any.

    Texts are drawn by a hash of the identifier, and ``characters`` of each from a
    place drawn likewise.  NULL labels, NULL identifiers, held-out rows and texts
    without a letter are left out.  The labels in use are counted first, so the
    draw reads no more texts than about twice the bound.  Of a word only the
    first segment (23 bytes) is learned from, so windows without spaces teach little.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = usable.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) / 1_000_000
    share = F.lit(0.0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * texts / count + 20 / count))).otherwise(share)
    start = F.floor(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000)) / 1_000_000 * F.greatest(F.lit(0), F.length("text") - characters)).cast("int") + 1
    cut = usable.filter(draw < share).filter(F.col("text").rlike("\\p{L}"))
    cut = cut.select("lang", "id", draw.alias("draw"), F.substring(F.col("text"), start, F.lit(characters)).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    sample = cut.withColumn("nth", nth).filter(F.col("nth") <= texts).select("lang", "text").collect()
    labels = sorted({r["lang"] for r in sample})
    if not labels:
        return None
    sample.sort(key=lambda r: (r["lang"], r["text"]))
    data, offsets = utf8(pa.array([r["text"] for r in sample], pa.string()))
    x, size, word, words, back = _segments(data, offsets)
    # every occurrence of a word counts, each with its own label
    own = np.searchsorted(np.asarray(labels), np.asarray([r["lang"] for r in sample]))[words.row]
    first = np.searchsorted(word, back)
    x, size = x[first], size[first]
    return train(new_network(labels), x, size, own)


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", carry: list[str] | None = None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``carry`` (all, unless given), the label of every whole text and its pooled probability.

    ``und`` with score 0 where the text is NULL or has no letter, and everywhere
    without a network.  Repeated rows and NULLs are kept; of equal probabilities the
    first label in order wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in steps(offsets):
                labels, best = [UNDETERMINED] * (b - a), np.zeros(b - a)
                if net is not None:
                    pooled = _pooled(net, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    chosen = pooled.argmax(1)
                    best = np.where(letters[a:b], np.clip(pooled.max(1), 0, 1), 0.0)
                    labels = [net.labels[k] if good else UNDETERMINED for k, good in zip(chosen.tolist(), letters[a:b].tolist())]
                rest = [c.slice(a, b - a) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(labels, pa.string()), pa.array(best)], [*batch.schema.names[2:], pred, score])

    carry = docs.columns if carry is None else carry
    letters = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    source = small_batches(docs).select(F.col(text_col).alias("__text"), letters.alias("__letters"), *[F.col(f"`{c}`") for c in carry])
    shape = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return source.mapInArrow(run, f"{shape}`{pred}` string, `{score}` double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out and label all rows: ``id_col``, ``held_out``, ``lang_pred``, ``score``.

    A row per input row: repeated rows and NULL identifiers stay, texts of any length
    are read whole.  Extra columns are ignored whatever they are called.  An empty
    table gives none.  NULLs, ties and missing labels as in :func:`predict`.
    """
    net = fit(docs, id_col, text_col, lang_col)
    labelled = predict(docs, net, text_col, [id_col])
    return labelled.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, least: float | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the texts that have no language: no letter, or a pooled probability below ``least``.

    Unless given, that is ``LEAST_ABOVE_EVEN`` of the way from an even share to 1: texts of
    several languages stay, texts that the network cannot tell from noise go.

    Without any labelled row to learn from, only texts without a letter go.
    """
    net = fit(docs, id_col, text_col, lang_col)
    if net is None:
        return docs.filter(F.col(text_col).rlike("\\p{L}"))
    if least is None:
        least = (1 + LEAST_ABOVE_EVEN * (len(net.labels) - 1)) / len(net.labels)
    named = predict(docs, net, text_col, None, "__lang_pred", "__lang_score")
    return named.filter((F.col("__lang_pred") != UNDETERMINED) & (F.col("__lang_score") >= least)).drop("__lang_pred", "__lang_score")
