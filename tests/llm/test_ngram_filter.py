import math
import zlib
from collections import Counter

import numpy as np
import pytest

from seriesmill.llm import ngram_filter as N
from tests.llm.conftest import WORD, lower


def tokens(text):
    return [*WORD.findall(lower(text)), None]


def learned(rows):
    single, pair = Counter(), Counter()
    for r in rows:
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10:
            words = tokens(r[1])
            single.update(words)
            pair.update(zip([""] + words, words))
    return single, pair


@pytest.mark.parametrize("frequent", [22, 3, -40])
def test_base_scores_equal_brute_force(docs, rows, monkeypatch, frequent):
    """Whatever share of the tokens travels with the model, sums over the shards are whole."""
    monkeypatch.setattr(N, "FREQUENT_BITS", max(frequent, 0))
    single, pair = learned(rows)
    total, norm = sum(single.values()), math.log10(sum(single.values()) + 0.1 * (len(single) + 1))
    want = []
    for r in rows:
        words = tokens(r[1])
        held = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0
        want.append((r[0], held, len(words), sum(single[w] > 0 for w in words), total, round(sum(math.log10(single[w] + 0.1) - norm for w in words), 5)))
    got = [(*tuple(r)[:5], round(r["base_score"], 5)) for r in N.score(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_filter_scores_follow_exact_counts(docs, rows):
    """Quantised counts and chance hits move a token's log10 probability by little on average."""
    single, pair = learned(rows)
    norm = sum(single.values()) + 0.1 * (len(single) + 1)
    by_text = {}
    for r in rows:
        words = tokens(r[1])
        score = 0.0
        for a, b in zip([""] + words, words):
            history = single[None] if a == "" else single[a]
            score += math.log10((pair[a, b] + 4 * (single[b] + 0.1) / norm) / (history + 4))
        by_text[r[0], len(words)] = score
    moved = [(r["score"] - by_text[r["doc_id"], r["n_tokens"]]) / r["n_tokens"] for r in N.score(docs).collect() if r["doc_id"] is not None]
    assert abs(np.mean(moved)) < 0.1 and np.max(np.abs(moved)) < 1


def test_filter_never_loses_an_entry_and_levels_go_up():
    draw = np.random.default_rng(2)
    hashes = np.sort(draw.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2))
    counts = draw.integers(1, 200, 2000)
    level = N._level(counts)
    assert [int(N._level(np.array([c]))[0]) for c in (1, 2, 3, 4, 7, 8)] == [1, 2, 2, 3, 3, 4]
    size = 1 << 8
    own = N.Filter(np.zeros((size << 8) // 8, np.uint8), size, 8)
    for q in range(1, int(level.max()) + 1):
        chosen = hashes[level >= q]
        for probe in range(N.PROBES):
            at = N._shard(chosen, 8) * size + own.place(chosen, q, probe)
            np.bitwise_or.at(own.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    assert (own.levels(hashes) >= level).all()
    absent = draw.integers(0, 2**63, 2000, dtype=np.uint64)
    assert np.mean(own.levels(absent) > 0) < 0.6


def test_a_filter_holds_the_bits_it_may(docs):
    model, _, _ = N.build(docs, most_bits=30)
    assert not model.sharded and len(model.filter.bits) * 8 == model.filter.shard_size << model.filter.shard_bits
    assert model.total == sum(len(tokens(r["text"])) for r in docs.select("text").collect())


@pytest.mark.parametrize("frequent, order", [(22, 2), (5, 3)])
def test_a_filter_in_shards_scores_as_the_whole_one(docs, monkeypatch, frequent, order):
    """Also where few n-grams are common, and with rows that repeat."""
    monkeypatch.setattr(N, "FREQUENT_BITS", frequent)

    def scores(**how):
        got = N.score(docs, order=order, **how).drop("base_score").collect()
        return sorted((repr(tuple(r)[:-1]), r["score"]) for r in got)

    model = N.build(docs, most_bits=14, order=order)[0]
    assert model.sharded and not len(model.filter.bits) and 0 < len(model.common)
    whole, sharded = scores(), scores(most_bits=14)
    assert [k for k, _ in sharded] == [k for k, _ in whole]
    assert [s for _, s in sharded] == pytest.approx([s for _, s in whole], rel=1e-12)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_formula_on_quantised_counts(docs, rows, order):
    """With a filter so wide that nothing collides, every score is the formula's."""
    counted = [Counter() for _ in range(order)]
    short = docs.filter("doc_id < 60")
    own = [r for r in rows if r[0] is not None and r[0] < 60]

    def ends(words, k):
        padded = [""] * (k - 1) + words
        return [tuple(padded[t : t + k]) for t in range(len(words))]

    for r in own:
        if zlib.crc32(str(r[0]).encode()) % 10:
            for k in range(order):
                counted[k].update(ends(tokens(r[1]), k + 1))
    norm = sum(counted[0].values()) + 0.1 * (len(counted[0]) + 1)
    for k in range(order):
        counted[k] = Counter({gram: float(N._middle(N._level(np.array([c])))[0]) for gram, c in counted[k].items()})
    want = {}
    for r in own:
        words, score = tokens(r[1]), 0.0
        for t in range(len(words)):
            value = (counted[0][words[t],] + 0.1) / norm
            for k in range(1, order):
                history = ([""] * k + words)[t : t + k]
                before = counted[0][None,] if t == 0 else counted[k - 1][tuple(history)]
                value = (counted[k][tuple([*history, words[t]])] + 4 * value) / (before + 4)
            score += math.log10(value)
        want[r[0]] = score
    model = N.build(short.filter(~N.held_out("doc_id")), entry_bits=4000, order=order)[0]
    for r in own:
        data = (r[1] or "").encode()
        found = model.score(*N._tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
        assert found[0] == pytest.approx(want[r[0]], rel=1e-9)


def test_a_bigram_is_held_below_its_history_and_its_end():
    model = N.Model(None, 100, 10, None, None, None, None)
    got = model.smoothed([np.array([5.0, 2.0]), np.array([9.0, 9.0])], np.array([0, 2]))
    first, second = (5.1 / model.norm * 4 + 2) / 6, (2.1 / model.norm * 4 + 2) / 9
    assert got[0] == pytest.approx(math.log10(first) + math.log10(second))


def test_counts_of_a_shard_are_added_up_as_they_come(monkeypatch):
    monkeypatch.setattr(N, "_GATHER", 50)
    draw = np.random.default_rng(1)
    blocks, want = [], Counter()
    for kind, shard in [(1, 0), (2, 0), (1, 3)]:
        for _ in range(40):
            hashes = np.unique(draw.integers(0, 90, 30).astype(np.uint64))
            counts = draw.integers(1, 400, len(hashes))
            want.update({(kind, shard, int(h)): int(c) for h, c in zip(hashes, counts)})
            blocks.append((kind, shard, N._pack_counts(hashes, counts)))
    got = list(N._sorted_counts(iter(blocks)))
    assert [k for k, _, _ in got] == [1, 2, 1]
    for (_, hashes, counts), at in zip(got, [(1, 0), (2, 0), (1, 3)]):
        assert dict(zip(hashes.tolist(), counts.tolist())) == {h: c for (k, s, h), c in want.items() if (k, s) == at}


def test_empty_tables(nothing, docs, rows):
    assert N.score(nothing).collect() == []
    from pyspark.sql import functions as F

    got = N.score(docs, train=F.lit(False)).collect()
    assert len(got) == len(rows) and {(r["n_known"], r["train_tokens"]) for r in got} == {(0, 0)}


def test_answers_travel_in_blocks_of_texts(spark, monkeypatch):
    """A row per text and shard would grow with both; blocks are as many as shards and tasks make them."""
    monkeypatch.setattr(N, "FREQUENT_BITS", 0)
    seen, by_shard = [], N._by_shard
    monkeypatch.setattr(N, "_by_shard", lambda df: seen.append(df) or by_shard(df))
    texts = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 59), k -> concat('w', id * 60 + k))) AS text")
    assert N.score(texts).count() == 400
    answers = seen[-1]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.kind for r in answers.select("kind").distinct().collect()} == {N.ANSWER}
    assert answers.count() <= tasks << N.LEAST_SHARD_BITS
