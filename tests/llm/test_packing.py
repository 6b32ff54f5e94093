import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesmill.llm import packing
from seriesmill.llm.queries import TOKENS, op12_pattern_packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENS)


def expected(library, text, capacity):
    ids = library.encode(text or "", add_special_tokens=False).ids + [0]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
    return [(k, a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_ids_equal_the_library(library, rows):
    encoder = packing.Encoder(TOKENS)
    draw = random.Random(2)
    odd = ["", "  \n\n b", "<|endoftext|> x<|endoftext|>", "I'll 'Re don't\x1c\x1d a\x85b　\n\n  c", "\x00日本語 ١٢½ ​", " " * 500 + "x", "a" * 30_000]
    odd += ["".join(draw.choice("ab 1\n\t'é中.! <|s") for _ in range(80)) for _ in range(300)]
    for text in odd + [r[1] or "" for r in rows]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [2048, 7])
def test_pieces_and_places_of_whole_texts(spark, docs, rows, library, capacity):
    pieces = packing.token_pieces(docs, TOKENS, capacity)
    placed = packing.place_pieces(pieces, capacity)
    found = placed.collect()
    want = Counter((r[0], k, start, tuple(ids)) for r in rows for k, start, ids in expected(library, r[1], capacity))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in found) == want
    assert all(r["length"] == len(r["ids"]) // 4 for r in found)
    # sequences have no gaps and stay within the capacity
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts[:-1]]).tolist() and sum(p[1] for p in parts) <= capacity
    assert len(sequences) <= -(-sum(r["length"] for r in found) // capacity) + 2
    filled = {r["sequence_id"]: bytes(r["ids"]) for r in packing.fill_sequences(placed).collect()}
    assert filled == {k: b"".join(p[2] for p in parts) for k, parts in sequences.items()}


def test_empty_table_and_lengths_out_of_range(spark, nothing):
    placed = packing.place_pieces(packing.token_pieces(nothing, TOKENS))
    assert placed.count() == 0 and placed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    with pytest.raises(ValueError):
        packing.place_pieces(spark.createDataFrame([(9,)], "length long"), 8).collect()


def test_query_gives_the_digests_of_the_ids(spark, folder):
    pieces = packing.token_pieces(spark.read.parquet(f"{folder}/documents.parquet"), TOKENS).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    found = op12_pattern_packing(spark, folder)
    assert sorted(found.select(*pieces.columns).collect()) == sorted(pieces.collect())




@pytest.mark.parametrize("seed", range(6))
def test_plan_serves_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    capacity = [2048, 100, 64, 2048, 30, 2048][seed]
    lengths = np.unique(draw.integers(1, capacity + 1, [300, 60, 9, 2000, 30, 3][seed]))
    counts = draw.integers(1, [50, 400, 10**6, 3, 10**9, 70][seed], len(lengths))
    plan = packing.plan_sequences(lengths.tolist(), counts.tolist(), capacity)
    length, first, times, sequence, offset = plan.arrays()
    total = dict(zip(lengths.tolist(), counts.tolist()))
    room = {}
    for k in range(len(length)):
        last = first[k + 1] if k + 1 < len(length) and length[k + 1] == length[k] else total[int(length[k])]
        assert (last - first[k]) % times[k] == 0
        room.setdefault((int(sequence[k]), int((last - first[k]) // times[k])), []).append((int(offset[k]), int(length[k] * times[k])))
    assert {int(n): int(f) for n, f in zip(length[::-1], first[::-1])} == dict.fromkeys(total, 0)
    # the entries of a pattern stand side by side, and patterns follow each other without a hole
    at = 0
    for (start, copies), parts in sorted(room.items()):
        parts.sort()
        assert start == at and [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts[:-1]]).tolist() and sum(p[1] for p in parts) <= capacity
        at += copies
    assert at == plan.sequences


def test_sequences_come_near_the_least_number():
    draw = np.random.default_rng(1)
    lengths, counts = np.unique(np.minimum(draw.geometric(1 / 500, 30_000), 2048), return_counts=True)
    plan = packing.plan_sequences(lengths.tolist(), counts.tolist(), 2048)
    least = -(-int((lengths * counts).sum()) // 2048)
    assert plan.sequences <= least * 1.002 + 1
    # a short histogram against all partitions: 6 pieces of 6 and 6 of 4 fill 6 sequences of 10
    assert packing.plan_sequences([6, 4], [6, 6], 10).sequences == 6
    assert packing.plan_sequences([5, 3, 2], [4, 2, 5], 10).sequences == 4


def test_fit_is_the_least_squares_point():
    lengths = np.array([2, 3, 5, 7])
    patterns = np.array([[7, 3, 0], [5, 5, 0], [5, 3, 2]])
    counts = np.array([4, 10, 8, 6])
    x = packing.fit_repeats(patterns, lengths, counts, 4000)
    matrix = np.array([[0, 0, 1], [1, 0, 1], [0, 2, 1], [1, 0, 0]], float)
    best = min(
        (np.linalg.norm(matrix[:, list(s)] @ y - counts), s)
        for s in [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]
        for y in [np.linalg.lstsq(matrix[:, list(s)], counts, rcond=None)[0]]
        if (y >= 0).all()
    )
    assert (x >= 0).all() and abs(np.linalg.norm(matrix @ x - counts) - best[0]) < 1e-6
