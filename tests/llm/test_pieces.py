import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

from seriesmill.llm.pieces import Transducer, Vocabulary, decode, encode, read_vocabulary, round_trip
from seriesmill.llm.queries import PIECES

pytestmark = pytest.mark.skipif(not Path(PIECES).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def machine():
    return Transducer(read_vocabulary(PIECES))


def samples():
    draw = random.Random(3)
    parts = list("abcdefghij  \n\t éñß中文🙂#',._-AEIOU12345") + ["the ", "tion", "ing ", "  ", "<0x41>", "<s>"]
    return ["", " ", "a", "   x  ", *["".join(draw.choice(parts) for _ in range(draw.randint(1, 60))) for _ in range(800)]]


def test_pieces_equal_the_library(machine):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    for text in samples():
        assert machine.encode(text).tolist() == library.encode(text), text


def test_round_trip_of_any_text(machine):
    for text in [*samples(), "▁ literal ▁▁ marks", "\x00\x01", "x" * 5000]:
        assert machine.decode(machine.encode(text)) == text


def test_unigram_takes_the_cheapest_path():
    words = {"a": -1.0, "b": -1.5, "c": -3.0, "ab": -2.0, "bc": -2.2, "abc": -4.6, "▁": -1.0, "▁a": -1.8}
    own = Vocabulary(["<unk>", *words], [0.0, *words.values()], [2] + [1] * len(words), model=1, byte_fallback=False)
    machine = Transducer(own)

    def cheapest(text):
        if not text:
            return 0.0, ()
        found = []
        for k in range(1, len(text) + 1):
            if text[:k] in words:
                cost, rest = cheapest(text[k:])
                found.append((cost - words[text[:k]], (text[:k], *rest)))
        return min(found, default=(float("inf"), ()))

    for text in ["abc", "abcab", "cab", "bcbc", "aabbcc"]:
        ids = machine.shortest_path(" " + text)
        assert sum(-words[own.pieces[k]] for k in ids) == pytest.approx(cheapest("▁" + text)[0])
    assert machine.shortest_path("azb") == [own.pieces.index("a"), 0, own.pieces.index("b")]


def test_frames_round_trip(docs, rows):
    out = round_trip(docs, PIECES)
    assert [c for c in docs.columns if c != "text"] == out.columns[: len(docs.columns) - 1]
    want = sorted(("" if r[1] is None else hashlib.sha256(r[1].encode()).hexdigest()) for r in rows)
    got = out.collect()
    assert sorted(r["decoded_sha256"] or "" for r in got) == want
    assert all((r["pieces"] is None and r["n_pieces"] == 0) or len(r["pieces"]) == r["n_pieces"] for r in got)
    back = decode(encode(docs.select("doc_id", "text"), PIECES), PIECES)
    assert sorted(map(repr, back.select("doc_id", "text").collect())) == sorted(map(repr, docs.select("doc_id", "text").collect()))


def test_empty_table(nothing):
    assert round_trip(nothing, PIECES).collect() == []


def test_memory_of_a_worker_is_bounded(machine, monkeypatch):
    monkeypatch.setattr("seriesmill.llm.pieces.REMEMBERED", 3)
    monkeypatch.setattr("seriesmill.llm.pieces.REMEMBERED_PAIRS", 3)
    machine.known.clear()
    text = "many different words go through a small memory " * 3
    assert machine.decode(machine.encode(text)) == text and len(machine.known) <= 3
    assert np.array_equal(machine.encode(text), Transducer(read_vocabulary(PIECES)).encode(text))


def test_both_ways_run_in_one_worker(docs):
    """A second Python step would hold a second machine beside the first."""
    found = round_trip(docs, PIECES)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
