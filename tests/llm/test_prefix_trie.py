import hashlib
import math
import random
import re
import zlib

import pytest

from seriesmill.llm import prefix_trie

SHAPE = "conv_id long, turn long, role string, text string, pos string, words string, d1 string, seq string"


def count_words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text))


def rebuilt(rows, block=20, heads=4):
    """Turn lists of all conversations, as the contract words it."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = own.get(c - int(math.fmod(c, block)), [])[:h] + turns[h:]
    return out


def brute(convs):
    """All nodes by enumeration of prefixes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = set()
    for p, inside in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in inside if len(convs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * count_words(q[-1][1]) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(inside), len(p), min(members[p[:-1]]) if p else None, len(inside), len(children[p]), sum(not children[q] for q in below), saved, digest))
    return out


def run(spark, rows):
    frame = spark.createDataFrame([tuple(r) + ("x", None, "", "7") for r in rows], SHAPE).repartition(3)
    turns, members = prefix_trie.splice_heads(prefix_trie.ordered_turns(frame))
    found = [tuple(r) for r in prefix_trie.prefix_trie(turns, members).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_trie_equals_enumeration_of_prefixes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "DIGEST_RANGE", 4)
    monkeypatch.setattr(prefix_trie, "TURN_SLOT", 3)
    draw = random.Random(3)
    rows = []
    for c in [*range(0, 70), 200, 1000003]:
        for t in range(draw.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((c, t, draw.choice(["user", "bot"]), draw.choice(["a b", "a", "", "c  d e"])))
    # copies, a shared opening, equal and missing turn numbers, missing roles and texts, a repeated row, a row without conversation
    rows += [(c, t, "user", f"same {t}") for c in range(100, 120) for t in range(6)]
    rows += [(120, None, None, None), (120, 0, "user", "x"), (120, 0, "bot", "y"), (120, 0, "bot", "y"), (None, 0, "user", "z"), (121, 5, None, "x"), (-3, 1, "user", "negative")]
    assert run(spark, rows) == brute(rebuilt(rows))


def test_depth_far_above_a_power_of_two_and_very_long_texts(spark):
    rows = [(c, t, "user", "w " * 20_000 if t == 1 else f"t{t}") for c in range(0, 4) for t in range(33 + c)]
    assert run(spark, rows) == brute(rebuilt(rows))


def test_single_turns_turnless_and_no_conversations(spark):
    one = [(0, 0, "user", "a"), (20, 0, "user", "a")]
    assert run(spark, one) == brute(rebuilt(one))
    # conversation 1 has one turn, takes none from the absent conversation 0 and loses its own first
    conv = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    assert run(spark, [(conv, 0, "user", "a")]) == {(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())}
    assert run(spark, []) == set()


def long_and_short():
    """One conversation far longer than the others, copies of it that leave it at some turn, and short ones."""
    draw = random.Random(8)
    rows = [(c, t, "user", f"t{t % 7}" if t < leave else f"c{c} {t}") for c, leave in ((9, 150), (3, 150), (14, 64), (6, 33), (31, 16), (12, 4)) for t in range(140 + c % 3)]
    return rows + [(c, t, "user", draw.choice(["t0", "t1", "a b"])) for c in range(40, 90) for t in range(draw.randint(1, 6))]


@pytest.mark.parametrize("block", [1, 3, 512])
def test_blocks_of_any_height_give_the_same_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = long_and_short()
    assert run(spark, rows) == brute(rebuilt(rows))


def test_a_round_of_a_long_conversation_takes_few_jobs(spark):
    frame = spark.createDataFrame([tuple(r) + ("x", None, "", "7") for r in long_and_short()], SHAPE)
    turns, members = prefix_trie.splice_heads(prefix_trie.ordered_turns(frame))
    context = spark.sparkContext
    context.setJobGroup("trie of long conversations", "")
    try:
        prefix_trie.prefix_trie(turns, members)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # what the driver keeps of jobs and plans grows with them: eight binary digits, each of them a round down and a round up
    assert 0 < len(context.statusTracker().getJobIdsForGroup("trie of long conversations")) < 160
