import hashlib
import random

import numpy as np
import pytest

from seriesmill.llm import induced as I
from seriesmill.llm.substring_dedup import measure_repeats

LAST = 2**63 - 1


def order_and_prefixes(text, **how):
    data = np.frombuffer(bytes(x + 1 for x in text) + b"\0", np.uint8)
    place, prefix = [], []
    for a, b in I.sorted_suffixes(data, **how):
        place += a.tolist()
        prefix += b.tolist()
    return place, prefix


def shared(a, b):
    n = 0
    while n < min(len(a), len(b), I.MOST_PREFIX) and a[n] == b[n]:
        n += 1
    return n


def check(text, **how):
    want = sorted(range(len(text)), key=lambda k: text[k:], reverse=True)
    place, prefix = order_and_prefixes(text, **how)
    assert place == want
    assert prefix[1:] == [shared(text[a:], text[b:]) for a, b in zip(want, want[1:])]


def test_small_texts_over_small_alphabets():
    draw = random.Random(1)
    for _ in range(300):
        kinds = draw.choice([1, 2, 3, 5, 26])
        check(bytes(draw.randint(97, 96 + kinds) for _ in range(draw.randint(1, 60))))


@pytest.mark.parametrize("in_memory", [5, 50, 1 << 20])
@pytest.mark.parametrize("step", [1, 16, 1 << 12])
def test_repetitive_texts_with_queues_on_disk(monkeypatch, in_memory, step):
    monkeypatch.setattr(I, "_NAME_STEP", step)
    draw = random.Random(in_memory + step)
    words = [bytes(draw.randint(97, 99) for _ in range(draw.randint(1, 6))) for _ in range(6)]
    for _ in range(6):
        check(b" ".join(draw.choice(words) for _ in range(250)), in_memory=in_memory)
    check(b"a" * 400 + b"b" + b"ab" * 200 + b"aab" * 100, in_memory=in_memory)


def brute(rows):
    least = {}
    for i, text in rows:
        for k in range(len(text) - 49):
            key = text[k : k + 50]
            least[key] = min(least.get(key, LAST), LAST if i is None else i)
    out = []
    for i, text in rows:
        gone = bytearray(len(text))
        for k in range(len(text) - 49):
            if least[text[k : k + 50]] < (LAST if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        rest = bytes(c for c, g in zip(text, gone) if not g)
        out.append((i, len(text), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def test_removed_bytes_equal_brute_force(spark, docs, rows):
    draw = random.Random(3)
    long = "".join(draw.choice("abcdefgh ") for _ in range(400))
    extra = []
    for k in range(60):
        a, b = draw.randint(0, 200), draw.randint(0, 300)
        extra.append((10**6 + k, long[a : a + draw.randint(30, 200)] + draw.choice(["", "é" * 30, "a" * 70, "\n"]) + long[b:]))
    extra += [(None, long[:100]), (None, long[:100]), (-5, long[50:99]), (-6, long[50:100]), (10**6 + 3, long[:120]), (10**6 + 3, long[:120]), (10**6 + 99, "ab" * 200), (10**6 + 98, "ab" * 100)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = brute([(r[0], (r[1] or "").encode()) for r in rows] + [(i, t.encode()) for i, t in extra])
    assert sorted(map(tuple, measure_repeats(frame).collect()), key=repr) == sorted(want, key=repr)


def test_extra_columns_and_empty_table(docs, rows, nothing):
    assert measure_repeats(nothing).collect() == []
    want = brute([(r[0], (r[1] or "").encode()) for r in rows])
    assert sorted(map(tuple, measure_repeats(docs).collect()), key=repr) == sorted(want, key=repr)
