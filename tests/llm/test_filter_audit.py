import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import filter_audit

LABELS = "doc_id long, quality long, toxic long, source string, id long, hash long"


def fails(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    out = set()
    out |= {"A"} if len(words) < 50 else set()
    out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
    return out | ({"D"} if re.search("[#$%&*|]", text) else set())


def brute(rows, labels):
    """The audit by removing documents filter by filter, in all orders."""
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in range(2))
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    docs = [(r[0], r[3] or "", fails(r[1] or "") | ({"E"} if r[0] is not None and first[r[1] or ""] < r[0] else set())) for r in rows]
    out = []
    for part in {d[1] for d in docs}:
        inside = [d for d in docs if d[1] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = inside
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[2]]
                left = [d for d in left if letter not in d[2]]
                removed_by[letter] += len(gone)
                redundant = sum(letter in d[2] for d in inside) - len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), redundant, sum(d[2] == {letter} for d in inside), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), letter))
        out += [s[:9] + (removed_by[s[9]],) for s in steps]
    return sorted(out)


def test_audit_equals_removing_documents(spark, docs, rows):
    labels = [(k, k % 2, int(k % 5 == 0), "x", None, 7) for k in range(0, 105, 2)] + [(4, None, 1, None, None, None), (None, 1, 1, None, None, None), (999, 1, 1, None, None, None)]
    found = filter_audit.audit(filter_audit.mask_counts(docs, spark.createDataFrame(labels, LABELS)))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, [x[:3] for x in labels])


def test_empty_tables(spark, docs, rows, nothing):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(filter_audit.mask_counts(nothing, labels)).count() == 0
    assert sorted(tuple(r) for r in filter_audit.audit(filter_audit.mask_counts(docs, labels)).collect()) == brute(rows, [])


@pytest.mark.parametrize("most_bits", [28, 14])
def test_the_prepass_keeps_all_repeats_and_clears_most_others(spark, most_bits):
    # 3,000 hashes, every tenth twice or more; 14 bits force two slices
    frame = spark.range(3000).select(F.xxhash64("id").alias("hash"), "id")
    frame = frame.unionByName(frame.filter("id % 10 = 0")).unionByName(frame.filter("id = 20")).unionByName(frame.filter("id = 20")).repartition(5)
    held = [r["id"] for r in filter_audit.possible_repeats(frame, "hash", most_bits).collect()]
    true = [k for k in range(0, 3000, 10) for _ in range(4 if k == 20 else 2)]
    assert not set(true) - set(held) and all(held.count(k) == true.count(k) for k in (0, 10, 20))
    assert len(held) - len(true) < 0.06 * 3000


def test_sketches_of_tasks_add_up(spark):
    # one row of a hash in each of two tasks counts twice, one alone does not
    one = spark.createDataFrame([(5,), (9,)], "hash long").coalesce(1)
    both = one.unionByName(spark.createDataFrame([(5,)], "hash long"))
    packed = filter_audit.repeat_map(both, 16)
    slots = filter_audit._slots(np.array([5, 9], np.uint64), 16)
    twice = (packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
    assert twice[:, 0].all() and not twice[:, 1].any()
    assert not filter_audit.repeat_map(one, 16).any()


def test_counts_without_any_row_of_a_mask_are_left_out(spark):
    rows = [(1, "x", "s"), (2, "x", "s"), (3, None, None), (4, "", None)]
    found = filter_audit.mask_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([], LABELS))
    assert sorted((r["part"], r["mask"], r["n"]) for r in found.collect()) == [("", 1, 1), ("", 17, 1), ("s", 1, 1), ("s", 17, 1)]
