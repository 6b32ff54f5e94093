import hashlib
import math
import random
import re
from collections import defaultdict

import pyarrow as pa

from seriesmill.llm import exact_dedup
from seriesmill.llm.exact_dedup import digests, digit_bases, drop_exact_copies, exact_groups, merge_runs


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_groups_equal_brute_force(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r[1])].append(r[0])
    want = []
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        for nth, i in enumerate(known + [None] * (len(ids) - len(known))):
            want.append((i, known[0] if known else None, len(ids), nth == 0, hashlib.sha256(text.encode()).hexdigest()))
    for fan_in in (2, 8):
        got = [tuple(r) for r in exact_groups(docs, fan_in=fan_in).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_copies_go_and_columns_stay(docs, rows):
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [plain(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({plain(r[1]) for r in rows})
    assert set(map(tuple, kept.collect())) <= set(rows)


def test_empty_table(nothing):
    assert exact_groups(nothing).collect() == []
    assert drop_exact_copies(nothing).collect() == []


def test_rounds_deal_by_run_alone_and_sort_entries_once(docs, spark):
    """Rows are sorted once, by digest; later only blocks are put in order of their first digest."""
    rows = digests(docs)
    plan = merge_runs(rows, 30, 4)._jdf.queryExecution().optimizedPlan().toString()
    sorts = re.findall(r"Sort \[([^\]]*)\], false", plan)
    assert len(sorts) == 1 + len(digit_bases(30, 4)) == 4
    assert sorts[-1].startswith("__short") and all(s.startswith("run#") and "first#" in s for s in sorts[:-1])
    assert plan.count("RepartitionByExpression") == 3 and "Aggregate" not in plan


def test_digit_bases():
    for runs in range(1, 300):
        for fan_in in (2, 3, 8):
            bases = digit_bases(runs, fan_in)
            assert runs <= math.prod(bases) <= 2 * runs and max(bases) <= fan_in


def test_merge_equals_counting_and_verifies_short_digests(monkeypatch):
    """Runs merge to what counting gives, also where blocks are small and different texts share a short digest."""
    monkeypatch.setattr(exact_dedup, "_GATHER", 40)
    draw = random.Random(3)
    entries = [(draw.randrange(-20, 20), draw.randrange(3), bytes([draw.randrange(2)]) * 32, draw.choice([None, *range(50)]), k, 1) for k in range(3000)]
    blocks = []
    for run in range(6):
        own = sorted((e for e in entries if e[4] % 6 == run), key=lambda e: e[0])
        for at in range(0, len(own), 7):
            part = own[at : at + 7]
            columns = [pa.array(c, t) for c, t in zip(zip(*part), [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])]
            blocks.append((run // 3, part[0][0], pa.table(columns, exact_dedup._FIELDS)))
    blocks.sort(key=lambda b: b[:2])
    groups = defaultdict(list)
    for e in entries:
        groups[e[4] % 6 // 3, *e[:3]].append(((e[3] is None, e[3]), e[4]))
    want = [(*key, min(same)[0][1], min(same)[1], len(same)) for key, same in groups.items()]
    got, last = [], {}
    for run, part in exact_dedup.merged(iter(blocks)):
        for row in part.to_pylist():
            assert last.get(run, row["short"]) <= row["short"]
            last[run] = row["short"]
            got.append((run, *row.values()))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_hot_text_meets_as_one_entry_a_run(spark):
    """However many rows hold a text, a run sends it once: the blocks that travel hold one entry of it per partition."""
    hot = spark.range(0, 20_000, 1, 10).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text")
    got = {tuple(r) for r in exact_groups(hot).filter("group_size > 1").groupBy("keep_id", "group_size").count().collect()}
    assert got == {(0, 6667, 6667)}


def test_text_identifiers(spark):
    rows = [("b", "x  y"), ("a", "x y"), (None, "x\ty"), ("é", "z")]
    got = {tuple(r)[:4] for r in exact_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("b", "a", 3, False), ("a", "a", 3, True), (None, "a", 3, False), ("é", "é", 1, True)}
