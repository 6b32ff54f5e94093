import itertools
from collections import defaultdict

import pytest

from seriesmill.llm.mixing import fit_budget, mix, source_targets, take_mix
from tests.llm.conftest import WORD


def reshared(sizes, weights, most):
    total, full = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in full)
        share = sum(w for k, w in enumerate(weights) if k not in full)
        target = [most * s if k in full else left * weights[k] / share for k, s in enumerate(sizes)]
        above = {k for k, s in enumerate(sizes) if k not in full and target[k] > most * s + 1e-9}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1000, 1], [5, 5, 5, 5000, 2], [0, 7], [1, 2, 4, 8, 16, 32, 900], [9]])
def test_targets_equal_repeated_sharing(spark, sizes):
    names = [None if k == len(sizes) - 1 else f"s{k}" for k in range(len(sizes))]
    rows = [(n, s) for n, s in zip(names, sizes)]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = reshared(sizes, [1 + k % 3 for k in range(len(sizes))], 3)
    assert [got[n] for n in names] == pytest.approx(want)


def test_budget_is_reached_where_any_choice_beside_the_even_share_reaches_it():
    for lengths, counts in [([3, 5, 7], [2, 3, 1]), ([4, 6], [3, 3]), ([2], [5]), ([1, 10, 100], [9, 9, 9])]:
        total = sum(n * c for n, c in zip(lengths, counts))
        for budget in range(0, total + 3):
            take = fit_budget(lengths, counts, budget)
            assert all(0 <= t <= c for t, c in zip(take, counts))
            spent = sum(n * t for n, t in zip(lengths, take))
            even = [c * max(0, budget - 4 * max(lengths)) // total for c in counts] if budget < total else [0] * len(counts)
            sums = {sum(n * t for n, t in zip(lengths, some)) for some in itertools.product(*[range(e, c + 1) for e, c in zip(even, counts)])}
            assert spent == max(s for s in sums if s <= budget)
            assert budget - spent <= max(lengths) or spent == total


def test_long_documents_and_many_lengths_reach_the_budget():
    assert fit_budget([150_000], [10], 210_000) == [1]
    assert fit_budget([150_000, 200_000, 205_000], [10, 1, 0], 210_000) == [0, 1, 0]
    # only one document fits, and the best comes after more than 512 others
    lengths = list(range(60_000, 61_000))
    take = fit_budget(lengths, [1] * len(lengths), 60_900)
    assert [n for n, t in zip(lengths, take) if t] == [60_900]


def test_mix_takes_its_targets(docs, rows):
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = sorted((r[0] is None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sizes
    assert sorted(map(tuple, mix(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    taken, target, longest, source = defaultdict(int), {}, defaultdict(int), {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        key = (r["source_size"], round(r["target"], 6))
        taken[key] += r["taken"]
        target[key] = r["target"]
        longest[key] = max(longest[key], r["size"])
    for key, value in taken.items():
        assert abs(value - target[key]) <= longest[key]
    assert source


def test_rows_follow_their_copies(docs):
    copies = {r["doc_id"]: r["copies"] for r in mix(docs.filter("doc_id < 100")).collect()}
    counts = defaultdict(int)
    out = take_mix(docs.filter("doc_id < 100"))
    assert out.columns == docs.columns
    for r in out.collect():
        counts[r["doc_id"]] += 1
    assert dict(counts) == {i: c for i, c in copies.items() if c}


def test_empty_table(nothing):
    assert mix(nothing).collect() == []
    assert take_mix(nothing).collect() == []
