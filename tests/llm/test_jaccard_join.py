import numpy as np
import pyarrow as pa
import pytest

from seriesmill.llm import jaccard_join as J
from seriesmill.llm.components import components
from tests.llm.conftest import WORD, lower


def shingle_sets(rows, size):
    out = {}
    for r in rows:
        words = WORD.findall(lower(r[1]))
        own = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
        out.setdefault(r[0], own)
    return out


def brute(sets, percent):
    parent = {i: i for i in sets if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(parent)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 60)])
def test_components_equal_brute_force(docs, rows, size, percent):
    sets = shingle_sets(rows, size)
    want = brute(sets, percent)
    got = J.similar_components(docs, size=size, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    # a row without identifier joins the component of an equal set
    nameless = sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None and r["component_id"] is not None)
    assert nameless == [(len(sets[3]), want[3])]


def test_links_inside_a_group_that_shares_no_list(spark):
    names = [f"w{k}" for k in range(60)]
    hashes = np.concatenate([h for _, h, _ in J._sets(pa.array(names), 1, True)])
    names = [names[k] for k in np.argsort(hashes)]
    # 40 words each, the first five in common: documents 1 and 2 share 38, document 0 shares 36 with either
    common = names[:36]
    sets = [common + names[36:40], common + names[40:44], common + names[40:42] + names[44:46]]
    rows = [(k, " ".join(words)) for k, words in enumerate(sets)]
    # texts of one word make every other word as frequent as the common ones, so that prefixes are equal
    for word in names:
        rows += [(1000 + len(rows) + k, word) for k in range(3 - sum(word in words for words in sets))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prefix = {r["id"]: r["prefix"] for r in J.prefixes(docs, "doc_id", "text", 1, True, 90).collect()}
    assert prefix[0] == prefix[1] == prefix[2]
    want = brute(shingle_sets(rows, 1), 90)
    assert (want[0], want[1], want[2]) == (0, 1, 1)
    got = {r["doc_id"]: r["component_id"] for r in J.similar_components(docs, size=1).collect()}
    assert got == want


def test_one_of_each_component_stays(docs, rows):
    want = brute(shingle_sets(rows, 5), 80)
    kept = J.drop_similar(docs, size=5, percent=80)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None} == {i for i, top in want.items() if i == top}
    assert sum(i is None for i in ids) == sum(r[0] is None for r in rows)


def test_empty_table(nothing):
    assert J.similar_components(nothing).collect() == []


def test_components_of_paths_stars_and_ties(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3), (3, None), (2, 1), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 150)} | {201: 200}
    assert got == want
