import hashlib
import re

import corpus_pipeline as C
import pytest

import __spark_entry__ as entry
from seriesmill.llm import queries
from seriesmill.session import read_table


def test_stages_follow_each_other(spark, folder):
    docs = read_table(spark, folder, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = []
    for name, stage in C.STAGES:
        docs = stage(spark, docs, folder).cache()
        seen.append((name, docs.count()))
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= ids
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
    assert [n for n, _ in seen] == ["language", "exact_copies", "near_copies", "source_mix", "token_pieces"]
    assert seen[1][1] < seen[0][1] and seen[2][1] <= seen[1][1]
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    whole = C.run(spark, folder)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, docs.collect()))


def test_stages_take_missing_values_clashing_names_and_empty_tables(spark, docs, rows, nothing):
    """The fixture holds NULLs in every column, empty and very long texts, ties, repeated rows and names that operators use."""
    texts = {}
    for r in rows:
        texts.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r[1] or ""), []).append(r[0])
    for name, stage in C.STAGES:
        found = stage(spark, docs, None)
        kept = found.collect()
        assert stage(spark, nothing, None).count() == 0
        if name != "token_pieces":
            assert found.columns == docs.columns and set(map(repr, kept)) <= set(map(repr, docs.collect()))
        if name == "language":
            # texts without a letter go, whatever their identifier
            assert all(re.search("[^\\W\\d_]", r["text"] or "") for r in kept) and len(kept) > 0.8 * len(rows)
        if name == "exact_copies":
            assert len(kept) == len(texts)
            for r in kept:
                ids = texts[re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "")]
                assert r["doc_id"] == min((i for i in ids if i is not None), default=None)
        if name == "near_copies":
            # rows without identifier stay, near copies (60 to 74) leave one
            assert sum(r["doc_id"] is None for r in kept) == sum(r[0] is None for r in rows)
            assert sum(60 <= (r["doc_id"] or 0) < 75 for r in kept) == 1
        if name == "source_mix":
            assert 0 < len(kept) <= 3 * len(rows)
        if name == "token_pieces":
            assert len(kept) == len(rows) and all((r["n_pieces"] == 0) == (r["decoded_sha256"] is None or r["decoded_sha256"] == hashlib.sha256(b"").hexdigest()) for r in kept)


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, folder, name):
    from check_queries import compare

    good, text = compare(spark, folder, name, queries.QUERIES[name], queries.SQL[name])
    assert good, text
