"""Set similarity join of documents on word shingles: the grouped prefix join."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.components import components
from seriesmill.llm.marks import in_marks, mark_of, marked_ids
from seriesmill.llm.words import distinct_by_row, find_words, mix, shingles, small_batches, steps, utf8
from seriesmill.session import cut_lineage

#: Cells (a power of two) of the table that estimates in how many documents a shingle occurs.
CELL_BITS = 22
_CHUNK = 1 << 13
_SALT = np.uint64(0xA24BAED4963EE407)


def _sets(column: pa.Array, size: int, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, distinct shingle hashes and offsets of the rows, a bounded step at a time."""
    data, offsets = utf8(column)
    for a, b in steps(offsets):
        words = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        hashes, rows = shingles(words, size)
        yield (a, *distinct_by_row(hashes, rows, b - a))


def document_frequencies(docs: DataFrame, text_col: str, size: int, lower: bool) -> np.ndarray:
    """For each cell of a hashed table, the number of (document, shingle) pairs that fall into it.

    Every task counts its documents in a table of fixed size; the tables are added
    up in chunks of cells on many tasks, and only the sum (fixed size) is collected.
    """
    shift = np.uint64(64 - CELL_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for _, hashes, _ in _sets(batch.column(0), size, lower):
                table += np.bincount((hashes >> shift).astype(np.int64), minlength=len(table)).astype(np.uint32)
        for k, part in enumerate(table.reshape(-1, _CHUNK)):
            if part.any():
                yield pa.record_batch({"chunk": pa.array([k], pa.int32()), "cells": pa.array([zlib.compress(part.astype(np.uint64).tobytes(), 1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(cells.as_py()), np.uint64)
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            yield pa.record_batch({"chunk": pa.array([k], pa.int32()), "cells": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    shape = "chunk int, cells binary"
    parts = small_batches(docs).select(text_col).mapInArrow(count, shape)
    total = np.zeros((1 << CELL_BITS) // _CHUNK * _CHUNK, np.uint64).reshape(-1, _CHUNK)
    for row in parts.repartition("chunk").mapInArrow(add, shape).toLocalIterator():
        total[row["chunk"]] += np.frombuffer(zlib.decompress(bytes(row["cells"])), np.uint64)
    return np.minimum(total.reshape(-1), 2**32 - 1).astype(np.uint32)


def prefixes(docs: DataFrame, id_col: str, text_col: str, size: int, lower: bool, percent: int) -> DataFrame:
    """Size, two set digests, prefix and two prefix digests of every document's set.

    The prefix holds the first ``n - ceil(percent * n / 100) + 1`` shingles in one
    order of all shingles: rare ones (by the hashed table) first, then by hash.
    Any fixed order gives the whole join; a good table only makes it cheaper.
    """
    docs = small_batches(docs)
    table = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs, text_col, size, lower))
    shift = np.uint64(64 - CELL_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = table.value
        for batch in batches:
            for first, hashes, bounds in _sets(batch.column(1), size, lower):
                count = np.diff(bounds)
                filled = np.flatnonzero(count)
                digests = np.zeros((2, len(count)), np.uint64)
                if len(filled):
                    digests[0, filled] = np.add.reduceat(mix(hashes), bounds[:-1][filled])
                    digests[1, filled] = np.add.reduceat(mix(hashes ^ _SALT), bounds[:-1][filled])
                rank = frequency[(hashes >> shift).astype(np.int64)]
                chosen, ends, marks = [], [0], np.zeros((2, len(count)), np.uint64)
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    n = b - a
                    if n:
                        keep = n - -(-percent * n // 100) + 1
                        picked = hashes[a:b][np.argsort(rank[a:b], kind="stable")[:keep]]
                        chosen.append(picked)
                        marks[0, k] = np.sum(mix(picked))
                        marks[1, k] = np.sum(mix(picked ^ _SALT))
                        ends.append(ends[-1] + keep)
                    else:
                        ends.append(ends[-1])
                flat = np.concatenate(chosen) if chosen else np.empty(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.record_batch(
                    {
                        "id": batch.column(0).slice(first, len(count)),
                        "n": pa.array(count.astype(np.int64)),
                        "s1": pa.array(digests[0].view(np.int64)),
                        "s2": pa.array(digests[1].view(np.int64)),
                        "p1": pa.array(marks[0].view(np.int64)),
                        "p2": pa.array(marks[1].view(np.int64)),
                        "prefix": lists,
                    }
                )

    shape = "id long, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, shape)


def _near(percent: int) -> str:
    """Size and position filter of two sets that share a prefix shingle.

    The first shingle that a linked pair has in common lies so early that the rest
    of either set, from it on, is as large as the overlap must be.
    """
    rest = "least(a.n - a.pos, b.n - b.pos)"
    return f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) AND {100 + percent} * {rest} >= {percent} * (a.n + b.n)"


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, lower: bool, percent: int) -> DataFrame:
    """Those pairs (a, b) of identifiers whose whole shingle sets reach the similarity.

    Sets are made again from the texts of the documents in question only: a bitmap
    of fixed size names them (a few others slip in and join with nothing).
    """
    marks = docs.sparkSession.sparkContext.broadcast(marked_ids(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            batch = batch.filter(pa.array(in_marks(bits, batch.column(2))))
            for first, hashes, bounds in _sets(batch.column(1), size, lower):
                raw = hashes.tobytes()
                yield pa.record_batch(
                    {
                        "id": batch.column(0).slice(first, len(bounds) - 1),
                        "hashes": pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()),
                    }
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).filter("id IS NOT NULL")
    source = source.withColumn("bit", mark_of("id"))
    sets = cut_lineage(source.mapInArrow(build, "id long, hashes binary"))
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("left")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    return both.mapInArrow(compare, "a long, b long")


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, lower: bool = True
) -> DataFrame:
    """Number of distinct shingles of every document and the smallest identifier reachable over links.

    Two documents link when ``100 * intersection >= percent * union`` of their sets
    of ``size``-word shingles.  Returns ``id_col``, ``n_shingles`` and
    ``component_id``.  NULL and empty texts have no shingle and stand alone; a text
    shorter than ``size`` words is one shingle.  Rows that repeat an identifier
    count as one document with the set of one of them and stay as rows.  A row
    with a NULL identifier joins the component of an equal set, else NULL.

    Documents with equal sets are one class.  Classes of equal size and prefix are
    one group, and groups meet on shared prefix shingles.  First every group is
    held against the member of the shingle's list that has it earliest; the links
    found contract even thousands of near copies.  Then only members of different
    components of a list or of a group meet, all of them, so no link between
    components is lost, nor inside a group that shares no list.
    Runs several jobs.
    """
    args = (id_col, text_col, size, lower, percent)
    every = cut_lineage(prefixes(docs, *args))
    classes = every.filter("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2", "p1", "p2").agg(F.min("id").alias("rep"), F.first("prefix").alias("prefix"))
    classes = cut_lineage(classes)
    groups = classes.groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid"), F.first("prefix").alias("prefix"))
    members = classes.join(groups.select("n", "p1", "p2", "gid"), ["n", "p1", "p2"]).select("rep", "gid", "n")
    posted = groups.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "s")).repartition("s")
    lists = posted.groupBy("s").agg(F.count("*").alias("cnt"), F.min(F.struct("pos", "n", "gid")).alias("c")).filter("cnt > 1")
    shared = cut_lineage(posted.join(lists, "s").select("s", "gid", "n", "pos", F.col("c.gid").alias("cg"), F.col("c.n").alias("cn"), F.col("c.pos").alias("cp")))
    first = shared.select(F.struct("gid", "n", "pos").alias("a"), F.struct(F.col("cg").alias("gid"), F.col("cn").alias("n"), F.col("cp").alias("pos")).alias("b"))
    star = first.filter("a.gid <> b.gid").filter(_near(percent)).select(F.col("a.gid").alias("a"), F.col("b.gid").alias("b"))
    # two different sets of n shingles share n - 1 at most
    members = members.withColumn("apart", F.expr(f"{100 - percent} * n >= {100 + percent}"))
    inner = members.filter("apart AND rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    star = cut_lineage(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(inner).distinct())
    links = cut_lineage(verified(star, docs, *args))
    found = components(links)

    # what the first comparison left apart: members of one group, or of two groups of one list, in different components
    named = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "gid", "apart", F.coalesce("component", "rep").alias("comp"))
    inside = named.filter("apart").select("rep", "gid", "comp")
    mixed = inside.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("gid")
    inside = cut_lineage(inside.join(mixed, "gid"))
    a, b = inside.alias("a"), inside.alias("b")
    same = a.join(b, F.expr("a.gid = b.gid AND a.comp < b.comp")).select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b"))
    listed = shared.select("s", "gid", "n", "pos").join(named.drop("apart"), "gid")
    mixed = listed.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("s")
    listed = cut_lineage(listed.join(mixed, "s"))
    a, b = listed.alias("a"), listed.alias("b")
    rest = a.join(b, F.expr(f"a.s = b.s AND a.gid <> b.gid AND a.comp < b.comp AND {_near(percent)}"))
    rest = rest.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).union(same).distinct()
    rest = cut_lineage(rest.join(star, ["a", "b"], "left_anti"))
    links = links.union(verified(rest, docs, *args))
    found = components(links)

    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    placed = every.drop("prefix", "p1", "p2").join(of_class, ["n", "s1", "s2"], "left")
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest identifier; columns and texts as they were.

    Edge cases as in :func:`similar_components`; rows with a NULL identifier stay,
    and rows that repeat a staying identifier stay with it.
    """
    gone = similar_components(docs, id_col, text_col, size, percent).filter(f"{id_col} <> component_id").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
