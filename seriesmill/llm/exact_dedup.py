"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.words import SPACE_PATTERN
from seriesmill.session import cut_lineage

#: Runs that exchange entries in one round.
FAN_IN = 8
#: Entries of one block of a run, and those that a merge gathers before it looks which are complete.
_BLOCK, _GATHER = 4096, 1 << 16

_ENTRY = ["__short", "__bytes", "__sha"]
_FIELDS = ["short", "bytes", "sha", "id", "row", "n"]


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_PATTERN, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier, row tag and digests of every row; one pass over the texts."""
    plain = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("__id"),
        F.monotonically_increasing_id().alias("__row"),
        F.xxhash64(plain).alias("__short"),
        F.octet_length(plain).cast("long").alias("__bytes"),
        F.unhex(F.sha2(plain, 256)).alias("__sha"),
    )


def digit_bases(runs: int, fan_in: int = FAN_IN) -> list[int]:
    """Bases, one a round and none above ``fan_in``, whose product is ``runs`` or little more."""
    bases = []
    while runs > 1 or not bases:
        bases.append(max(1, min(fan_in, runs)))
        runs = -(-runs // bases[-1])
    return bases


def _fold(entries: pa.Table) -> pa.Table:
    """Entries by their short digest, one for each text: its smallest identifier (NULL last) and its rows.

    The stable sort finds the sorted runs that make up the entries and merges them.
    Entries are one text where short digest, length and SHA-256 all agree.
    """
    short = entries["short"].to_numpy()
    order = np.argsort(short, kind="stable")
    equal = short[order][1:] == short[order][:-1]
    shared = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    if not shared.any():
        return entries.take(order)
    twins = entries.take(order[shared]).sort_by([(name, "ascending") for name in _FIELDS[:-1]]).combine_chunks()
    new = np.ones(len(twins), bool)
    new[1:] = False
    for name in ("short", "bytes", "sha"):
        column = twins[name].combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(twins["n"].to_numpy(), starts)
    folded = twins.take(starts).set_column(len(_FIELDS) - 1, "n", pa.array(sums))
    whole = pa.concat_tables([entries.take(order[~shared]), folded])
    return whole.take(np.argsort(whole["short"].to_numpy(), kind="stable"))


def merged(blocks: Iterator[tuple[int, int, pa.Table]]) -> Iterator[tuple[int, pa.Table]]:
    """Multiway merge: runs with their entries in order and folded, a part at a time.

    Blocks (run, first short digest, entries) come by run and first digest, each in
    order within.  What lies below the first digest of the next block is complete,
    so only the open block of every incoming run is held.
    """
    held: list[pa.Table] = []
    size, enough, run = 0, _GATHER, None
    for own, first, entries in blocks:
        if own != run and held:
            yield run, _fold(pa.concat_tables(held))
            held, size, enough = [], 0, _GATHER
        run = own
        if size >= enough:
            ordered = _fold(pa.concat_tables(held))
            done = int(np.searchsorted(ordered["short"].to_numpy(), first))
            if done:
                yield run, ordered.slice(0, done)
            held = [ordered.slice(done)]
            size = len(ordered) - done
            enough = max(_GATHER, 2 * size)
        held.append(entries)
        size += len(entries)
    if held:
        yield run, _fold(pa.concat_tables(held))


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), pa.table([batch.column(2 + f)[k].values for f in range(len(_FIELDS))], _FIELDS)


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """The rows of a sorted partition as blocks of its run."""
    for batch in batches:
        if batch.num_rows:
            columns = [*batch.columns[1:], pa.array(np.ones(batch.num_rows, np.int64))]
            yield batch.column(0)[0].as_py(), columns[0][0].as_py(), pa.table(columns, _FIELDS)


def _deal(parts: Iterator[tuple[int, pa.Table]], base: int, weight: int) -> Iterator[pa.RecordBatch]:
    """Blocks for the runs that differ from their own in one digit, which becomes that of the short digest."""
    for run, entries in parts:
        entries = entries.combine_chunks()
        digit = entries["short"].to_numpy().view(np.uint64) // np.uint64(weight) % np.uint64(base)
        for d in range(base):
            chosen = np.flatnonzero(digit == d)
            if not len(chosen):
                continue
            to = run + (d - run // weight % base) * weight
            sent = entries.take(chosen).combine_chunks()
            bounds = np.append(np.arange(0, len(sent), _BLOCK), len(sent)).astype(np.int32)
            columns = [sent[name].combine_chunks() for name in _FIELDS]
            firsts = columns[0].to_numpy()[bounds[:-1]]
            lists = [pa.ListArray.from_arrays(pa.array(bounds), column) for column in columns]
            yield pa.record_batch([pa.array(np.full(len(firsts), to, np.int64)), pa.array(firsts), *lists], ["run", "first", *_FIELDS])


def merge_runs(rows: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """One entry per text that several rows hold: smallest identifier (NULL last), its row tag, number of rows.

    A run is what one partition holds, sorted by short digest: Spark sorts the
    partitions of ``rows`` once, and nothing later.  Runs are numbered, the number
    has one digit a round (:func:`digit_bases`).  In a round the runs whose numbers
    differ in that digit only exchange blocks of entries, each entry going to the
    run whose digit is that of its short digest.  Blocks travel by run number
    alone; where they arrive they are ordered by their first digest and merged,
    which keeps one entry a text.  So no run takes more than ``fan_in`` entries of
    one text, however many rows hold it (in the first round as often as there are
    more partitions than runs), a merge holds one open block of every run that
    sends, and after the last round a text stands in one run.  Identifiers are of
    any type that Arrow sorts.
    """
    bases = digit_bases(runs, fan_in)
    count = int(np.prod(bases))
    kind = rows.schema["__id"].dataType.simpleString()
    blocks = f"run long, first long, short array<long>, bytes array<long>, sha array<binary>, id array<{kind}>, row array<long>, n array<long>"

    def first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _deal(merged(_read_rows(batches)), bases[0], 1)

    def exchange(base: int, weight: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _deal(merged(_read_blocks(batches)), base, weight)

        return run

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, entries in merged(_read_blocks(batches)):
            yield from entries.filter(pc.greater(entries["n"], 1)).combine_chunks().to_batches()

    numbered = rows.select(F.pmod(F.spark_partition_id(), F.lit(count)).cast("long").alias("run"), *_ENTRY, "__id", "__row")
    level = numbered.sortWithinPartitions("__short").mapInArrow(first_runs, blocks)
    weight = 1
    for base, after in zip(bases, [*bases[1:], None]):
        weight *= base
        arrived = level.repartitionById(count, F.col("run").cast("int")).sortWithinPartitions("run", "first")
        if after:
            level = arrived.mapInArrow(exchange(after, weight), blocks)
        else:
            level = arrived.mapInArrow(last, f"__short long, __bytes long, __sha binary, __keep_id {kind}, __keep_row long, __n long")
    return level


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """For every row the smallest identifier with an equal text, the group's size and whether the row stays.

    Returns ``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.
    Texts are equal when they agree after each run of white space became one space.
    NULL and empty texts are equal.  A NULL identifier stays only where all of its
    group are NULL.  Of rows that repeat identifier and text one stays, the first
    in reading order.  Extra columns are ignored.  An empty table gives none.
    Runs one job (digests are written to the checkpoint folder).
    """
    rows = cut_lineage(digests(docs, id_col, text_col))
    runs = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # unique texts need no partner; the join splits a hot text's rows (adaptive skew join, left side)
    found = rows.join(merge_runs(rows, runs, fan_in), _ENTRY, "left")
    alone = F.col("__n").isNull()
    return found.select(
        F.col("__id").alias(id_col),
        F.when(alone, F.col("__id")).otherwise(F.col("__keep_id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__row") == F.col("__keep_row"))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per text, the one with the smallest identifier; columns and texts as they were.

    Edge cases as in :func:`exact_groups`.
    """
    from pyspark.sql import Window

    staying = exact_groups(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    tagged = docs.withColumn("__sha", F.sha2(normalised(F.col(text_col)), 256))
    joined = tagged.join(staying, (F.col("__sha") == F.col("__keep_sha")) & F.col(id_col).eqNullSafe(F.col("__keep_id")))
    first = F.row_number().over(Window.partitionBy("__sha", id_col).orderBy(text_col))
    return joined.withColumn("__nth", first).filter("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
