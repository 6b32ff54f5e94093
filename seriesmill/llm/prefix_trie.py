"""The trie of conversation prefixes, cut at half depth again and again as van Emde Boas laid out trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.words import small_batches, word_array
from seriesmill.operators.ordered import row_index
from seriesmill.session import cut_lineage

#: Width of the ranges of identifiers that are joined to one piece of a digest's text: at most as many identifiers.
DIGEST_RANGE = 4096
#: Turn numbers that one task sorts of one conversation.
TURN_SLOT = 4096
#: Levels of a trie that is no longer cut: a task orders as many turns of a sequence at once.
BLOCK = 4

_NODE = ["conv_id", "depth"]
_PREFIX = ["tree", "base", "pos", "z1", "z2"]
_SUMS = ["n_leaves", "saved_tokens"]


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``pos`` (from 1), two halves of a turn's name and ``words``, in order of the turns.

    NULL turns come first, NULL roles and texts count as empty, turns with an equal
    number follow each other by their digest, repeated rows are turns of their own
    and rows without conversation are left out.  Equal (role, text) have equal names:
    128 bits of a SHA-256.  Texts are digested before anything is shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.sha2(F.concat_ws(":", F.char_length(role), role, text), 256).alias("sha"),
        F.size(word_array(text)).cast("long").alias("words"),
    )
    half = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")
    # a long conversation is sorted slot by slot
    slot = F.coalesce(F.floor(F.col("turn") / TURN_SLOT), F.lit(-(1 << 62))).cast("long")
    placed = row_index(named, [F.col("turn").asc_nulls_first(), F.col("sha")], [slot], ["conv_id"], "pos")
    return placed.select("conv_id", (F.col("pos") + 1).alias("pos"), half(1).alias("d1"), half(17).alias("d2"), "words")


def splice_heads(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and all conversations with their numbers of turns.

    Conversation c takes the first h turns of c - c % ``block`` and then its own
    after its first h; h is the crc32 of c's decimal digits modulo ``heads``, and the remainder
    has the sign of c.
    A head goes to ``block`` conversations at most.
    """
    own = cut_lineage(turns)
    head_length = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    lengths = own.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns({"h": head_length, "donor": F.col("conv_id") - F.col("conv_id") % block})
    given = lengths.filter(f"conv_id % {block} = 0").select(F.col("conv_id").alias("donor"), F.col("own").alias("there"))
    lengths = lengths.join(given, "donor", "left").select("conv_id", "donor", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), "own")
    lengths = cut_lineage(lengths)
    first = own.filter(f"pos < {heads} AND conv_id % {block} = 0").withColumnRenamed("conv_id", "donor")
    spliced = lengths.filter("taken > 0").select("conv_id", "donor", "taken").join(first, "donor").filter("pos <= taken").select("conv_id", "pos", "d1", "d2", "words")
    rest = own.filter(F.col("pos") > head_length).join(lengths.select("conv_id", "h", "taken"), "conv_id")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "d1", "d2", "words")
    members = lengths.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("turns"))
    return spliced.unionByName(rest).withColumn("pos", F.col("pos").cast("long")), members


def _name(*columns: str) -> list[Column]:
    """Two 64-bit names of a set of positions, put together by exclusive or in any order; NULL leaves a row out."""
    return [F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *reversed(columns))]


def _cut(part: DataFrame, half: int) -> DataFrame:
    """Tries of at most twice ``half`` levels as tries of ``half`` levels: the upper ones, and one below every prefix of ``half`` turns.

    ``part`` has a row for every position of the distinct sequences (``seq``,
    ``weight`` conversations, ``size`` turns, at least ``half``) of every trie (``tree``,
    ``base``: smallest conversation and depth of its root).  A prefix is named by its smallest
    sequence, which alone stands for it in the upper trie, with the prefix's summed
    weight.  Shorter sequences stay in the upper trie as they are; the caller holds them back.
    """
    inside, end = F.col("pos") <= half, F.col("pos") == half
    z1, z2 = _name("pos", "d1", "d2")
    key = ["tree", "base", "z1", "z2"]
    prefix = part.groupBy("tree", "base", "seq", "weight").agg(
        F.bit_xor(F.when(inside, z1)).alias("z1"),
        F.bit_xor(F.when(inside, z2)).alias("z2"),
        F.max(F.when(end, F.col("ender"))).alias("last"),
        F.max(F.when(end, F.col("more"))).alias("on"),
    )
    named = prefix.groupBy(*key).agg(F.min("seq").alias("top"), F.sum("weight").alias("sum"), F.max("last").alias("ender_here"), F.max("on").alias("more_here"))
    # a prefix of many sequences is a hot key: its rows are narrow, and adaptive execution splits them
    of = prefix.select(*key, "seq").join(named, key).select("base", "seq", "top", "sum", "ender_here", "more_here")
    rows = part.join(of, ["base", "seq"]).filter(~inside | (F.col("seq") == F.col("top")))
    pick = lambda upper, lower: F.when(inside, upper).otherwise(lower)
    return rows.select(
        pick(F.col("tree"), F.col("top")).alias("tree"),
        pick(F.col("base"), F.col("base") + half).alias("base"),
        "seq",
        pick(F.col("sum"), F.col("weight")).alias("weight"),
        pick(F.lit(half).cast("long"), F.col("size") - half).alias("size"),
        pick(F.col("pos"), F.col("pos") - half).alias("pos"),
        "d1",
        "d2",
        "words",
        F.when(end, F.col("ender_here")).otherwise(F.col("ender")).alias("ender"),
        F.when(end, F.col("more_here")).otherwise(F.col("more")).alias("more"),
    )


def _named(part: DataFrame) -> DataFrame:
    """Rows of tries of ``BLOCK`` levels with the names of the prefix that ends there (``z1``, ``z2``) and of the one before (``p1``, ``p2``)."""
    so_far = Window.partitionBy("base", "seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = dict(zip(["h1", "h2"], _name("pos", "d1", "d2")))
    named = part.withColumns(own).withColumns({z: F.bit_xor(h).over(so_far) for z, h in (("z1", "h1"), ("z2", "h2"))})
    # a first turn has none before it; its own name there keeps the first turns of a trie apart
    before = [F.when(F.col("pos") > 1, F.col(z).bitwiseXOR(F.col(h))).otherwise(F.col(z)).alias(p) for z, h, p in (("z1", "h1", "p1"), ("z2", "h2", "p2"))]
    return named.select(*_PREFIX, "seq", "weight", "words", "ender", "more", *before)


def _nodes(named: DataFrame) -> DataFrame:
    """The nodes of tries of ``BLOCK`` levels, with their places in the trie, ``leaf`` and ``saved``."""
    nodes = named.groupBy(*_PREFIX).agg(*[F.min(c).alias(c) for c in ("p1", "p2", "words")], F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("ender").alias("ender"), F.max("more").alias("more"))
    up = nodes.select("tree", "base", (F.col("pos") + 1).alias("pos"), F.col("z1").alias("p1"), F.col("z2").alias("p2"), F.col("conv_id").alias("above"))
    nodes = nodes.join(up, ["tree", "base", "pos", "p1", "p2"], "left")
    return nodes.select(
        *_PREFIX,
        "conv_id",
        (F.col("base") + F.col("pos")).alias("depth"),
        F.when(F.col("pos") == 1, F.col("tree")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs",
        "ender",
        (~F.col("more")).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )


def _block_totals(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """Totals of every node over its subtree within its trie of ``BLOCK`` levels.

    A node lies on the path of its smallest sequence, so that a subtree's nodes are
    those which its members have, each on one member's path, from its top down: sums
    from the end of every path, added up over the members of a prefix.
    """
    paths = named.select("base", "seq", "pos", "tree", "z1", "z2", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    values = nodes.select("base", F.col("conv_id").alias("seq"), "pos", *[F.lit(None).cast("long").alias(c) for c in ("tree", "z1", "z2")], "leaf", "saved")
    from_end = Window.partitionBy("base", "seq").orderBy(F.col("pos").desc()).rangeBetween(Window.unboundedPreceding, 0)
    sums = paths.unionByName(values).withColumns({c: F.sum(c).over(from_end) for c in ("leaf", "saved")}).filter(F.col("tree").isNotNull())
    totals = sums.groupBy(*_PREFIX).agg(F.min("seq").alias("conv_id"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return totals.select("conv_id", (F.col("base") + F.col("pos")).alias("depth"), F.when(F.col("pos") == 1, F.col("tree")).alias("parent_conv_id"), *_SUMS)


def _above(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """The last nodes (``u``, ``at``) of the tries of ``BLOCK`` levels that have a trie below, with their ancestors in the trie, themselves included."""
    last = nodes.filter((F.col("pos") == BLOCK) & (F.col("leaf") == 0)).select("base", F.col("conv_id").alias("seq"))
    paths = named.select(*_PREFIX, "seq").join(last, ["base", "seq"])
    found = paths.join(nodes.select(*_PREFIX, "conv_id", "depth"), _PREFIX)
    return found.select(F.col("seq").alias("u"), (F.col("base") + BLOCK).alias("at"), "conv_id", "depth", F.when(F.col("pos") == 1, F.col("tree")).alias("parent_conv_id"))


def _graft(totals: DataFrame, above: DataFrame, rounds: int) -> DataFrame:
    """Totals over every node's subtree, as rows to be added up: ``conv_id``, ``depth``, ``n_leaves``, ``saved_tokens``.

    ``totals`` are those within blocks of ``BLOCK`` levels, and blocks of 1, 2, 4, ... times
    that height grow together.  Where an upper block ends, at an odd multiple of its
    height, the totals of the lower trie below each of its last nodes are added to
    that node and its ancestors within the block.  ``above`` holds those ancestors: one
    row for each level of the block, at most as many as the distinct sequences have
    turns.  Only first nodes of a block name their parent.
    """
    for k in range(rounds):
        height = BLOCK << k
        roots = totals.filter((F.col("depth") - 1) % (2 * height) == height).groupBy(F.col("parent_conv_id").alias("u"), (F.col("depth") - 1).alias("at")).agg(*_sums())
        odd = above.filter(F.col("at") % (2 * height) == height)
        grafted = odd.join(roots, ["u", "at"]).groupBy("conv_id", "depth", "parent_conv_id").agg(*_sums())
        if k + 1 == rounds:
            totals = totals.unionByName(cut_lineage(grafted))
            break
        wide = above.filter(F.col("at") % (2 * height) == 0)
        jump = wide.filter(F.col("depth") == F.col("at") - height + 1).select("u", "at", F.col("parent_conv_id").alias("j"))
        upper = odd.select(F.col("u").alias("j"), (F.col("at") + height).alias("at"), "conv_id", "depth", "parent_conv_id")
        wider = wide.unionByName(jump.join(upper, ["j", "at"]).select("u", "at", "conv_id", "depth", "parent_conv_id"))
        # both results of a round are written by one query
        both = cut_lineage(grafted.unionByName(wider, allowMissingColumns=True))
        totals = totals.unionByName(both.filter("u IS NULL").drop("u", "at"))
        above = both.filter("u IS NOT NULL").drop(*_SUMS)
    return totals.drop("parent_conv_id")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in _SUMS]


def joined_digests(members: DataFrame, group_col: str, id_col: str) -> DataFrame:
    """``group_col`` and the SHA-256 of its identifiers in decimal, ascending, joined by commas.

    A group's identifiers are sorted and joined range by range, at most
    ``DIGEST_RANGE`` of them at once; the task that has a group's ranges reads them
    in order and keeps the state of one digest only.
    """
    ranges = members.groupBy(F.col(group_col).alias("group"), F.floor(F.col(id_col) / DIGEST_RANGE).alias("nth"))
    texts = ranges.agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(id_col)), lambda x: x.cast("string"))).alias("ids"))
    texts = small_batches(texts).repartition("group").sortWithinPartitions("group", "nth")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for group, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is not None and group == now:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = group, hashlib.sha256()
                state.update(text.encode())
            yield pa.record_batch({"group": pa.array([d[0] for d in done], pa.int64()), "sha": pa.array([d[1] for d in done], pa.string())})
        if state is not None:
            yield pa.record_batch({"group": pa.array([now], pa.int64()), "sha": pa.array([state.hexdigest()], pa.string())})

    return texts.mapInArrow(digest, "group long, sha string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, with totals over its subtree.

    ``turns``: ``conv_id``, ``pos`` from 1 without holes, the turn's name ``d1``,
    ``d2`` and ``words``.  ``members``: every conversation and its number of turns,
    also 0.  Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``
    (NULL at the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    and ``ends_sha256``.

    Equal conversations become one sequence with a weight.  All tries of a round are
    cut at half of their height at once (:func:`_cut`) until they have ``BLOCK`` levels,
    where the sequences' own order names the nodes (:func:`_nodes`); :func:`_graft` then
    adds the totals of the lower tries to the upper ones on the way back.  Both take a
    round less for every binary digit of ``BLOCK`` than the longest conversation's length
    has, and a round is one query over the sequences that reach the cut.  Sequences are
    compared by 128-bit names.  No conversations, no rows.  Runs jobs.
    """
    turns = cut_lineage(turns)
    z1, z2 = _name("pos", "d1", "d2")
    whole = turns.groupBy("conv_id").agg(F.bit_xor(z1).alias("z1"), F.bit_xor(z2).alias("z2"))
    whole = cut_lineage(members.join(whole, "conv_id", "left").fillna(0, ["z1", "z2"]))
    equal = whole.groupBy("turns", "z1", "z2").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("weight"))
    top = whole.agg(F.min("conv_id").alias("least"), F.max("turns").alias("most"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("turns") == 0, F.col("conv_id"))).alias("turnless")).first()
    if top["least"] is None:
        return _shaped(equal.limit(0).select(F.col("seq").alias("conv_id"), *[F.lit(0).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends_sha256")))
    rounds = max(0, -(-top["most"] // BLOCK) - 1).bit_length()

    rows = turns.withColumnRenamed("conv_id", "seq").join(equal.select("seq", "weight", F.col("turns").alias("size")), "seq")
    part = rows.select(
        F.lit(top["least"]).cast("long").alias("tree"),
        F.lit(0).cast("long").alias("base"),
        "seq",
        "weight",
        "size",
        "pos",
        "d1",
        "d2",
        "words",
        F.when(F.col("pos") == F.col("size"), F.col("seq")).alias("ender"),
        (F.col("pos") < F.col("size")).alias("more"),
    )
    parts = [cut_lineage(part) if rounds else part]
    for k in reversed(range(rounds)):
        half = BLOCK << k
        lower = cut_lineage(_cut(_all(p.filter(F.col("size") >= half) for p in parts), half))
        parts = [*[p.filter(F.col("size") < half) for p in parts], lower]
    named = cut_lineage(_named(_all(parts)))
    nodes = cut_lineage(_nodes(named))
    totals = cut_lineage(_block_totals(named, nodes))
    if rounds:
        totals = _graft(totals, cut_lineage(_above(named, nodes)), rounds)

    # what a node is, its children, the totals below it and the digest of its ends come together as rows of one aggregate
    least, zero = F.lit(top["least"]).cast("long"), F.lit(0).cast("long")
    root = nodes.sparkSession.range(1).select(least.alias("conv_id"), zero.alias("depth"), F.lit(top["n"]).cast("long").alias("n_convs"), F.lit(top["turnless"]).cast("long").alias("ender"), F.lit(int(not top["most"])).cast("long").alias("n_leaves"))
    children = nodes.select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("n_children"))
    # the root stands above the one block that is left
    below_root = totals.filter("depth = 1").select(least.alias("conv_id"), zero.alias("depth"), *_SUMS)
    ends = whole.join(equal.select("turns", "z1", "z2", "seq"), ["turns", "z1", "z2"])
    digests = joined_digests(ends.select("seq", "conv_id"), "seq", "conv_id")
    ended = nodes.select(*_NODE, "ender").unionByName(root.select(*_NODE, "ender")).filter("ender IS NOT NULL")
    ended = ended.join(digests, F.col("ender") == F.col("group")).select(*_NODE, "sha")
    facts = nodes.select(*_NODE, "parent_conv_id", "n_convs")
    for more in (root.drop("ender"), children, totals.select(*_NODE, *_SUMS), below_root, ended):
        facts = facts.unionByName(more, allowMissingColumns=True)
    full = facts.groupBy(*_NODE).agg(*[F.max(c).alias(c) for c in ("parent_conv_id", "n_convs", "sha")], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_children", *_SUMS)])
    return _shaped(full.withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest()))))


def _all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _shaped(nodes: DataFrame) -> DataFrame:
    counts = ["depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.select(F.col("conv_id").cast("long").alias("conv_id"), *[F.col(c).cast("long").alias(c) for c in counts], "ends_sha256")
