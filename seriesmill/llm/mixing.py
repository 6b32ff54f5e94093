"""Mix sources to target weights: whole repeats first, then a subset-sum fit of the rest."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.words import word_array
from seriesmill.session import cut_lineage, join_null_safe

#: Largest remainder, in words, that dynamic programming fits exactly.
EXACT_WORDS = 1 << 17
#: Slices of the draw within one source and length; ranks are taken slice by slice.
SLICES = 1 << 12


def source_targets(sizes: DataFrame, source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source_col``, ``source_size`` and ``target`` of every source.

    Sources in code-point order, NULL last, take ``weights`` in turn and share the
    words of all documents by weight; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight, until none is above.  That is
    ``min(most * size, level * weight)`` with one common level; the sources that
    stop are a prefix in the order of ``size / weight``.  The table has a row per
    source, and only that table is ordered as a whole.
    """
    totals = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    named = totals.withColumn("__weight", weight).withColumn("__limit", F.lit(float(most)) * F.col("source_size"))
    order = [F.col("__limit") / F.col("__weight"), F.col(source_col).asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))
    levels = named.withColumn("__level", left / F.sum("__weight").over(after)).withColumn("__rank", F.row_number().over(Window.orderBy(*order)))
    # the level holds from the first source that stays below its limit
    holds = F.when(F.col("__level") * F.col("__weight") <= F.col("__limit"), F.col("__level"))
    chosen = levels.withColumn("__common", F.min_by(holds, F.when(holds.isNotNull(), F.col("__rank"))).over(every))
    target = F.least(F.col("__limit"), F.coalesce(F.col("__common") * F.col("__weight"), F.col("__limit")))
    return chosen.select(source_col, "source_size", target.alias("target"))


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int, exact: int = EXACT_WORDS) -> list[int]:
    """How many documents of each length to take so that their lengths sum up to about ``budget``, never above.

    An even share of every length first, which keeps the mix of lengths and leaves
    room for a few of the longest; then, from the longest on, whole documents until
    the remainder is at most ``exact`` (or nothing fits); then bounded-knapsack
    dynamic programming fills the remainder as far as any choice of the documents
    left can.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    if budget <= 0 or not total:
        return [0] * len(lengths)
    even = max(0, budget - 4 * max(lengths))
    taken = [c * even // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, taken))
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    for k in order:
        if rest <= exact:
            break
        more = min(counts[k] - taken[k], (rest - exact // 2) // lengths[k])
        if more > 0:
            taken[k] += more
            rest -= more * lengths[k]
    if rest > exact:
        # all that is left is longer than rest - exact // 2, so one document fits at most: the longest that does
        for k in order:
            if taken[k] < counts[k] and lengths[k] <= rest:
                taken[k] += 1
                return taken
    if not 0 < rest <= exact:
        return taken
    # binary splitting: lots of 1, 2, 4, ... documents of a length
    lots, reach = [], 1
    full = (1 << (rest + 1)) - 1
    # the first lot that reaches each sum; the sum without it was reached by lots before
    first = np.zeros(rest + 1, np.int64)
    for k in reversed(order):
        free = min(counts[k] - taken[k], rest // lengths[k]) if lengths[k] else 0
        lot = 1
        while free > 0:
            lot = min(lot, free)
            free -= lot
            after = (reach | reach << lot * lengths[k]) & full
            if after != reach:
                new = np.frombuffer((after ^ reach).to_bytes(rest // 8 + 1, "little"), np.uint8)
                first[np.flatnonzero(np.unpackbits(new, bitorder="little"))] = len(lots)
                lots.append((k, lot))
                reach = after
            lot *= 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    while at:
        k, lot = lots[first[at]]
        taken[k] += lot
        at -= lot * lengths[k]
    return taken


def _fit(plan: pd.DataFrame) -> pd.DataFrame:
    """Copies of all and the number of extra documents per length, for one source."""
    plan = plan.sort_values("size")
    lengths, counts = plan["size"].tolist(), plan["n"].tolist()
    total, target = int(plan["source_size"].iloc[0]), float(plan["target"].iloc[0])
    whole = int(target // total) if total else 0
    plan["whole"] = whole
    filled = [k for k, n in enumerate(lengths) if n > 0]
    extra = [0] * len(lengths)
    for k, t in zip(filled, fit_budget([lengths[k] for k in filled], [counts[k] for k in filled], round(target) - whole * total)):
        extra[k] = t
    plan["extra"] = extra
    return plan[["source", "size", "whole", "extra"]]


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 11, keep: Sequence[str] = (),
) -> DataFrame:
    """For every document the words that the mix takes of it.

    Returns ``id_col``, ``size`` (words; 0 for NULL), ``source_size``, ``target``,
    ``taken`` (``size`` times the copies), ``copies`` and the columns ``keep``.
    Each source is copied ``floor(target / size)`` times; what is left of its
    target goes to single documents: counts per exact length are fitted
    (:func:`fit_budget`, in one task per source over its distinct lengths), and of
    each length the documents with the smallest seeded draws are taken.  Documents
    without words are taken as often as their source is copied whole.  A NULL
    source is a source.  Rows that repeat an identifier are ranked one after the
    other.  Reruns agree.  Draws are ranked within slices of the hash, so one length
    of one source may hold most rows.
    """
    words = F.size(word_array(F.col(text_col))).cast("long")
    extra = {f"__keep{k}": F.col(c) for k, c in enumerate(keep)}
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("draw"), *[c.alias(n) for n, c in extra.items()])
    rows = cut_lineage(rows.withColumn("slice", F.pmod(F.shiftrightunsigned("draw", 40), F.lit(SLICES)).cast("int")))
    counts = rows.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts)
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(lengths.select("source", (F.col("size") * F.col("n")).alias("size")), "source", weights, most)
    planned = join_null_safe(lengths, targets, ["source"])
    fitted = planned.groupBy("source").applyInPandas(_fit, f"source {rows.schema['source'].dataType.simpleString()}, size long, whole long, extra long")
    # documents of a length in the slices before, then the rank within the slice
    earlier = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    slices = join_null_safe(join_null_safe(slices, fitted, ["source", "size"]), targets, ["source"])
    slices = slices.select("source", "size", "slice", "before", "whole", "extra", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", "id"))
    ranked = join_null_safe(rows.withColumn("rank", rank), slices, ["source", "size", "slice"])
    copies = F.col("whole") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("long")
    return ranked.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"),
        *[F.col(n).alias(c) for n, c in zip(extra, keep)],
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies; columns and texts as they were.

    Identifiers are expected to be distinct; rows that repeat one share the most
    copies that any of them has, and so do rows with a NULL identifier.
    """
    copies = mix(docs, id_col, text_col, source_col, **how).filter("copies > 0").groupBy(F.col(id_col).alias("__mix_id")).agg(F.max("copies").alias("__copies"))
    joined = docs.join(copies, F.col(id_col).eqNullSafe(F.col("__mix_id")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
