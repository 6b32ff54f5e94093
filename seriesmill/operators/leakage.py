"""How much a test set leaks into a training set, from instants alone.

For a pair (test t1, train t2) of one group let d be the whole days from t1 to
t2, rounded down.  The measure adds exp(-d) over d >= 0 and alpha * exp(d) over
d < 0 and divides by the same sum with the test set in both roles.  The number
of pairs is quadratic, so no pair is ever formed here.

Write an instant as (day q, time of day r).  Then d is q2 - q1 if r2 >= r1 and
one less otherwise, and the weight depends on the days only through exp(-|dq|).
Two different days are separated by exactly one node of a binary tree over the
days.  Inside that node the weight is a product of one factor per side, so the
sum over pairs with r2 >= r1 is a running sum over r.  Each instant takes part
in one node per tree level: n * log(days) rows in total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from seriesmill.functions.timefeat import DAY_MICROS
from seriesmill.operators.ordered import time_chunk
from seriesmill.session import join_null_safe

#: Rows of one time-of-day slot that a task may sort.
SLOT_ROWS = 1_000_000
#: Time slots whose counts are one row of a convolution.
BLOCK_SLOTS = 1024


def _instants(df: DataFrame, group: str | None, ts: str, side: str) -> DataFrame:
    key = F.col(group) if group else F.lit(0)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.filter(F.col(ts).isNotNull()).select(
        key.alias("g"),
        F.floor(micros / F.lit(DAY_MICROS)).alias("q"),
        F.pmod(micros, F.lit(DAY_MICROS)).alias("r"),
        F.lit(float(side == "test")).alias("te"),
        F.lit(float(side == "train")).alias("tr"),
    )


def _tree_rows(counts: DataFrame) -> DataFrame:
    """Every instant once per tree level, and once (level -1) in the node of its own day.

    ``te_f``/``tr_f`` weigh pairs whose train day is not before the test day,
    ``te_b``/``tr_b`` the others; ``mi_*`` is the test set in the train role.
    """
    # days count from the first one, so the tree is as high as the calendar is long
    span = counts.agg(F.struct(F.min("q").alias("first"), F.max("q").alias("last"))).scalar()
    placed = counts.withColumn("span", span)
    height = F.length(F.bin(F.col("span.last") - F.col("span.first")))
    placed = placed.withColumns({"q": F.col("q") - F.col("span.first"), "height": height})
    leveled = placed.withColumn("level", F.explode(F.sequence(F.lit(-1), F.col("height") - 1))).drop("span", "height")
    own_day = F.col("level") < 0
    width = F.pow(F.lit(2.0), F.greatest("level", F.lit(0)))
    half = F.floor(F.col("q") / width)
    node = F.when(own_day, F.col("q")).otherwise(F.floor(half / 2))
    leveled = leveled.withColumns({"node": node, "left": ~own_day & (half % 2 == 0), "right": ~own_day & (half % 2 == 1)})
    middle = (F.col("node") * 2 + 1) * width
    decay = F.when(own_day, F.lit(1.0)).otherwise(F.exp(-F.abs(F.col("q") - middle)))
    leveled = leveled.withColumns({"te": F.col("te") * decay, "tr": F.col("tr") * decay})

    def share(where: Column, column: str) -> Column:
        return F.when(where, F.col(column)).otherwise(F.lit(0.0))

    earlier, later = own_day | F.col("left"), own_day | F.col("right")
    return leveled.select(
        "g",
        "level",
        "node",
        "r",
        share(earlier, "te").alias("te_f"),
        share(later, "tr").alias("tr_f"),
        share(later, "te").alias("mi_f"),
        share(F.col("right"), "te").alias("te_b"),
        share(F.col("left"), "tr").alias("tr_b"),
        share(F.col("left"), "te").alias("mi_b"),
    )


def data_leakage(
    test: DataFrame, train: DataFrame, ts: str, group: str | None = None, alpha: float = 0.0, slots: int | None = None
) -> DataFrame:
    """One row ``leakage``: 1 when the training set is the test set, near 0 when they are far apart.

    The time of day is cut into ``slots``; slot totals carry across, so a node
    that holds all rows is still sorted by ``slots`` tasks.  Unless given, their
    number comes from the rows (one job): one slot per ``SLOT_ROWS`` of them.
    """
    both = _instants(test, group, ts, "test").unionByName(_instants(train, group, ts, "train"))
    if slots is None:
        slots = 1 + both.count() // SLOT_ROWS
    counts = both.groupBy("g", "q", "r").agg(F.sum("te").alias("te"), F.sum("tr").alias("tr"))
    rows = _tree_rows(counts).withColumn("slot", F.floor(F.col("r") * slots / DAY_MICROS))
    roles = ["tr_f", "mi_f", "tr_b", "mi_b"]
    node = ["g", "level", "node"]

    after = Window.partitionBy(*node).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*node)
    carry = rows.groupBy(*node, "slot").agg(*[F.sum(c).alias(c) for c in roles])
    carry = carry.select(
        *node,
        "slot",
        *[F.coalesce(F.sum(c).over(after), F.lit(0.0)).alias(f"{c}_after") for c in roles],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in roles],
    )
    inside = Window.partitionBy(*node, "slot").orderBy(F.desc("r"))
    inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = rows.withColumns({f"{c}_here": F.sum(c).over(inside) for c in roles}).join(carry, [*node, "slot"])

    e = F.exp(F.lit(1.0))

    def met(role: str, factor: Column) -> Column:
        """Weight of the partners at or after this time of day, and of the others times ``factor``."""
        at_or_after = F.col(f"{role}_here") + F.col(f"{role}_after")
        return at_or_after + (F.col(f"{role}_all") - at_or_after) * factor

    forward_rest = F.when(F.col("level") < 0, F.lit(alpha) / e).otherwise(e)

    def total(role: str) -> Column:
        forward = F.col("te_f") * met(f"{role}_f", forward_rest)
        backward = F.col("te_b") * met(f"{role}_b", F.lit(1.0) / e) * F.lit(alpha)
        return F.sum(forward + backward)

    return reached.agg(F.try_divide(total("tr"), total("mi")).alias("leakage"))


def convolve_days(asked: tuple[np.ndarray, np.ndarray], given: tuple[np.ndarray, np.ndarray], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of counts per difference of their slots (given minus asked); both as (slots below ``block``, counts)."""
    if len(asked[0]) * len(given[0]) <= block:
        gaps = np.subtract.outer(given[0], asked[0]).reshape(-1)
        sums = np.bincount(gaps + block - 1, np.outer(given[1], asked[1]).reshape(-1), 2 * block - 1)
    else:
        dense = np.zeros((2, block))
        dense[0, asked[0]], dense[1, given[0]] = asked[1], given[1]
        sums = np.convolve(dense[1], dense[0][::-1])
    there = np.flatnonzero(sums)
    return there - block + 1, sums[there]


def distance_histogram(test: DataFrame, train: DataFrame, ts: str, group: str, slot_seconds: int = 86_400, block: int = BLOCK_SLOTS) -> DataFrame:
    """Pairs per whole-day distance (train minus test) and group: ``group, days, pairs``.

    Instants are counted per time slot, and the counts of ``block`` slots are one
    row.  Two blocks of a group are convolved at once, which gives the pairs of all
    their distances: rows move per pair of blocks and distance, neither per pair of
    instants nor per pair of days.  The result is exact for instants that lie on
    the slot grid (``slot_seconds`` divides a day) and as long as the pairs of two
    blocks stay below 2^53.
    """
    if 86_400 % slot_seconds:
        raise ValueError("slot_seconds must divide a day")
    per_day = 86_400 // slot_seconds

    def by_block(df: DataFrame, name: str) -> DataFrame:
        slot = time_chunk(F.col(ts), slot_seconds)
        counted = df.groupBy(F.col(group).alias("g"), slot.alias("slot")).agg(F.count(F.lit(1)).cast("double").alias("n")).filter("slot IS NOT NULL")
        placed = counted.select("g", F.floor(F.col("slot") / block).alias(f"{name}_block"), F.pmod("slot", F.lit(block)).alias("s"), "n")
        # at most ``block`` entries in a list
        return placed.groupBy("g", f"{name}_block").agg(F.collect_list("s").alias(f"{name}_slots"), F.collect_list("n").alias(name))

    # dealt out by test block, so that a group is shared by as many tasks as it has blocks
    first = by_block(test, "asked").repartition("g", "asked_block")
    met = join_null_safe(first, by_block(train, "given"), ["g"])
    met = met.select("g", (F.col("given_block") - F.col("asked_block")).alias("apart"), "asked_slots", "asked", "given_slots", "given")

    def convolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, days, pairs = [], [], []
            lists = [batch.column(k) for k in range(2, 6)]
            for k, apart in enumerate(batch.column(1).to_pylist()):
                asked_slots, asked, given_slots, given = (x[k].values.to_numpy() for x in lists)
                gap, sums = convolve_days((asked_slots, asked), (given_slots, given), block)
                day, at = np.unique((gap + apart * block) // per_day, return_inverse=True)
                rows.append(np.full(len(day), k))
                days.append(day)
                pairs.append(np.bincount(at, sums, len(day)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(days)), pa.array(np.concatenate(pairs))], names=["g", "days", "pairs"])

    shape = StructType([StructField("g", met.schema["g"].dataType), StructField("days", LongType()), StructField("pairs", DoubleType())])
    summed = met.mapInArrow(convolve, shape).groupBy("g", "days").agg(F.sum("pairs").alias("pairs"))
    return summed.select(F.col("g").alias(group), "days", "pairs")
