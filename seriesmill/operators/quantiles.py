"""Exact quantiles of row-sized data without one task holding a group.

``percentile`` keeps every distinct value of a group in one hash map.  That is
fine for a few hundred bootstrap replicates and wrong for sensor readings.
``quantiles`` counts rows per (group, value) with map-side combine and takes the
ranks from running sums.  Where a group has more rows than one task should sort,
its own value axis is first cut into bins of about equal size by a mergeable
sketch; rows are counted per (group, bin) to find the bins that hold the wanted
ranks; only those bins are sorted, each in its own task.  Such groups are few
(rows over rows per bin), so their edges go out whole and rows stay where they
are: a join on the group would send each large group to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.session import as_list, join_null_safe

#: Rows of a group that one task may sort.
BIN_ROWS = 1_000_000


def bin_of(value: Column, edges: Column, levels: int) -> Column:
    """Number of ``edges`` (a sorted array of 2**levels - 1 values) below ``value``."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda pos, step: F.when(F.element_at(edges, pos + step) < value, pos + step).otherwise(pos),
    )


def present(column: Column) -> Column:
    """The value as a double, NULL where it is NaN."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def _levels(rows: DataFrame, group: Sequence[str], bin_rows: int) -> int:
    """Halvings that bring the rows of the largest group down to ``bin_rows`` per bin.  Runs one job."""
    largest = rows.groupBy(*group).agg(F.count("__v").alias("n")).agg(F.max("n")).first()[0] or 0
    return max(0, (-(-largest // bin_rows) - 1).bit_length())


def _ranks(total: Column, probs: Sequence[float]) -> list[tuple[Column, Column, Column]]:
    """Lower rank, upper rank and share of the upper one, per probability."""
    found = []
    for p in probs:
        place = (total - 1) * F.lit(float(p))
        found.append((F.floor(place).cast("long"), F.ceil(place).cast("long"), place - F.floor(place)))
    return found


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    group: Sequence[str] | str = (),
    weight: str | None = None,
    names: Sequence[str] | None = None,
    levels: int | None = None,
    expand: Callable[[DataFrame], DataFrame] | None = None,
    expanded: Sequence[str] = (),
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per ``group``; one row per group of the input.

    ``weight`` is an integer multiplicity.  NULL and NaN are skipped; a group
    without values has NULL quantiles.  The number of bins comes from the rows of
    the largest group (one job), so that a bin holds about ``bin_rows`` of them;
    ``levels`` (a power of two of bins) spares that job.

    ``expand`` multiplies the rows (bootstrap replicates) and adds the columns
    ``expanded`` to group by, and perhaps the weight.  Bins are found before it,
    and only rows of the wanted bins are expanded a second time; a group that no
    row was drawn for has no row.
    """
    group = as_list(group)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    narrow = [c for c in group if c not in expanded]
    kept = df.columns if expand else [*group, *([weight] if weight else [])]
    rows = df.select(*kept, present(F.col(value)).alias("__v"))
    if levels is None:
        levels = _levels(rows, narrow, bin_rows)

    def weighted(frame: DataFrame) -> DataFrame:
        grown = expand(frame) if expand else frame
        w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
        w = F.when(F.col("__v").isNull(), F.lit(0).cast("long")).otherwise(w)
        return grown.select(*group, *[c for c in ("__bin",) if c in frame.columns], "__v", w.alias("__w"))

    if levels == 0:
        return _from_values(weighted(rows), group, probs, names)
    n_edges = (1 << levels) - 1
    cuts = ", ".join(f"{(i + 1) / (n_edges + 1)!r}D" for i in range(n_edges))
    sketch = F.expr(f"percentile_approx(__v, array({cuts}), {8 * (n_edges + 1)})").alias("__edges")
    if narrow:
        # a group that one task can sort is one bin, number -1
        edges = rows.groupBy(*narrow).agg(sketch, F.count("__v").alias("__n")).filter(F.col("__n") > bin_rows).drop("__n")
        placed = join_null_safe(rows, F.broadcast(edges), narrow, "left")
    else:
        placed = rows.withColumn("__edges", rows.agg(sketch).scalar())
    bins = F.when(F.col("__edges").isNull(), F.lit(-1)).otherwise(bin_of(F.col("__v"), F.col("__edges"), levels))
    placed = placed.withColumn("__bin", bins).drop("__edges")

    keys = [*group, "__bin"]
    up_to = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    overall = Window.partitionBy(*group)
    mass = (
        weighted(placed)
        .groupBy(*keys)
        .agg(F.sum("__w").alias("__mass"))
        .withColumn("__end", F.sum("__mass").over(up_to))
        .withColumn("__total", F.sum("__mass").over(overall))
    )
    wanted = []
    for i, (low, high, share) in enumerate(_ranks(F.col("__total"), probs)):
        wanted += [F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.alias("rank"), share.alias("share")) for side, rank in ((0, low), (1, high))]
    targets = (
        mass.withColumn("__want", F.explode(F.array(*wanted)))
        .filter((F.col("__want.rank") < F.col("__end")) & (F.col("__want.rank") >= F.col("__end") - F.col("__mass")))
        .withColumn("__rank", F.col("__want.rank") - (F.col("__end") - F.col("__mass")))
        .select(*keys, "__rank", F.col("__want.i").alias("__i"), F.col("__want.side").alias("__side"), F.col("__want.share").alias("__share"))
    )
    needed = targets.groupBy(*keys).agg(F.collect_list(F.struct("__rank", "__i", "__side", "__share")).alias("__targets"))
    inside = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rows outside every wanted bin go no further; large groups have few bins
    spots = needed.select(*narrow, "__bin").filter("__bin >= 0").distinct().withColumn("__wanted", F.lit(True))
    placed = join_null_safe(placed, F.broadcast(spots), [*narrow, "__bin"], "left").filter("__bin < 0 OR __wanted").drop("__wanted")
    ends = (
        join_null_safe(weighted(placed).filter("__w > 0"), needed.select(*keys), keys, "left_semi")
        .groupBy(*keys, "__v")
        .agg(F.sum("__w").alias("__w"))
        .withColumn("__upto", F.sum("__w").over(inside))
    )
    hits = (
        join_null_safe(ends, needed, keys)
        .withColumn("__t", F.explode("__targets"))
        .filter((F.col("__t.__rank") < F.col("__upto")) & (F.col("__t.__rank") >= F.col("__upto") - F.col("__w")))
    )
    picks = []
    for i, name in enumerate(names):
        low = F.max(F.when((F.col("__t.__i") == i) & (F.col("__t.__side") == 0), F.col("__v")))
        high = F.max(F.when((F.col("__t.__i") == i) & (F.col("__t.__side") == 1), F.col("__v")))
        share = F.max(F.when(F.col("__t.__i") == i, F.col("__t.__share")))
        picks.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    found = hits.groupBy(*group).agg(*picks)
    # asking for the total keeps the plan that counts the bins, so that rows are not expanded for the names of the groups
    every = mass.groupBy(*group).agg(F.max("__total").alias("__total")).filter("__total >= 0").drop("__total") if group else None
    return join_null_safe(every, found, group, "left") if group else found


def _from_values(weighted: DataFrame, group: list[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Quantiles of groups that one task can sort: equal values are folded first."""
    own = Window.partitionBy(*group)
    folded = (
        weighted.groupBy(*group, "__v")
        .agg(F.sum("__w").alias("__w"))
        .withColumn("__upto", F.sum("__w").over(own.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("__total", F.sum("__w").over(own))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__w")), F.col("__v")))

    picks = []
    for name, (lower, upper, share) in zip(names, _ranks(F.col("__total"), probs)):
        low, high = at(lower), at(upper)
        picks.append(F.when(low == high, low).otherwise(low + (high - low) * F.max(share)).alias(name))
    return folded.groupBy(*group).agg(*picks)
