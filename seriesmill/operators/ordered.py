"""Order-dependent operators that never sort a whole group in one task.

A plain ``Window.partitionBy(asset).orderBy(ts)`` sends every row of an asset to
one task.  When a third of the data belongs to one asset that task never ends.
The operators here sort inside *chunks* (an order-preserving coarsening of the
sort key, by default the hour) and carry what crosses a chunk border through a
table with one row per (group, chunk).  That table is bounded by the calendar,
not by the number of readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.session import as_list, require_columns

HOUR = 3600


def time_chunk(ts: Column, seconds: int = HOUR) -> Column:
    """Number of the ``seconds`` wide time slot that holds ``ts``."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def _chunk_names(chunk: Sequence[Column]) -> list[str]:
    return [f"__chunk{i}" for i in range(len(chunk))]


def row_index(
    df: DataFrame,
    order: Sequence[Column],
    chunk: Sequence[Column],
    group: Sequence[str] = (),
    name: str = "row_index",
) -> DataFrame:
    """Dense 0-based position of each row in ``order`` (per ``group``).

    ``chunk`` must be a prefix-like coarsening of ``order``: rows of a smaller
    chunk sort first.  One shuffle of the rows by (group, chunk); the offsets
    come from per-chunk counts and join on the same keys, without a second one.
    Rows with a NULL group or chunk get no position.
    """
    group = as_list(group)
    names = _chunk_names(chunk)
    keyed = df.withColumns(dict(zip(names, chunk)))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(*group, *names)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*group, *names, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy(*group, *names).orderBy(*order)
    numbered = keyed.withColumn("__pos", F.row_number().over(inside))
    joined = numbered.join(starts, group + names, "left")
    return joined.select(*df.columns, (F.col("__start") + F.col("__pos") - 1).alias(name))


def add_lags(
    df: DataFrame,
    lags: Sequence[int],
    columns: Sequence[str] | str,
    group: str | Sequence[str],
    order: str,
    tie: Sequence[str] = (),
    chunk_seconds: int = HOUR,
) -> DataFrame:
    """Add ``<column>_lag_<k>`` per group in time order.

    Inside a chunk the lag is a window ``lag``; the first rows of a chunk take
    theirs from the last ``max(lags)`` rows of the chunks before it.
    """
    columns, group = as_list(columns), as_list(group)
    require_columns(df, [*columns, *group, order, *tie])
    if any(k < 1 for k in lags):
        raise ValueError("lags must be positive")
    depth = max(lags)
    keyed = df.withColumn("__chunk", time_chunk(F.col(order), chunk_seconds))
    keys = [*group, "__chunk"]
    sort = [F.col(order), *[F.col(c) for c in tie]]

    latest_first = Window.partitionBy(*keys).orderBy(*[c.desc() for c in sort])
    tails = (
        keyed.select(*keys, order, *tie, *columns)
        .withColumn("__back", F.row_number().over(latest_first))
        .filter(F.col("__back") <= depth)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("__back", *columns))).alias("__tail"))
    )
    earlier = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(-depth, -1)
    carried = tails.select(
        *keys,
        F.slice(F.flatten(F.reverse(F.collect_list("__tail").over(earlier))), 1, depth).alias("__carry"),
    )

    inside = Window.partitionBy(*keys).orderBy(*sort)
    spread = {f"__{c}_{k}": F.lag(c, k).over(inside) for k in lags for c in columns}
    local = keyed.withColumn("__pos", F.row_number().over(inside)).withColumns(spread)
    joined = local.join(carried, keys, "left")
    final = {
        f"{c}_lag_{k}": F.when(F.col("__pos") > k, F.col(f"__{c}_{k}")).otherwise(
            F.get(F.col("__carry"), F.lit(k) - F.col("__pos")).getField(c)
        )
        for k in lags
        for c in columns
    }
    return joined.withColumns(final).select(*df.columns, *final)


def lagged_series(
    df: DataFrame,
    lags: Sequence[int],
    columns: Sequence[str],
    group: str | Sequence[str],
    order: str,
    tie: Sequence[str] = (),
    name: str = "series",
    chunk_seconds: int = HOUR,
) -> DataFrame:
    """One array of shape (1 + len(lags), len(columns)) per row, newest step first."""
    columns = as_list(columns)
    if len(set(lags)) != len(lags):
        raise ValueError("lags must be distinct")
    lagged = add_lags(df, lags, columns, group, order, tie, chunk_seconds)
    steps = [F.array(*[F.col(c).cast("double") for c in columns])]
    steps += [F.array(*[F.col(f"{c}_lag_{k}").cast("double") for c in columns]) for k in lags]
    return lagged.withColumn(name, F.array(*steps)).drop(*[f"{c}_lag_{k}" for k in lags for c in columns])


def next_event(
    readings: DataFrame,
    events: DataFrame,
    key: str | Sequence[str],
    ts: str,
    event_ts: str,
    payload: Sequence[str] = (),
    tie: Sequence[str] = (),
    chunk_seconds: int = HOUR,
) -> DataFrame:
    """Forward as-of join: the earliest event with ``ts <= event_ts`` per key.

    Readings without a later event stay, with NULLs.  Events at one instant are
    ranked by ``tie`` and then by payload.  Linear in both inputs: one shuffle
    of readings and events by (key, chunk); no pair of them is formed.
    """
    key = as_list(key)
    fields = [event_ts, *[c for c in tie if c != event_ts], *[c for c in payload if c != event_ts and c not in tie]]
    kept = [event_ts, *[c for c in payload if c != event_ts]]
    clash = set(kept) & set(readings.columns)
    if clash:
        raise ValueError(f"rename the event columns {sorted(clash)} first")

    # without payload the earliest instant is a plain minimum, which hash aggregation takes
    alone = len(fields) == 1
    event = F.col(event_ts) if alone else F.struct(*fields)
    known = events.filter(F.col(event_ts).isNotNull())
    for name in key:
        known = known.filter(F.col(name).isNotNull())
    happened = known.select(
        *key,
        time_chunk(F.col(event_ts), chunk_seconds).alias("__chunk"),
        F.col(event_ts).alias("__at"),
        F.lit(0).alias("__kind"),
        event.alias("__event"),
    )
    seen = readings.select(
        *key,
        time_chunk(F.col(ts), chunk_seconds).alias("__chunk"),
        F.col(ts).alias("__at"),
        F.lit(1).alias("__kind"),
        F.struct(*[F.col(c) for c in readings.columns]).alias("__row"),
    )
    keys = [*key, "__chunk"]

    firsts = happened.groupBy(*keys).agg(F.min("__event").alias("__first"))
    slots = seen.select(*keys).distinct()
    later = Window.partitionBy(*key).orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        firsts.unionByName(slots, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.min("__first").alias("__first"))
        .select(*keys, F.min("__first").over(later).alias("__later"))
    )

    running = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("__at"), "__kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        seen.unionByName(happened, allowMissingColumns=True)
        .withColumn("__here", F.min("__event").over(running))
        .filter(F.col("__kind") == 1)
    )
    joined = found.join(carried, keys, "left")
    return joined.withColumn("__next", F.coalesce("__here", "__later")).select(
        "__row.*", *[(F.col("__next") if alone else F.col("__next").getField(c)).alias(c) for c in kept]
    )


def order_violations(df: DataFrame, group: str, ts: str) -> DataFrame:
    """Per group: rows, distinct instants and how many instants occur more than once.

    Row order has no meaning in a distributed table, so "sorted" becomes
    "no instant is repeated".
    """
    per_instant = df.groupBy(group, ts).agg(F.count(F.lit(1)).alias("__n"))
    return per_instant.groupBy(group).agg(
        F.sum("__n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_instants"),
        F.sum(F.when(F.col("__n") > 1, 1).otherwise(0)).alias("n_repeated"),
    )


def first_in_group(df: DataFrame, group: Sequence[str] | str, order: Sequence[str]) -> DataFrame:
    """The first row of each group under ``order``; combined map-side, so copies cost nothing."""
    group = as_list(group)
    rest = [c for c in df.columns if c not in group and c not in order]
    ranked = F.struct(*[F.col(c) for c in [*order, *rest]])
    return df.groupBy(*group).agg(F.min(ranked).alias("__first")).select(
        *[F.col(c) if c in group else F.col("__first").getField(c).alias(c) for c in df.columns]
    )
