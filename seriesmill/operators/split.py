"""Leakage-free splits by time or position."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.timefeat import micros_between
from seriesmill.operators.ordered import row_index


def first_match(conditions: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, so overlapping splits go to the earlier one."""
    chosen = F.lit(None).cast("string")
    for name, condition in reversed(list(conditions)):
        chosen = F.when(condition, F.lit(name)).otherwise(chosen)
    return chosen


def split_by_time(
    df: DataFrame,
    ts: str,
    ratios: Sequence[float],
    gap_seconds: float = 0.0,
    names: Sequence[str] | None = None,
    column: str = "split",
) -> DataFrame:
    """Two- or three-way split at shares of the time span, with a gap centred on every cut.

    Both ends of a part are included and the outer ends are not shrunk; rows in
    a gap get NULL.  The span comes from a scalar subquery over one aggregate,
    so nothing is shuffled and nothing runs before the result is used.
    """
    if not math.isclose(sum(ratios), 1.0, abs_tol=1e-9):
        raise ValueError("ratios must sum up to 1")
    names = list(names) if names else ["train", "test"] if len(ratios) == 2 else ["train", "val", "test"]
    if len(names) != len(ratios):
        raise ValueError("one name per ratio is needed")
    span = df.agg(F.struct(F.min(ts).alias("first"), F.max(ts).alias("last"))).scalar()
    placed = df.withColumn("__span", span)
    total = micros_between(F.col("__span.first"), F.col("__span.last"))
    offset = micros_between(F.col("__span.first"), F.col(ts))
    half = gap_seconds * 1e6 / 2
    parts = []
    reached = 0.0
    for i, (name, ratio) in enumerate(zip(names, ratios)):
        is_last = i == len(ratios) - 1
        left = total * F.lit(reached) + F.lit(half if i else 0.0)
        reached += ratio
        right = total.cast("double") if is_last else total * F.lit(reached) - F.lit(half)
        parts.append((name, (offset >= left) & (offset <= right)))
    return placed.withColumn(column, first_match(parts)).drop("__span")


def describe_splits(df: DataFrame, ts: str, column: str = "split") -> DataFrame:
    """Rows and first and last instant of every split."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_rows"))
    )


def split_head_tail(
    df: DataFrame, order: Sequence[Column], chunk: Sequence[Column], ratio: float = 0.8, column: str = "split"
) -> DataFrame:
    """The first ``int(rows * ratio)`` rows in ``order`` are ``train``, the others ``test``."""
    rows = df.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio))).scalar()
    numbered = row_index(df, order, chunk, name="__index").withColumn("__rows", rows)
    part = F.when(F.col("__index") < F.col("__rows"), F.lit("train")).otherwise(F.lit("test"))
    return numbered.withColumn(column, part).drop("__index", "__rows")
