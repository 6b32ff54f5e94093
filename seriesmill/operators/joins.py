"""Joins.  No strategy is forced: adaptive execution broadcasts a side only below its size threshold
and splits skewed partitions of the other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.timefeat import days_to_event
from seriesmill.operators.ordered import next_event
from seriesmill.session import as_list, require_columns


def join_at_instant(left: DataFrame, right: DataFrame, ts: str) -> DataFrame:
    """Inner join of two readings tables on the instant."""
    return left.join(right, ts, "inner")


def join_before(left: DataFrame, right: DataFrame, key: str, condition: Column) -> DataFrame:
    """Inner equi-join with an extra inequality.

    One row per matching pair; for "the next one only" use ``next_event``, which forms no pairs.
    """
    return left.join(right, key, "inner").filter(condition)


def attach(df: DataFrame, extra: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Left join that keeps every row of ``df``."""
    return df.join(extra, as_list(on), "left")


def attach_dimension(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Dimension columns on every reading.

    A reading of an asset without a dimension row, or of one with several, fails
    the job: exactly one row per asset is asked for.  Readings without a key keep
    empty dimension columns.
    """
    rest = [c for c in dimension.columns if c != key]
    counted = dimension.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"), F.first(F.struct(*rest)).alias("__dimension"))
    joined = df.join(counted, key, "left")
    wrong = F.col(key).isNotNull() & (F.coalesce("__rows", F.lit(0)) != 1)
    message = F.format_string("%s rows of metadata for asset %s", F.coalesce("__rows", F.lit(0)).cast("string"), F.col(key).cast("string"))
    checked = joined.withColumn("__dimension", F.when(wrong, F.raise_error(message)).otherwise(F.col("__dimension")))
    return checked.select(*df.columns, *[F.col(f"__dimension.`{c}`").alias(c) for c in rest])


def dimension_row(dimension: DataFrame, key: str, value) -> DataFrame:
    """The metadata row of one asset."""
    return dimension.filter(F.col(key) == F.lit(value))


def time_overlap(df: DataFrame, asset: str, ts: str, first, second) -> DataFrame:
    """First and last instant that both assets have; one pass, no join."""
    common = (
        df.filter(F.col(asset).isin([first, second]))
        .groupBy(ts)
        .agg(F.max((F.col(asset) == F.lit(first)).cast("int")).alias("a"), F.max((F.col(asset) == F.lit(second)).cast("int")).alias("b"))
        .filter((F.col("a") == 1) & (F.col("b") == 1))
    )
    return common.agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


def compare_runs(ours: DataFrame, baseline: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join of a runs table with its baseline; other columns get ``_ours`` and ``_baseline``."""
    on = as_list(on)
    left = ours.select(*on, *[F.col(f"`{c}`").alias(f"{c}_ours") for c in ours.columns if c not in on])
    right = baseline.select(*on, *[F.col(f"`{c}`").alias(f"{c}_baseline") for c in baseline.columns if c not in on])
    return left.join(right, on, how)


def members(df: DataFrame, ids: DataFrame, key: str, present: bool = True) -> DataFrame:
    """Rows whose key is (or is not) in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi" if present else "left_anti")


def add_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Derived columns next to the existing ones; nothing is joined."""
    return df.withColumns(columns)


def attach_next_failure(
    readings: DataFrame,
    failures: DataFrame,
    asset: str,
    ts: str,
    horizon_days: int = 21,
    same_year: bool = True,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Next failure of each reading with remaining days and an imminent-failure flag.

    ``failures`` holds asset, ``ts`` and descriptive columns.  ``same_year``
    keeps the published rule that a reading does not see next year's failures.
    """
    require_columns(readings, [asset, ts])
    details = [c for c in failures.columns if c not in (asset, ts)]
    log = failures.withColumnRenamed(ts, "Timestamp_failure")
    key = [asset]
    if same_year:
        key = [asset, "__year"]
        readings = readings.withColumn("__year", F.year(ts))
        log = log.withColumn("__year", F.year("Timestamp_failure"))
    joined = next_event(readings, log, key, ts, "Timestamp_failure", details, chunk_seconds=chunk_seconds)
    days = days_to_event(F.col(ts), F.col("Timestamp_failure"))
    labelled = joined.withColumn("rul", days).withColumn("impending_failure", F.col("rul") < horizon_days)
    return labelled.drop("__year")
