"""Calendar, cyclic and clock-change expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def day_of_year(ts: Column) -> Column:
    return F.dayofyear(ts)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def whole_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded towards minus infinity (-1 h is -1)."""
    return F.floor(micros_between(start, end) / F.lit(DAY_MICROS))


def angle(value: Column, low: float, high: float) -> Column:
    return (value - F.lit(float(low))) * F.lit(2 * math.pi) / F.lit(float(high) - float(low))


def add_cyclical_encodings(df: DataFrame, features: Iterable[str], ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``<feature>_sin`` and ``<feature>_cos`` for each circular feature; a feature without a range is an error."""
    features = list(features)
    lacking = [f for f in features if f not in ranges]
    if lacking:
        raise KeyError(f"no value range for {lacking}")
    added: dict[str, Column] = {}
    for name in features:
        turn = angle(F.col(f"`{name}`"), *ranges[name])
        added[f"{name}_sin"] = F.sin(turn)
        added[f"{name}_cos"] = F.cos(turn)
    return df.withColumns(added) if added else df


def shift_summer_time(df: DataFrame, ts: str, ranges: Sequence[tuple[str, str]]) -> DataFrame:
    """Move instants inside the given ``[start, end)`` ranges back by one hour."""
    kind = df.schema[ts].dataType
    inside = F.lit(False)
    for start, end in ranges:
        inside = inside | ((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))
    return df.withColumn(ts, F.when(inside, F.col(ts) - F.expr("INTERVAL 1 HOUR")).otherwise(F.col(ts)))


def days_to_event(ts: Column, event_ts: Column) -> Column:
    """Remaining whole days as DOUBLE; +inf without an event."""
    return F.coalesce(whole_days(ts, event_ts).cast("double"), F.lit(float("inf")))


def utc_to_zone(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.from_utc_timestamp(ts, zone)


def zone_to_utc(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_utc_timestamp(ts, zone)
