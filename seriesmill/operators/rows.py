"""Filters, cleaning and quality rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.session import as_list, require_columns

def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def filter_assets(df: DataFrame, assets, column: str = "serial_number") -> DataFrame:
    """Rows of the given assets, a semi-join whether they come as a list or as a frame."""
    if not isinstance(assets, DataFrame):
        assets = df.sparkSession.createDataFrame([(a,) for a in as_list(assets)], T.StructType([df.schema[column]]))
    return df.join(assets.select(F.col(assets.columns[0]).alias(column)).distinct(), column, "left_semi")


def require_rows(*frames: DataFrame) -> None:
    """Raise when one of the frames is empty.  Runs one short job per frame."""
    for frame in frames:
        if frame.isEmpty():
            raise ValueError("the selection leaves an empty table")


def drop_missing_rows(df: DataFrame) -> DataFrame:
    """Drop rows with NULL or NaN in any column; infinities stay."""
    return df.na.drop("any")


def drop_infinite_rows(df: DataFrame, columns: Sequence[str] | str | None = None) -> DataFrame:
    """Turn +-inf into NULL in ``columns`` (default all), then drop rows with anything missing in any column."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if columns is not None:
        require_columns(df, columns)
        floating = [c for c in floating if c in as_list(columns)]
    cleaned = {c: F.when(F.abs(F.col(f"`{c}`")) != F.lit(float("inf")), F.col(f"`{c}`")) for c in floating}
    return drop_missing_rows(df.withColumns(cleaned) if cleaned else df)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One copy of every row; copies are folded map-side."""
    return df.distinct()


def keep_failing_assets(df: DataFrame, asset: str = "serial_number", failure: str = "failure") -> DataFrame:
    """All rows of assets that have at least one failure."""
    return df.join(failing_assets(df, asset, failure), asset, "left_semi")


def failing_assets(df: DataFrame, asset: str = "serial_number", failure: str = "failure") -> DataFrame:
    return df.filter(F.col(failure)).select(asset).distinct()


def healthy_assets(df: DataFrame, asset: str = "serial_number", failure: str = "failure") -> DataFrame:
    """Assets without any failure; one pass, no set difference needed."""
    return (
        df.groupBy(asset)
        .agg(F.max(F.coalesce(F.col(failure), F.lit(False))).alias("__failed"))
        .filter(~F.col("__failed"))
        .select(asset)
    )


def keep_daytime(df: DataFrame, ts: str, sunrise: str, sunset: str) -> DataFrame:
    return df.filter(F.col(ts).between(F.col(sunrise), F.col(sunset)))


def select_daterange(df: DataFrame, ts: str, start: str, end: str, zone: str = "UTC") -> DataFrame:
    """Rows between two local instants of ``zone``, both included.

    The bounds become literals, so the filter reaches the scan.
    """
    def instant(text: str) -> Column:
        local = F.lit(text).cast("timestamp")
        return local if zone == "UTC" else F.to_utc_timestamp(local, zone)

    low, high = instant(start), instant(end)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        low, high = low.cast("timestamp_ntz"), high.cast("timestamp_ntz")
    return df.filter((F.col(ts) >= low) & (F.col(ts) <= high))


# Zenith angle in degrees, solar constant and offsets of the irradiance limits.
STATION_ZENITH = 33.0
SOLAR_CONSTANT = 1361.0


def _sun_factor(zenith: Column) -> Column:
    return F.pow(F.cos(F.radians(zenith)), F.lit(1.2))


def irradiance_flags(value: Column, extraterrestrial: Column, zenith: Column, kind: str) -> tuple[Column, Column]:
    """(physically possible, extremely rare) limits for ``GHI``, ``DHI`` or ``BNI`` as two booleans."""
    factor = _sun_factor(zenith)
    limits = {
        "GHI": (extraterrestrial * 1.5 * factor + 100, extraterrestrial * 1.5 * factor + 50),
        "DHI": (extraterrestrial * 0.95 * factor + 50, extraterrestrial * 0.95 * factor + 30),
        "BNI": (extraterrestrial, extraterrestrial * 0.95 * factor + 10),
    }
    if kind not in limits:
        raise ValueError(f"unknown irradiance kind {kind!r}")
    possible, rare = limits[kind]
    return (value > -4) & (value < possible), (value > -2) & (value < rare)


def quality_rules(total: Column, diffuse: Column, compat: bool = True) -> Column:
    """Station quality control: physical limits, extreme limits and the day threshold in one predicate.

    ``compat=True`` bounds the physical step by the measured diffuse irradiance,
    as published; ``compat=False`` uses the extraterrestrial irradiance.
    """
    factor = _sun_factor(F.lit(STATION_ZENITH))
    top = diffuse if compat else F.lit(1367.0)
    physical = (total >= -4) & (total <= top * 1.5 * factor + 100) & (diffuse >= -4) & (diffuse <= top * 0.95 * factor + 50)
    extreme = (
        (total > -4)
        & (total < SOLAR_CONSTANT * 1.5 * factor + 100)
        & (diffuse > -4)
        & (diffuse < SOLAR_CONSTANT * 0.95 * factor + 50)
    )
    return physical & extreme & (total > 50)
