"""From station readings and station metadata to a clean modelling table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.catalog import solar
from seriesmill.catalog.tags import select_by_tags
from seriesmill.functions.solar import add_sky, add_sun_times
from seriesmill.functions.timefeat import add_cyclical_encodings, day_of_year, minute_of_day
from seriesmill.operators.columns import drop_flat_columns, drop_sparse_columns
from seriesmill.operators.joins import attach_dimension
from seriesmill.operators.rows import drop_duplicate_rows, drop_missing_rows
from seriesmill.operators.sets import sort_rows
from seriesmill.session import cut_lineage
from seriesmill.sources.quality import rename_checked

DEFAULT_TURBIDITY = 3.0


def assemble(stations: DataFrame, metadata: DataFrame, turbidity: str | None = None) -> DataFrame:
    """Readings of all stations with their own site, sun times, daytime flag and sky columns, renamed.

    Each station uses its own coordinates.  ``turbidity`` names a Linke
    turbidity column of the metadata; without one a constant of 3 is used.
    """
    joined = attach_dimension(stations, metadata, "Station_ID")
    haze = turbidity or "__turbidity"
    if turbidity is None:
        joined = joined.withColumn(haze, F.lit(DEFAULT_TURBIDITY))
    timed = add_sun_times(joined, "date_time", "Latitude", "Longitude", "Altitude", "Asia/Shanghai")
    instant = F.col("date_time").cast("timestamp")
    local = F.from_utc_timestamp(instant, "Asia/Shanghai")
    timed = timed.withColumns(
        {
            "is_daytime": instant.between(F.col("sunrise"), F.col("sunset")),
            "DayOfYear": day_of_year(local),
            "MinuteOfDay": minute_of_day(local),
        }
    )
    for source in solar.SOURCES:
        timed = add_sky(timed, "date_time", "Latitude", "Longitude", "Altitude", haze, source)
    return rename_checked(timed.drop(haze), solar.rename_map())


def clean(df: DataFrame, tags: Mapping | None = None, sort: bool = False) -> DataFrame:
    """The seven cleaning steps, daytime rows only.

    Runs jobs: the deduplicated table is checkpointed once, then two column
    profiles scan that copy.
    """
    tags = tags or solar.feature_tags()
    df = cut_lineage(drop_duplicate_rows(df.filter("is_daytime")))
    df = drop_missing_rows(drop_sparse_columns(df, 0.95))
    df = drop_flat_columns(df, 1e-10, select_by_tags(tags, exclude={"meta", "target", "power_proxy"}))
    circular = [c for c in select_by_tags(tags, include_any={"circular"}) if c in df.columns]
    df = add_cyclical_encodings(df, circular, solar.CYCLIC_RANGES)
    return sort_rows(df, "Timestamp") if sort else df
