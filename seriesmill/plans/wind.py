"""From turbine, mast and failure tables to a clean modelling table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.catalog import wind
from seriesmill.catalog.tags import select_by_tags
from seriesmill.functions.physics import add_wind_shear, turbulence_from_variance, turbulence_intensity
from seriesmill.functions.timefeat import add_cyclical_encodings, day_of_year, minute_of_day, shift_summer_time
from seriesmill.operators.clock import repair_repeated_hour
from seriesmill.operators.columns import (
    drop_constant_averages,
    drop_flat_columns,
    drop_sparse_columns,
    keep_averages,
    keep_columns,
    numeric_columns,
)
from seriesmill.operators.joins import attach_next_failure, join_at_instant
from seriesmill.operators.rows import drop_duplicate_rows, drop_infinite_rows, drop_missing_rows, filter_assets
from seriesmill.operators.sets import sort_rows
from seriesmill.session import as_list, cut_lineage
from seriesmill.sources.quality import rename_checked


def assemble(
    scada: DataFrame,
    mast: DataFrame,
    failures: DataFrame,
    turbines: Sequence[str] | str | None = None,
    horizon_days: int = 21,
    drop_constant: bool = False,
    extra: Mapping[str, Iterable[str]] | None = None,
    signals: Sequence[str] | None = None,
) -> DataFrame:
    """Readings joined with the mast, clock fixed, next failure attached, renamed, one value per signal.

    All years go through one plan.  Failures of another year stay invisible, as
    published.  ``signals`` restricts the clock repair to some columns.
    """
    if turbines is not None:
        scada = filter_assets(scada, as_list(turbines), "Turbine_ID")
        failures = filter_assets(failures, as_list(turbines), "Turbine_ID")
    readings = join_at_instant(scada, mast, "Timestamp")
    readings = shift_summer_time(readings, "Timestamp", wind.SUMMER_TIME)
    failures = shift_summer_time(failures, "Timestamp", wind.SUMMER_TIME)
    readings = repair_repeated_hour(readings, "Turbine_ID", "Timestamp", signals or numeric_columns(readings))
    if drop_constant:
        readings = drop_constant_averages(readings)
    joined = attach_next_failure(readings, failures, "Turbine_ID", "Timestamp", horizon_days)
    timed = joined.withColumns({"DayOfYear": day_of_year(F.col("Timestamp")), "MinuteOfDay": minute_of_day(F.col("Timestamp"))})
    named = rename_checked(timed, wind.rename_map())
    return keep_averages(add_turbulence(named), extra)


def add_turbulence(df: DataFrame) -> DataFrame:
    """Turbulence intensity of the nacelle and both mast anemometers, where their columns exist."""
    added = {}
    if {"Ambient Wind Speed_Avg", "Ambient Wind Speed_Std"} <= set(df.columns):
        added["Turbulence Intensity"] = turbulence_intensity(F.col("Ambient Wind Speed_Avg"), F.col("Ambient Wind Speed_Std"))
    for i in (1, 2):
        if {f"Wind Speed {i}_Avg", f"Wind Speed {i}_Var"} <= set(df.columns):
            added[f"Turbulence Intensity {i}"] = turbulence_from_variance(F.col(f"Wind Speed {i}_Avg"), F.col(f"Wind Speed {i}_Var"))
    return df.withColumns(added) if added else df


def clean(df: DataFrame, tags: Mapping | None = None, sort: bool = False) -> DataFrame:
    """The eleven cleaning steps.

    Runs jobs: the deduplicated table is checkpointed once, then three column
    profiles scan that copy, because dropped columns decide the next steps.
    """
    tags = tags or wind.feature_tags()
    heights = wind.ANEMOMETER_HEIGHTS
    df = keep_columns(df, select_by_tags(tags, exclude={"power_proxy"}))
    df = cut_lineage(drop_duplicate_rows(df))
    df = drop_missing_rows(drop_sparse_columns(df, 0.95))
    if set(heights) <= set(df.columns):
        df = add_wind_shear(df, list(heights), list(heights.values()))
        df = drop_missing_rows(drop_sparse_columns(df, 0.95))
    if "Turbulence Intensity 2" in df.columns:
        df = drop_infinite_rows(df, "Turbulence Intensity 2")
    df = drop_flat_columns(df, 1e-10, select_by_tags(tags, exclude={"meta", "target", "power_proxy"}))
    circular = [c for c in select_by_tags(tags, include_any={"circular"}) if c in df.columns]
    df = add_cyclical_encodings(df, circular, wind.CYCLIC_RANGES)
    return sort_rows(df, "Timestamp") if sort else df
