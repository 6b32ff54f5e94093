"""Typed scans of the raw tables and their Parquet landing copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.catalog import solar, wind
from seriesmill.operators.columns import drop_columns

FAILURE_SCHEMA = T.StructType(
    [
        T.StructField("Turbine_ID", T.StringType()),
        T.StructField("Timestamp", T.TimestampType()),
        T.StructField("Component", T.StringType()),
        T.StructField("Remarks", T.StringType()),
    ]
)


def scada_schema() -> T.StructType:
    """Asset id, instant and one DOUBLE per stored statistic."""
    signals = [f"{raw}_{s}" for raw, _, stats, _ in wind.TURBINE_SIGNALS for s in stats]
    signals += [raw for raw, _ in wind.PRODUCTION_SIGNALS]
    return T.StructType(
        [T.StructField("Turbine_ID", T.StringType()), T.StructField("Timestamp", T.TimestampType())]
        + [T.StructField(name, T.DoubleType()) for name in signals]
    )


def mast_schema() -> T.StructType:
    signals = [f"{s}_{raw}" for raw, _, stats in wind.MAST_SIGNALS for s in stats]
    signals += [raw for raw, _, _ in wind.INSTRUMENT_SIGNALS]
    signals += list(wind.UNUSED_MAST_COLUMNS)
    return T.StructType(
        [T.StructField("Timestamp", T.TimestampType())] + [T.StructField(name, T.DoubleType()) for name in signals]
    )


def station_schema(ts_type: T.DataType | None = None) -> T.StructType:
    """Columns of a station file in file order; the instant is text in the raw files."""
    measured = [raw for raw, _, _ in solar.STATION_COLUMNS if raw.startswith(("nwp_", "lmd_"))]
    return T.StructType(
        [T.StructField("date_time", ts_type or T.StringType())]
        + [T.StructField(name, T.DoubleType()) for name in [*measured, "power"]]
    )


METADATA_SCHEMA = T.StructType(
    [
        T.StructField("Station_ID", T.StringType()),
        T.StructField("Capacity", T.DoubleType()),
        T.StructField("PV_Technology", T.StringType()),
        T.StructField("Panel_Size", T.StringType()),
        T.StructField("Module", T.StringType()),
        T.StructField("Inverters", T.StringType()),
        T.StructField("Layout", T.StringType()),
        T.StructField("Panel_Number", T.IntegerType()),
        T.StructField("Array_Tilt", T.StringType()),
        T.StructField("Pyranometer", T.StringType()),
        T.StructField("Longitude", T.DoubleType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Altitude", T.DoubleType()),
    ]
)


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns that are there to the declared types, in file order."""
    types = {f.name: f.dataType for f in schema}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def type_scada(raw: DataFrame) -> DataFrame:
    """Turbine readings with the declared types."""
    return _typed(raw, scada_schema())


def scan_scada(spark: SparkSession, path: str) -> DataFrame:
    """Turbine readings; a table landed by ``land_by_year`` prunes on ``year``."""
    return type_scada(spark.read.parquet(path))


def type_failures(raw: DataFrame) -> DataFrame:
    """Failure log; remarks and components are text, missing ones read ``nan`` as published."""
    return _typed(raw, FAILURE_SCHEMA).fillna("nan", ["Component", "Remarks"])


def scan_failures(spark: SparkSession, path: str) -> DataFrame:
    return type_failures(spark.read.parquet(path))


def type_mast(raw: DataFrame) -> DataFrame:
    """Weather mast readings without the unused second wind vane."""
    typed = _typed(raw, mast_schema())
    return drop_columns(typed, [c for c in wind.UNUSED_MAST_COLUMNS if c in typed.columns])


def scan_mast(spark: SparkSession, path: str) -> DataFrame:
    return type_mast(spark.read.parquet(path))


def parse_station(raw: DataFrame, station: Column, zone: str = "UTC") -> DataFrame:
    """Station readings with a text ``date_time`` as typed rows with ``Station_ID``; minutes are kept, seconds cut.

    The text is UTC.  ``zone="UTC+8"`` keeps the instant and shifts the shown
    wall clock by eight hours (no summer time).
    """
    if zone not in ("UTC", "UTC+8"):
        raise ValueError("zone must be UTC or UTC+8")
    parsed = F.date_trunc("minute", F.to_timestamp("date_time", "yyyy-MM-dd HH:mm:ss"))
    if zone == "UTC+8":
        parsed = F.from_utc_timestamp(parsed, "Asia/Shanghai")
    return _typed(raw, station_schema()).withColumn("date_time", parsed).withColumn("Station_ID", station)


def scan_station(spark: SparkSession, path: str, station: str | None = None, zone: str = "UTC") -> DataFrame:
    """Station CSV files as one table; the file name is the station unless one is given."""
    raw = spark.read.schema(station_schema()).option("header", True).option("enforceSchema", False).csv(path)
    name = F.lit(station) if station else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1)
    return parse_station(raw, name, zone)


def type_station_metadata(raw: DataFrame) -> DataFrame:
    """Station dimension table, from text cells."""
    return _typed(raw, METADATA_SCHEMA)


def scan_station_metadata(spark: SparkSession, path: str) -> DataFrame:
    return type_station_metadata(spark.read.option("header", True).csv(path))


def fill_literature(raw: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Review table; ``defaults`` fills missing cells."""
    return raw.fillna(defaults) if defaults else raw


def scan_literature(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """Review table with quoted comma lists."""
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )
    return fill_literature(raw, defaults)


def land_by_year(df: DataFrame, path: str, ts: str = "Timestamp") -> None:
    """Write a Parquet copy with one folder per year.  Runs one job.

    Rows are spread by instant inside a year, so no year is written by one task.
    """
    year = df.withColumn("year", F.year(ts))
    year.repartitionByRange("year", ts).write.mode("overwrite").partitionBy("year").parquet(path)


def station_inventory(df: DataFrame, station: str = "Station_ID") -> DataFrame:
    """Rows per station and in total (``station`` reads ``total``)."""
    return (
        df.rollup(station)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.grouping(station).alias("__all"))
        .select(F.when(F.col("__all") == 1, F.lit("total")).otherwise(F.col(station).cast("string")).alias("station"), "n_rows")
    )
