"""Which operators run on a stream: found by running each of them on one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions import physics, solar, timefeat
from seriesmill.operators import columns, joins, ordered, reshape, rows
from seriesmill.session import checkpoint_folder
from seriesmill.streaming import read_landing

Step = Callable[[DataFrame], DataFrame]


def _with(name: str, column) -> Step:
    return lambda df: df.withColumn(name, column())


#: Operators over readings ``asset, ts, value, other, speed`` (``value`` and ``other`` may be missing, ``speed`` is positive).
OPERATORS: Mapping[str, Step] = {
    # one row at a time
    "keep_columns": lambda df: columns.keep_columns(df, ["asset", "ts"]),
    "drop_columns": lambda df: columns.drop_columns(df, ["other"]),
    "rename_columns": lambda df: columns.rename_columns(df, {"value": "Value"}),
    "downcast_floats": columns.downcast_floats,
    "to_matrix": lambda df: columns.to_matrix(df, ["value", "other"], keep=["asset"]),
    "filter_rows": lambda df: rows.filter_rows(df, F.col("value") > 50),
    "filter_assets": lambda df: rows.filter_assets(df, [3, 5, 8], "asset"),
    "drop_missing_rows": rows.drop_missing_rows,
    "drop_infinite_rows": rows.drop_infinite_rows,
    "keep_daytime": lambda df: rows.keep_daytime(df.withColumns({"up": F.date_trunc("day", "ts") + F.expr("INTERVAL 6 HOURS"), "down": F.date_trunc("day", "ts") + F.expr("INTERVAL 18 HOURS")}), "ts", "up", "down"),
    "select_daterange": lambda df: rows.select_daterange(df, "ts", "2024-01-05", "2024-01-10"),
    "quality_rules": lambda df: rows.filter_rows(df, rows.quality_rules(F.col("value"), F.col("other"))),
    "add_columns": lambda df: joins.add_columns(df, twice=F.col("value") * 2),
    "add_cyclical_encodings": lambda df: timefeat.add_cyclical_encodings(df, ["value"], {"value": (0.0, 100.0)}),
    "shift_summer_time": lambda df: timefeat.shift_summer_time(df, "ts", [("2024-01-10 00:00:00", "2024-01-20 00:00:00")]),
    "day_of_year": _with("day", lambda: timefeat.day_of_year(F.col("ts"))),
    "minute_of_day": _with("minute", lambda: timefeat.minute_of_day(F.col("ts"))),
    "utc_to_zone": _with("local", lambda: timefeat.utc_to_zone(F.col("ts"))),
    "turbulence_intensity": _with("ti", lambda: physics.turbulence_intensity(F.col("speed"), F.col("value"))),
    "add_wind_shear": lambda df: physics.add_wind_shear(df, ["speed", "value"], [77.0, 80.0]),
    "wind_power": _with("power", lambda: physics.wind_power(F.lit(280.0), F.col("speed"), F.lit(101325.0), F.lit(100.0))),
    "add_solar_terms": lambda df: solar.add_sun_terms(df, F.col("ts")),
    "add_binary_labels": lambda df: reshape.add_binary_labels(df.withColumnRenamed("value", "rul"), 7),
    # the whole table, or an order of its rows
    "drop_sparse_columns": lambda df: columns.drop_sparse_columns(df, 0.5),
    "drop_flat_columns": columns.drop_flat_columns,
    "keep_failing_assets": lambda df: rows.keep_failing_assets(df.withColumn("failure", F.col("value") > 90), "asset"),
    "normalise": lambda df: reshape.normalise(df, ["value"]),
    "add_quantile_labels": lambda df: reshape.add_quantile_labels(df, "value", 4),
    "fill_gaps": lambda df: reshape.fill_gaps(df.withColumn("day", F.date_trunc("day", "ts")).select("asset", "day").distinct(), "day", "asset"),
    "next_event": lambda df: ordered.next_event(df, df.filter("value > 90").select("asset", F.col("ts").alias("event_ts")), ["asset"], "ts", "event_ts", []),
    "row_index": lambda df: ordered.row_index(df, [F.col("ts")], [F.date_trunc("day", "ts")], ["asset"]),
}


def stream_rows(readings: DataFrame, step: Step, landing: str) -> DataFrame | None:
    """What ``step`` gives on a stream over the Parquet files in ``landing``; None where Spark refuses the plan.

    The stream takes what lies there, writes Parquet to the checkpoint folder and
    ends.  An operator that runs jobs of its own, or whose plan a stream in append
    mode cannot run, is refused before any row is read.
    """
    spark = readings.sparkSession
    place = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = read_landing(spark, landing, readings.schema)
    try:
        result = step(stream)
        running = (
            result.writeStream.format("parquet")
            .option("path", f"{place}/rows")
            .option("checkpointLocation", f"{place}/state")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    except (PySparkException, TypeError):
        return None
    running.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{place}/rows")


def capabilities(readings: DataFrame, operators: Mapping[str, Step] = OPERATORS) -> DataFrame:
    """``operator, streamable, n``: whether each operator runs on a stream of ``readings``, and how many rows came out of it.

    ``n`` is 0 for the others.  Runs a stream per operator.
    """
    spark = readings.sparkSession
    landing = f"{checkpoint_folder(spark)}/landing-{uuid.uuid4().hex}"
    readings.write.parquet(landing)
    found = []
    for name, step in operators.items():
        rows_out = stream_rows(readings, step, landing)
        found.append((name, rows_out is not None, rows_out.count() if rows_out is not None else 0))
    return spark.createDataFrame(found, "operator string, streamable boolean, n long")
