"""Scans, inventories and checks on what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesmill.operators.columns import set_column_types
from seriesmill.queries.registry import HOLES_SQL, load, query, rounded, with_holes
from seriesmill.session import checkpoint_folder
from seriesmill.sources.quality import quality_report, rename_checked
from seriesmill.sources.scans import fill_literature, parse_station, station_inventory, type_failures, type_mast, type_scada, type_station_metadata
from seriesmill.sources.sinks import run_lines, save_results, to_json_lines


@query(
    """
    SELECT cast(l_suppkey AS VARCHAR) AS turbine, year(l_shipdate) AS year, count(*) AS n_rows, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day,
           strftime(max(l_shipdate), '%Y-%m-%d') AS last_day, round(avg(l_quantity), 6) AS rpm, round(max(l_extendedprice), 6) AS power, count(try_cast(l_comment_number AS DOUBLE)) AS n_temperature
    FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'n/a' ELSE cast(l_tax AS VARCHAR) END AS l_comment_number FROM lineitem) GROUP BY 1, 2
    """
)
def scan_by_year(spark, folder):
    """Yearly readings through the typed turbine scan: span and values of each turbine and year."""
    raw = load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("Turbine_ID"),
        F.col("l_shipdate").alias("Timestamp"),
        F.col("l_quantity").cast("string").alias("Gen_RPM_Avg"),
        F.col("l_extendedprice").cast("string").alias("Grd_Prod_Pwr_Avg"),
        F.when(F.col("l_linenumber") % 2 == 0, "n/a").otherwise(F.col("l_tax").cast("string")).try_cast("double").alias("Amb_Temp_Avg"),
    )
    typed = type_scada(raw)
    return typed.groupBy(F.col("Turbine_ID").alias("turbine"), F.year("Timestamp").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.date_format(F.min("Timestamp"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("Timestamp"), "yyyy-MM-dd").alias("last_day"),
        rounded(F.avg("Gen_RPM_Avg")).alias("rpm"),
        rounded(F.max("Grd_Prod_Pwr_Avg")).alias("power"),
        F.count("Amb_Temp_Avg").alias("n_temperature"),
    )


@query(
    """
    SELECT cast(user_id AS VARCHAR) AS asset, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type AS component,
           coalesce(CASE WHEN event_id % 5 <> 0 THEN props END, 'nan') AS remarks
    FROM events WHERE event_type = 'error'
    """
)
def failure_log_scan(spark, folder):
    """Failure log with text columns forced to text."""
    raw = load(spark, folder, "events").filter(F.col("event_type") == "error").select(
        F.col("user_id").alias("Turbine_ID"),
        F.col("ts").alias("Timestamp"),
        F.col("event_type").alias("Component"),
        F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("Remarks"),
    )
    return type_failures(raw).select(
        F.col("Turbine_ID").alias("asset"), F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("Component").alias("component"), F.col("Remarks").alias("remarks")
    )


@query("SELECT o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS speed FROM orders")
def scan_without_unused_columns(spark, folder):
    """A mast scan drops its unused columns; they never leave the file."""
    raw = load(spark, folder, "orders").select(
        F.col("o_orderdate").alias("Timestamp"),
        F.col("o_totalprice").cast("string").alias("Avg_Windspeed1"),
        F.col("o_custkey").alias("Avg_Winddirection2"),
        F.col("o_custkey").alias("Var_Winddirection2"),
        F.col("o_orderkey").alias("key"),
    )
    mast = type_mast(raw)
    if "Avg_Winddirection2" in mast.columns:
        raise AssertionError("the second wind vane is still there")
    return mast.select("key", F.date_format("Timestamp", "yyyy-MM-dd").alias("day"), F.col("Avg_Windspeed1").alias("speed"))


@query(
    """
    SELECT cast(o_custkey % 10 AS VARCHAR) AS station, strftime(date_trunc('minute', o_orderdate) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS shown,
           o_totalprice AS power, count(*) AS n FROM orders GROUP BY 1, 2, 3
    """
)
def parse_station_time(spark, folder):
    """Station text files: instants parsed as UTC and shown in the station's zone, cells as numbers."""
    raw = load(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date_time"), F.col("o_totalprice").cast("string").alias("power"), "o_custkey"
    )
    parsed = parse_station(raw, (F.col("o_custkey") % 10).cast("string"), "UTC+8")
    return parsed.groupBy(F.col("Station_ID").alias("station"), F.date_format("date_time", "yyyy-MM-dd HH:mm:ss").alias("shown"), "power").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT 'station' || lpad(cast(s_suppkey AS VARCHAR), 4, '0') AS station_id, s_acctbal AS capacity,
           cast(s_nationkey AS INTEGER) AS panel_number, s_name AS module
    FROM supplier
    """
)
def station_dimension(spark, folder):
    """Station metadata with declared types, from text cells."""
    raw = load(spark, folder, "supplier").select(
        F.concat(F.lit("station"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("Station_ID"),
        F.col("s_acctbal").cast("string").alias("Capacity"),
        F.col("s_nationkey").cast("string").alias("Panel_Number"),
        F.col("s_name").alias("Module"),
    )
    typed = type_station_metadata(raw)
    return typed.select(F.col("Station_ID").alias("station_id"), F.col("Capacity").alias("capacity"), F.col("Panel_Number").alias("panel_number"), F.col("Module").alias("module"))


@query(
    """
    SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'total' ELSE l_returnflag END AS station, count(*) AS n_rows
    FROM lineitem GROUP BY ROLLUP (l_returnflag)
    """
)
def row_inventory(spark, folder):
    """Rows per station and in total."""
    return station_inventory(load(spark, folder, "lineitem"), "l_returnflag")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 7 <> 0 THEN p_type END, 'None') AS used_metrics FROM part")
def review_defaults(spark, folder):
    """Missing cells of a review table get their default text."""
    part = load(spark, folder, "part")
    return fill_literature(part.select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("used_metrics")), {"used_metrics": "None"})


@query(
    f"""
    WITH {HOLES_SQL}
    SELECT 'error' AS level, 'columns without tags' AS "check", 'l_shipdate' AS detail, cast(1 AS BIGINT) AS n
    UNION ALL SELECT 'warning', 'missing values', '', cast(sum((l_discount IS NULL)::INT + (l_tax IS NULL)::INT) AS BIGINT) FROM holes
    UNION ALL SELECT 'warning', 'text columns', 'l_returnflag,l_linestatus', 2
    UNION ALL SELECT 'warning', 'columns without label', 'l_tax', 1
    """
)
def frame_quality(spark, folder):
    """Errors and warnings about a frame, read once."""
    frame = with_holes(load(spark, folder, "lineitem"))
    tags = {c: set() for c in frame.columns if c != "l_shipdate"}
    return quality_report(frame, tags, [c for c in frame.columns if c != "l_tax"])


@query("SELECT n_nationkey AS asset, n_name AS label, n_regionkey AS site FROM nation")
def checked_rename(spark, folder):
    """Rename in which every column must be known."""
    return rename_checked(load(spark, folder, "nation"), {"n_nationkey": "asset", "n_name": "label", "n_regionkey": "site", "other": "x"})


@query("SELECT lpad(cast(s_suppkey AS VARCHAR), 4, '0') || ' ' || s_name AS value FROM supplier")
def run_list_lines(spark, folder):
    """A run list as numbered lines."""
    runs = load(spark, folder, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_name").alias("name"))
    return run_lines(runs)


@query("SELECT cast(json_object('n_nationkey', n_nationkey, 'n_name', n_name) AS VARCHAR) AS value FROM nation")
def run_list_json(spark, folder):
    """A run list as JSON lines."""
    return to_json_lines(load(spark, folder, "nation").select("n_nationkey", "n_name"))


@query(
    """
    SELECT cast(user_id AS VARCHAR) AS serial_number, event_type = 'error' AS failure,
           try_cast(regexp_extract(props, '[0-9]+') AS DOUBLE) AS smart_1_raw
    FROM events
    """
)
def asset_column_types(spark, folder):
    """Declared types of an asset-day table."""
    events = load(spark, folder, "events")
    raw = events.select(
        F.col("user_id").alias("serial_number"),
        F.when(F.col("event_type") == "error", "true").otherwise("false").alias("failure"),
        F.regexp_extract("props", "[0-9]+", 0).alias("smart_1_raw"),
    )
    return set_column_types(raw)


@query("SELECT o_orderpriority AS priority, cast(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(avg(o_totalprice), 6) + 0.0 AS price FROM orders GROUP BY 1, 2")
def persisted_results(spark, folder):
    """A results table written by year to the shared folder and read back."""
    results = load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("o_totalprice")).alias("price")
    )
    path = f"{checkpoint_folder(spark)}/results-{uuid.uuid4().hex}"
    save_results(results, path, ["year"])
    return spark.read.parquet(path).select("priority", F.col("year").cast("int").alias("year"), "n", "price")
