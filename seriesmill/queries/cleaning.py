"""Column choice, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.catalog import wind
from seriesmill.catalog.drives import preset_columns
from seriesmill.catalog.tags import scenario_rule, tag_filter, target_of
from seriesmill.operators import columns as C
from seriesmill.operators import rows as R
from seriesmill.plans import solar as solar_plan
from seriesmill.plans import wind as wind_plan
from seriesmill.plans.chain import Chain
from seriesmill.queries.registry import HOLES_SQL, load, query, rounded, with_holes


@query("SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def keep_known_columns(spark, folder):
    """Intersection with a wish list, in frame order."""
    return C.keep_columns(load(spark, folder, "lineitem"), ["l_tax", "l_quantity", "no_such_column", "l_orderkey"])


@query("SELECT c_custkey, c_acctbal FROM customer")
def drop_named_columns(spark, folder):
    """Explicit drop."""
    return C.drop_columns(load(spark, folder, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])


@query("SELECT r_regionkey AS site, r_name AS label FROM region")
def rename_by_map(spark, folder):
    """Renaming by a map."""
    return C.rename_columns(load(spark, folder, "region"), {"r_regionkey": "site", "r_name": "label"})


def _part_tags(spark, folder):
    """A catalog made from parts: feature name and tags."""
    return load(spark, folder, "part").select(
        "p_partkey",
        F.array(
            F.col("p_type"),
            F.when(F.col("p_size") > 25, "system_state").otherwise("forecast_available"),
            F.when(F.col("p_size") % 2 == 0, "circular").otherwise("cyclical_encoding"),
        ).alias("tags"),
    )


PART_TAGS_SQL = """
tags AS (
  SELECT p_partkey, [p_type, CASE WHEN p_size > 25 THEN 'system_state' ELSE 'forecast_available' END,
                     CASE WHEN p_size % 2 = 0 THEN 'circular' ELSE 'cyclical_encoding' END] AS tags
  FROM part)
"""


@query(
    f"""
    WITH {PART_TAGS_SQL}
    SELECT p_partkey FROM tags
    WHERE NOT list_contains(tags, 'circular') AND list_contains(tags, 'forecast_available')
      AND (list_contains(tags, 'ECONOMY') OR list_contains(tags, 'PROMO') OR list_contains(tags, 'STANDARD'))
    """
)
def select_features_by_tags(spark, folder):
    """Tags: excluded, all of, any of."""
    keep = tag_filter(F.col("tags"), include_all={"forecast_available"}, include_any={"ECONOMY", "PROMO", "STANDARD"}, exclude={"circular"})
    return _part_tags(spark, folder).filter(keep).select("p_partkey")


@query("SELECT l_orderkey, l_extendedprice AS target FROM lineitem")
def target_column(spark, folder):
    """The one column tagged as target."""
    tags = {"l_quantity": {"x"}, "l_extendedprice": {"target"}, "l_tax": set()}
    return load(spark, folder, "lineitem").select("l_orderkey", F.col(target_of(tags)).alias("target"))


@query(
    f"""
    WITH {PART_TAGS_SQL}
    SELECT p_partkey, 'forecast_available' AS scenario FROM tags
    WHERE NOT list_contains(tags, 'system_state') AND NOT list_contains(tags, 'circular')
    UNION ALL
    SELECT p_partkey, 'digital_twin' FROM tags WHERE NOT list_contains(tags, 'cyclical_encoding')
    """
)
def scenario_feature_sets(spark, folder):
    """Features of both scenarios: with encodings for one model family, raw angles for the other."""
    tags = _part_tags(spark, folder)
    first = tags.filter(tag_filter(F.col("tags"), **scenario_rule("forecast_available", "mlp")))
    second = tags.filter(tag_filter(F.col("tags"), **scenario_rule("digital_twin", "rf")))
    return (
        first.select("p_partkey", F.lit("forecast_available").alias("scenario"))
        .unionByName(second.select("p_partkey", F.lit("digital_twin").alias("scenario")))
    )


@query(
    """
    SELECT l_suppkey AS asset, round(avg(l_quantity), 6) AS load, round(stddev_samp(l_tax), 6) AS "rate_Std",
           round(avg(l_tax), 6) AS rate
    FROM lineitem GROUP BY l_suppkey
    """
)
def keep_average_statistics(spark, folder):
    """Only averages keep their column, plus listed statistics."""
    stats = load(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("asset")).agg(
        rounded(F.avg("l_quantity")).alias("load_Avg"),
        rounded(F.max("l_quantity")).alias("load_Max"),
        rounded(F.stddev_samp("l_tax")).alias("rate_Std"),
        rounded(F.avg("l_tax")).alias("rate_Avg"),
        rounded(F.min("l_tax")).alias("rate_Min"),
    )
    return C.keep_averages(stats, {"std": ["rate"]})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_by_predicate(spark, folder):
    """Row filter that reaches the scan."""
    keep = (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")
    return R.filter_rows(load(spark, folder, "orders"), keep).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (1, 2, 3, 5, 8, 13)")
def filter_listed_assets(spark, folder):
    """Rows of listed assets."""
    return R.filter_assets(load(spark, folder, "events"), [1, 2, 3, 5, 8, 13], "user_id").select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events WHERE value > 200)")
def filter_assets_by_table(spark, folder):
    """Rows of assets named by another frame."""
    events = load(spark, folder, "events")
    return R.filter_assets(events, events.filter(F.col("value") > 200).select("user_id"), "user_id").select("event_id", "user_id")


@query("SELECT l_quantity AS smart_1_raw, l_tax AS smart_2_raw, l_suppkey AS serial_number FROM lineitem")
def keep_health_attributes(spark, folder):
    """Columns by prefix and suffix, plus named ones."""
    renamed = C.rename_columns(
        load(spark, folder, "lineitem"),
        {"l_quantity": "smart_1_raw", "l_tax": "smart_2_raw", "l_discount": "smart_1_normalized", "l_suppkey": "serial_number"},
    )
    return C.keep_health_columns(renamed, "serial_number", raw_only=True)


@query("SELECT l_orderkey, l_tax AS smart_5_raw, l_discount AS smart_187_raw FROM lineitem")
def preset_attribute_set(spark, folder):
    """A published attribute set, as far as the frame has it."""
    renamed = C.rename_columns(
        load(spark, folder, "lineitem"), {"l_quantity": "smart_2_raw", "l_tax": "smart_5_raw", "l_discount": "smart_187_raw"}
    )
    return C.keep_columns(renamed, preset_columns(["backblaze", "l_orderkey"]))


@query("SELECT l_orderkey, l_linenumber, cast(l_extendedprice AS FLOAT) AS l_extendedprice, cast(l_tax AS FLOAT) AS l_tax FROM lineitem")
def downcast_to_float(spark, folder):
    """DOUBLE to FLOAT."""
    return C.downcast_floats(load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"))


@query(
    f"""
    WITH {HOLES_SQL}
    SELECT 'l_quantity' AS "column", count(*) AS n_rows, count(l_quantity) AS n_present, round(var_samp(l_quantity), 4) AS variance FROM holes
    UNION ALL SELECT 'l_discount', count(*), count(l_discount), round(var_samp(l_discount), 4) FROM holes
    UNION ALL SELECT 'l_tax', count(*), count(l_tax), round(var_samp(l_tax), 4) FROM holes
    UNION ALL SELECT 'l_linenumber', count(*), count(l_linenumber), round(var_samp(l_linenumber), 4) FROM holes
    """
)
def column_statistics(spark, folder):
    """Presence and variance of every column in one pass."""
    frame = with_holes(load(spark, folder, "lineitem")).select("l_quantity", "l_discount", "l_tax", "l_linenumber")
    return C.column_profile(frame).withColumn("variance", rounded("variance", 4))


@query(f"WITH {HOLES_SQL} SELECT l_orderkey, l_linenumber, l_quantity FROM holes")
def drop_sparse(spark, folder):
    """Columns with fewer than int(0.95 n) values go."""
    frame = with_holes(load(spark, folder, "lineitem")).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return C.drop_sparse_columns(frame, 0.95)


@query(f"WITH {HOLES_SQL} SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM holes WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL")
def drop_incomplete_rows(spark, folder):
    """Rows with anything missing go; infinities stay."""
    frame = with_holes(load(spark, folder, "lineitem")).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return R.drop_missing_rows(frame)


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_discount <> 0 AND (l_orderkey + l_linenumber) % 11 <> 0
    """
)
def drop_infinite(spark, folder):
    """Infinite ratios become missing, then incomplete rows go."""
    frame = load(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 11 != 0, F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.lit(1.0)).alias("ratio"),
    )
    return R.drop_infinite_rows(frame, "ratio").drop("ratio")


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def drop_low_variance(spark, folder):
    """Columns with variance up to the threshold go; the key is not checked."""
    frame = load(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_tax", F.lit(3.0).alias("constant"))
    return C.drop_flat_columns(frame, 0.01, ["l_quantity", "l_tax", "constant"])


@query("SELECT l_orderkey, l_tax AS tax_Avg FROM lineitem")
def drop_constant_average_columns(spark, folder):
    """Constant average columns of one source go."""
    frame = load(spark, folder, "lineitem").select("l_orderkey", F.col("l_tax").alias("tax_Avg"), F.lit(1.0).alias("flag_Avg"))
    return C.drop_constant_averages(frame)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_tax FROM lineitem")
def drop_copies(spark, folder):
    """Full-row duplicates go."""
    return R.drop_duplicate_rows(load(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_tax"))


def _events_with_failures(spark, folder):
    """Events as asset rows: a failure is an error with a large value."""
    return load(spark, folder, "events").withColumn("failure", (F.col("event_type") == "error") & (F.col("value") > 120))


@query(
    """
    SELECT event_id, user_id FROM events
    WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 120)
    """
)
def keep_assets_with_failure(spark, folder):
    """All rows of assets that failed at least once."""
    return R.keep_failing_assets(_events_with_failures(spark, folder), "user_id").select("event_id", "user_id")


@query(
    """
    SELECT user_id, bool_or(event_type = 'error' AND value > 120) AS failed FROM events GROUP BY user_id
    """
)
def assets_by_failure(spark, folder):
    """Failing and healthy assets."""
    events = _events_with_failures(spark, folder)
    failing = R.failing_assets(events, "user_id").withColumn("failed", F.lit(True))
    return failing.unionByName(R.healthy_assets(events, "user_id").withColumn("failed", F.lit(False)))


@query(
    """
    SELECT event_id FROM events
    WHERE ts >= date_trunc('day', ts) + to_minutes(cast(330 + user_id % 60 AS BIGINT))
      AND ts <= date_trunc('day', ts) + to_minutes(cast(1080 + user_id % 60 AS BIGINT))
    """
)
def keep_daylight_rows(spark, folder):
    """Rows between sunrise and sunset."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    events = load(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (day + F.make_dt_interval(mins=(F.lit(330) + F.col("user_id") % 60).cast("int"))).alias("sunrise"),
        (day + F.make_dt_interval(mins=(F.lit(1080) + F.col("user_id") % 60).cast("int"))).alias("sunset"),
    )
    return R.keep_daytime(events, "ts", "sunrise", "sunset").select("event_id")


@query(
    """
    WITH q AS (SELECT event_id, value * 6 AS total, value * 2 AS diffuse, pow(cos(radians(33.0)), 1.2) AS f FROM events)
    SELECT event_id FROM q
    WHERE total >= -4 AND total <= 1.5 * diffuse * f + 100 AND diffuse >= -4 AND diffuse <= 0.95 * diffuse * f + 50
      AND total > -4 AND total < 1.5 * 1361 * f + 100 AND diffuse > -4 AND diffuse < 0.95 * 1361 * f + 50 AND total > 50
    """
)
def station_quality_control(spark, folder):
    """Three irradiance rule sets in one filter."""
    events = load(spark, folder, "events")
    return events.filter(R.quality_rules(F.col("value") * 6, F.col("value") * 2)).select("event_id")


@query(
    """
    WITH q AS (SELECT event_id, value * 10 AS x, (user_id % 80)::DOUBLE AS z FROM events)
    SELECT event_id,
           x > -4 AND x < 1.5 * 1361 * pow(cos(radians(z)), 1.2) + 100 AS ghi_possible,
           x > -2 AND x < 1.5 * 1361 * pow(cos(radians(z)), 1.2) + 50 AS ghi_common,
           x > -4 AND x < 0.95 * 1361 * pow(cos(radians(z)), 1.2) + 50 AS dhi_possible,
           x > -2 AND x < 0.95 * 1361 * pow(cos(radians(z)), 1.2) + 30 AS dhi_common,
           x > -4 AND x < 1361 AS bni_possible,
           x > -2 AND x < 0.95 * 1361 * pow(cos(radians(z)), 1.2) + 10 AS bni_common
    FROM q
    """
)
def irradiance_limits(spark, folder):
    """Quality flags for global, diffuse and beam irradiance."""
    events = load(spark, folder, "events")
    value, zenith = F.col("value") * 10, (F.col("user_id") % 80).cast("double")
    flags = []
    for kind in ("GHI", "DHI", "BNI"):
        possible, common = R.irradiance_flags(value, F.lit(1361.0), zenith, kind)
        flags += [possible.alias(f"{kind.lower()}_possible"), common.alias(f"{kind.lower()}_common")]
    return events.select("event_id", *flags)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-04 16:00:00' AND ts <= TIMESTAMP '2024-01-11 16:00:00'")
def select_local_daterange(spark, folder):
    """A closed date range given in local time."""
    return R.select_daterange(load(spark, folder, "events"), "ts", "2024-01-05 00:00:00", "2024-01-12 00:00:00", "Asia/Shanghai").select("event_id")


@query("SELECT l_orderkey, l_linenumber, cast(l_quantity AS VARCHAR) AS v0, cast(l_tax AS VARCHAR) AS v1 FROM lineitem")
def rows_as_matrix(spark, folder):
    """A frame as one array per row."""
    frame = load(spark, folder, "lineitem")
    matrix = C.to_matrix(frame, ["l_quantity", "l_tax"], keep=["l_orderkey", "l_linenumber"])
    return matrix.select("l_orderkey", "l_linenumber", *[F.col("values")[i].cast("string").alias(f"v{i}") for i in range(2)])


@query(
    """
    WITH clean AS (SELECT DISTINCT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_totalprice IS NOT NULL)
    SELECT o_orderkey, o_totalprice,
           round(sin(2 * pi() * (dayofyear(o_orderdate) - 1) / 365.0), 6) + 0.0 AS "DayOfYear_sin",
           round(cos(2 * pi() * (dayofyear(o_orderdate) - 1) / 365.0), 6) + 0.0 AS "DayOfYear_cos"
    FROM clean
    """
)
def cleaning_chain(spark, folder):
    """Deduplicate, drop sparse and constant columns, drop incomplete rows, encode the season."""
    from seriesmill.functions.timefeat import add_cyclical_encodings, day_of_year

    chain = (
        Chain()
        .apply(R.drop_duplicate_rows)
        .apply(lambda df: C.drop_sparse_columns(df, 0.95))
        .apply(R.drop_missing_rows)
        .apply(lambda df: C.drop_flat_columns(df, 1e-10, ["o_totalprice", "constant"]))
        .apply(lambda df: df.withColumn("DayOfYear", day_of_year(F.col("o_orderdate"))))
        .apply(lambda df: add_cyclical_encodings(df, ["DayOfYear"], wind.CYCLIC_RANGES))
    )
    orders = load(spark, folder, "orders").select(
        "o_orderkey",
        "o_totalprice",
        "o_orderdate",
        F.lit(1.0).alias("constant"),
        F.when(F.col("o_orderkey") % 2 == 0, 1.0).alias("sparse"),
    )
    cleaned = chain(orders)
    return cleaned.select("o_orderkey", "o_totalprice", rounded("DayOfYear_sin").alias("DayOfYear_sin"), rounded("DayOfYear_cos").alias("DayOfYear_cos"))


@query(
    """
    WITH raw AS (
      SELECT DISTINCT cast(l_suppkey AS VARCHAR) AS turbine, l_shipdate AS ts, l_extendedprice / 1000 AS power, l_quantity AS ambient,
             CASE WHEN l_linenumber = 5 THEN 0 ELSE l_quantity / 4 END AS w1, l_quantity / 5 + 0.5 AS w2, cast(l_partkey % 360 AS DOUBLE) AS direction,
             CASE WHEN l_linenumber <> 7 THEN l_tax END AS ti2, CASE WHEN l_orderkey % 50 <> 0 THEN l_discount * 100 END AS temperature
      FROM lineitem)
    SELECT turbine, strftime(ts, '%Y-%m-%d') AS day, round(power, 6) + 0.0 AS power, ambient, round(w1, 6) + 0.0 AS w1, round(w2, 6) + 0.0 AS w2, direction,
           ti2, round(temperature, 6) + 0.0 AS temperature, round((ln(w2) - ln(CASE WHEN w1 = 0 THEN 0.1 ELSE w1 END)) / (ln(77.0) - ln(80.0)), 6) + 0.0 AS shear,
           round(sin(2 * pi() * direction / 360), 6) + 0.0 AS direction_sin, round(cos(2 * pi() * direction / 360), 6) + 0.0 AS direction_cos, 12 AS n_columns
    FROM raw WHERE ti2 IS NOT NULL AND temperature IS NOT NULL
    """
)
def wind_cleaning(spark, folder):
    """The whole wind cleaning plan: unknown, proxy, sparse and flat columns go, incomplete and infinite rows too."""
    items = load(spark, folder, "lineitem")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    frame = items.select(
        F.col("l_suppkey").cast("string").alias("Turbine ID"),
        F.col("l_shipdate").alias("Timestamp"),
        (F.col("l_extendedprice") / 1000).alias("Grid Produced Power"),
        q.alias("Ambient Wind Speed"),
        F.when(n == 5, 0.0).otherwise(q / 4).alias("Wind Speed 1"),
        (q / 5 + 0.5).alias("Wind Speed 2"),
        (F.col("l_partkey") % 360).cast("double").alias("Nacelle Direction"),
        F.when(n == 7, float("inf")).otherwise(F.col("l_tax")).alias("Turbulence Intensity 2"),
        F.when(F.col("l_orderkey") % 50 != 0, F.col("l_discount") * 100).alias("Ambient Temperature"),
        F.lit(5.0).alias("Humidity"),
        F.when(n == 1, q).alias("Precipitation"),
        F.col("l_tax").alias("Grid Reactive Power"),
        F.col("l_tax").alias("no such signal"),
    )
    clean = wind_plan.clean(frame)
    shown = {
        "power": "Grid Produced Power", "w1": "Wind Speed 1", "w2": "Wind Speed 2", "temperature": "Ambient Temperature",
        "shear": "Wind Shear", "direction_sin": "Nacelle Direction_sin", "direction_cos": "Nacelle Direction_cos",
    }
    return clean.select(
        F.col("Turbine ID").alias("turbine"), F.date_format("Timestamp", "yyyy-MM-dd").alias("day"), F.col("Ambient Wind Speed").alias("ambient"),
        F.col("Nacelle Direction").alias("direction"), F.col("Turbulence Intensity 2").alias("ti2"),
        *[rounded(F.col(f"`{name}`")).alias(short) for short, name in shown.items()], F.lit(len(clean.columns)).alias("n_columns"),
    )


@query(
    """
    WITH raw AS (
      SELECT DISTINCT cast(l_suppkey % 10 AS VARCHAR) AS station, l_shipdate AS ts, l_extendedprice / 1000 AS power, cast(l_partkey % 360 AS DOUBLE) AS direction,
             CASE WHEN l_orderkey % 40 <> 0 THEN l_discount * 100 END AS temperature
      FROM lineitem WHERE l_linenumber <> 4)
    SELECT station, strftime(ts, '%Y-%m-%d') AS day, round(power, 6) + 0.0 AS power, direction, round(temperature, 6) + 0.0 AS temperature,
           round(sin(2 * pi() * direction / 360), 6) + 0.0 AS direction_sin, round(cos(2 * pi() * direction / 360), 6) + 0.0 AS direction_cos, 8 AS n_columns
    FROM raw WHERE temperature IS NOT NULL
    """
)
def solar_cleaning(spark, folder):
    """The whole photovoltaic cleaning plan over daytime rows."""
    items = load(spark, folder, "lineitem")
    frame = items.select(
        (F.col("l_suppkey") % 10).cast("string").alias("Station ID"),
        F.col("l_shipdate").alias("Timestamp"),
        (F.col("l_linenumber") != 4).alias("is_daytime"),
        (F.col("l_extendedprice") / 1000).alias("Power"),
        (F.col("l_partkey") % 360).cast("double").alias("NWP Wind Direction"),
        F.when(F.col("l_orderkey") % 40 != 0, F.col("l_discount") * 100).alias("NWP Temperature"),
        F.lit(101.0).alias("LMD Pressure"),
        F.when(F.col("l_linenumber") == 1, F.col("l_tax")).alias("LMD Temperature"),
    )
    clean = solar_plan.clean(frame)
    shown = {"power": "Power", "temperature": "NWP Temperature", "direction_sin": "NWP Wind Direction_sin", "direction_cos": "NWP Wind Direction_cos"}
    return clean.select(
        F.col("Station ID").alias("station"), F.date_format("Timestamp", "yyyy-MM-dd").alias("day"), F.col("NWP Wind Direction").alias("direction"),
        *[rounded(F.col(f"`{name}`")).alias(short) for short, name in shown.items()], F.lit(len(clean.columns)).alias("n_columns"),
    )
