"""Scalar functions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.catalog.literature import FEATURE_CATEGORIES, item_to_category
from seriesmill.functions import physics as P
from seriesmill.functions import solar
from seriesmill.functions import text as X
from seriesmill.functions import timefeat as T
from seriesmill.operators import reshape as R
from seriesmill.operators.literature import add_implied_feature
from seriesmill.operators.quantiles import quantiles
from seriesmill.operators.sets import filter_runs
from seriesmill.queries.registry import load, query, rounded


@query(
    """
    SELECT event_id, dayofyear(ts) AS day_of_year, hour(ts) * 60 + minute(ts) AS minute_of_day,
           round(sin(2 * pi() * (dayofyear(ts) - 1) / 365.0), 6) + 0.0 AS day_sin,
           round(cos(2 * pi() * (dayofyear(ts) - 1) / 365.0), 6) + 0.0 AS day_cos,
           round(sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1439.0), 6) + 0.0 AS minute_sin,
           round(cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1439.0), 6) + 0.0 AS minute_cos
    FROM events
    """
)
def cyclic_time_features(spark, folder):
    """Day of year and minute of day with their sine and cosine."""
    events = load(spark, folder, "events")
    timed = events.select("event_id", T.day_of_year(F.col("ts")).alias("day"), T.minute_of_day(F.col("ts")).alias("minute"))
    encoded = T.add_cyclical_encodings(timed, ["day", "minute"], {"day": (1, 366), "minute": (0, 1439)})
    return encoded.select(
        "event_id",
        F.col("day").cast("long").alias("day_of_year"),
        F.col("minute").cast("long").alias("minute_of_day"),
        *[rounded(f"{c}_{f}").alias(f"{c}_{f}") for c in ("day", "minute") for f in ("sin", "cos")],
    )


@query(
    """
    SELECT event_id, strftime(CASE WHEN (ts >= TIMESTAMP '2024-01-05 03:00:00' AND ts < TIMESTAMP '2024-01-12 02:00:00')
                                     OR (ts >= TIMESTAMP '2024-01-20 03:00:00' AND ts < TIMESTAMP '2024-01-25 02:00:00')
                               THEN ts - INTERVAL 1 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') AS at
    FROM events
    """
)
def shift_summer_ranges(spark, folder):
    """One hour back inside given ranges."""
    ranges = [("2024-01-05 03:00:00", "2024-01-12 02:00:00"), ("2024-01-20 03:00:00", "2024-01-25 02:00:00")]
    shifted = T.shift_summer_time(load(spark, folder, "events").select("event_id", "ts"), "ts", ranges)
    return shifted.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(round(CASE WHEN m = 0 THEN CASE WHEN s > 0 THEN 1e9 END ELSE s / m END, 6), -1) AS intensity,
           coalesce(round(CASE WHEN m = 0 THEN CASE WHEN s > 0 THEN 1e9 END ELSE sqrt(s) / m END, 6), -1) AS from_variance
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity / 10) AS m, l_tax AS s FROM lineitem)
    """
)
def turbulence_intensity(spark, folder):
    """std/mean and sqrt(var)/mean; x/0 is infinite, 0/0 undefined."""
    items = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.floor(F.col("l_quantity") / 10).cast("double").alias("m"), F.col("l_tax").alias("s")
    )

    def shown(value):
        capped = F.when(F.isnan(value), None).when(value == float("inf"), 1e9).otherwise(value)
        return F.coalesce(F.round(capped, 6), F.lit(-1.0))

    m, s = F.col("m"), F.col("s")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        shown(P.turbulence_intensity(m, s)).alias("intensity"),
        shown(P.turbulence_from_variance(m, s)).alias("from_variance"),
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           round((ln(CASE WHEN l_tax = 0 THEN 0.1 ELSE l_tax END) - ln(CASE WHEN l_discount = 0 THEN 0.1 ELSE l_discount END)) / (ln(77.0) - ln(80.0)), 6) + 0.0 AS shear
    FROM lineitem
    """
)
def wind_shear_exponent(spark, folder):
    """Power-law exponent between 80 m and 77 m."""
    items = load(spark, folder, "lineitem")
    return items.select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(P.wind_shear(F.col("l_discount"), F.col("l_tax"), 80.0, 77.0)).alias("shear")
    )


@query(
    """
    WITH r AS (SELECT event_id, 270 + user_id % 40 AS temp, value / 20 AS v, 98000 + event_id % 4000 AS p FROM events)
    SELECT event_id, round(p / (287.05 * temp), 8) AS density, round(0.5 * p / (287.05 * temp) * 50 * v * v * v, 4) AS power,
           round(0.4 * 0.5 * p / (287.05 * temp) * 50 * v * v * v, 4) AS turbine, round(10 * v * v * v / (0.5 * p / (287.05 * temp) * 50 * v * v * v), 6) AS coefficient
    FROM r
    """
)
def wind_power_formulas(spark, folder):
    """Air density, wind power, turbine power and power coefficient."""
    rows = load(spark, folder, "events").select(
        "event_id", (F.lit(270) + F.col("user_id") % 40).alias("temp"), (F.col("value") / 20).alias("v"), (F.lit(98000) + F.col("event_id") % 4000).alias("p")
    )
    t, v, p, area = F.col("temp"), F.col("v"), F.col("p"), F.lit(50.0)
    return rows.select(
        "event_id",
        rounded(P.air_density(p, t), 8).alias("density"),
        rounded(P.wind_power(t, v, p, area), 4).alias("power"),
        rounded(P.turbine_power(t, v, p, area, F.lit(0.4)), 4).alias("turbine"),
        rounded(P.power_coefficient(v * v * v * 10, t, v, p, area)).alias("coefficient"),
    )


@query(
    """
    SELECT event_id, round(((1.2 * exp(0.3 * x) - 0.8 * exp(-0.5 * x)) / (0.9 * exp(0.3 * x) + 1.1 * exp(-0.4 * x)) + 0.05) * 2000, 4) + 0.0 AS power
    FROM (SELECT event_id, value / 25.0 AS x FROM events)
    """
)
def hyperbolic_power_curve(spark, folder):
    """Nine-parameter power curve."""
    curve = P.hyperbolic_power_curve(F.col("value"), [1.2, 0.3, 0.8, 0.5, 0.9, 0.3, 1.1, 0.4, 0.05], 25.0, 2000.0)
    return load(spark, folder, "events").select("event_id", rounded(curve, 4).alias("power"))


@query(
    """
    SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6) + 0.0 AS z,
           round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) + 0.0 AS share
    FROM orders
    """
)
def normalised_price(spark, folder):
    """z-score and min-max."""
    orders = load(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("z"), F.col("o_totalprice").alias("share"))
    scaled = R.normalise(R.normalise(orders, ["z"], "std"), ["share"], "minmax")
    return scaled.select("o_orderkey", rounded("z").alias("z"), rounded("share").alias("share"))


@query(
    """
    WITH a AS (SELECT o_orderkey, o_totalprice AS x FROM orders),
    m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q1, median(x) AS q2, quantile_cont(x, 0.75) AS q3 FROM a)
    SELECT o_orderkey, round((x - mu) / sd, 6) + 0.0 AS standard, round((x - q2) / (q3 - q1), 6) + 0.0 AS robust,
           round((x - lo) / (hi - lo) - 0.5, 6) + 0.0 AS minmax
    FROM a, m
    """
)
def fitted_scalers(spark, folder):
    """Scalers fitted once and applied: standard, robust and -0.5 .. 0.5."""
    orders = load(spark, folder, "orders")
    frame = orders.select("o_orderkey", *[F.col("o_totalprice").alias(k) for k in ("standard", "robust", "minmax")])
    for kind in ("standard", "robust", "minmax"):
        frame = R.fit_scaler(frame, [kind], kind).transform(frame)
    return frame.select("o_orderkey", *[rounded(k).alias(k) for k in ("standard", "robust", "minmax")])


@query("SELECT event_id, CASE WHEN value <= 30 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM events")
def binary_labels(spark, folder):
    """Label by a remaining-life threshold."""
    events = load(spark, folder, "events").select("event_id", F.col("value").alias("rul"))
    return R.add_binary_labels(events, 30)


@query(
    """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)
    SELECT event_id, (value > a)::INT + (value > b)::INT + (value > c)::INT AS label FROM events, q
    """
)
def quantile_labels(spark, folder):
    """Equal-frequency classes."""
    return R.add_quantile_labels(load(spark, folder, "events").select("event_id", "value"), "value", 4).select("event_id", F.col("label").cast("int"))


@query(
    """
    SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS local, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS utc FROM events
    """
)
def zone_conversion(spark, folder):
    """UTC to a fixed +8 zone and back."""
    ts = F.col("ts").cast("timestamp")
    return load(spark, folder, "events").select(
        "event_id",
        F.date_format(T.utc_to_zone(ts), "yyyy-MM-dd HH:mm").alias("local"),
        F.date_format(T.zone_to_utc(ts), "yyyy-MM-dd HH:mm").alias("utc"),
    )


LISTS_SQL = """
lists AS (
  SELECT p_partkey, p_type || ', ' || p_brand || ' ,' || p_name || CASE WHEN p_size % 5 = 0 THEN ', Wind Speed Only' WHEN p_size % 5 = 1 THEN ', No Wind Speed' ELSE '' END AS cell
  FROM part)
"""


def part_lists(spark, folder):
    """Comma lists made from part columns."""
    tail = F.when(F.col("p_size") % 5 == 0, ", Wind Speed Only").when(F.col("p_size") % 5 == 1, ", No Wind Speed").otherwise("")
    return load(spark, folder, "part").select(
        "p_partkey", F.concat("p_type", F.lit(", "), "p_brand", F.lit(" ,"), "p_name", tail).alias("cell")
    )


@query(f"WITH {LISTS_SQL} SELECT p_partkey, len(string_split(cell, ',')) AS n_items, trim(unnest(string_split(cell, ','))) AS item FROM lists")
def split_list_cells(spark, folder):
    """Comma lists to trimmed items with the list size."""
    items = part_lists(spark, folder).withColumn("items", X.split_list(F.col("cell")))
    return items.select("p_partkey", F.size("items").cast("long").alias("n_items"), F.explode("items").alias("item"))


@query(
    f"""
    WITH {LISTS_SQL}
    SELECT p_partkey, CASE WHEN contains(cell, 'Wind Speed Only') THEN replace(cell, 'Wind Speed Only', 'Wind Speed')
                           WHEN contains(cell, 'No Wind Speed') THEN cell ELSE cell || ', Wind Speed' END AS cell
    FROM lists
    """
)
def implied_item(spark, folder):
    """An item every list has unless it says otherwise."""
    from seriesmill.catalog.literature import IMPLIED_FEATURE

    return add_implied_feature(part_lists(spark, folder), "cell", **IMPLIED_FEATURE)


@query(
    """
    SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'PROMO' THEN 'cheap' WHEN 'LARGE' THEN 'big' ELSE p_type END AS category,
           CASE p_size % 3 WHEN 0 THEN 'Inflow Direction' WHEN 1 THEN 'Yaw Control' ELSE 'something else' END AS feature
    FROM part
    """
)
def category_mapping(spark, folder):
    """Items to categories; unknown items stay."""
    feature = F.when(F.col("p_size") % 3 == 0, "inflow angle").when(F.col("p_size") % 3 == 1, "yaw angle").otherwise("something else")
    return load(spark, folder, "part").select(
        "p_partkey",
        X.map_values(F.col("p_type"), {"ECONOMY": "cheap", "PROMO": "cheap", "LARGE": "big"}).alias("category"),
        X.map_values(feature, item_to_category(FEATURE_CATEGORIES)).alias("feature"),
    )


@query(
    """
    SELECT p.p_partkey, coalesce(n.n_name, p.p_brand) AS p_brand FROM part p LEFT JOIN nation n ON p.p_brand = 'Brand#' || n.n_nationkey
    """
)
def category_mapping_by_table(spark, folder):
    """The same with a mapping table."""
    mapping = load(spark, folder, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("item"), F.col("n_name").alias("category"))
    return X.map_values_table(load(spark, folder, "part").select("p_partkey", "p_brand"), "p_brand", mapping)


@query(
    """
    SELECT o_orderkey, o_orderstatus AS status, cast(year(o_orderdate) AS VARCHAR) AS year,
           CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'none' END AS fast
    FROM orders
    """
)
def parse_run_names(spark, folder):
    """k=v names to columns; bare parts are flags."""
    name = F.concat(
        F.lit("status="), "o_orderstatus", F.lit("_year="), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "_fast").otherwise("")
    )
    parts = load(spark, folder, "orders").select("o_orderkey", X.parse_name(name).alias("p"))
    return parts.select(
        "o_orderkey",
        F.col("p")["status"].alias("status"),
        F.col("p")["year"].alias("year"),
        F.coalesce(F.try_element_at("p", F.lit("fast")), F.lit("none")).alias("fast"),
    )


@query(
    """
    WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'wind' ELSE 'pv' END AS domain,
                      CASE WHEN s_suppkey % 4 < 2 THEN 'digital_twin' ELSE 'forecast_available' END AS kind, s_suppkey % 7 AS m FROM supplier)
    SELECT s_suppkey, CASE domain WHEN 'wind' THEN 'WT' ELSE 'PV' END || CASE kind WHEN 'digital_twin' THEN '-S1' ELSE '-S2' END AS scenario,
           CASE m WHEN 0 THEN 'CW' || chr(10) || '(FI)' WHEN 1 THEN 'CW' || chr(10) || '(corr.)' WHEN 2 THEN 'CW' || chr(10) || '(rnd.)'
                  WHEN 3 THEN 'SFS' WHEN 4 THEN 'MI' WHEN 5 THEN 'F-value' ELSE 'RF FI' END AS method
    FROM r
    """
)
def scenario_and_method_labels(spark, folder):
    """Display labels of scenario and method."""
    base = load(spark, folder, "supplier").withColumn("m", F.col("s_suppkey") % 7)
    names = {0: "feature_importance", 1: "correlation", 2: "random", 3: "singletons"}
    grouping = F.lit(None).cast("string")
    for number, label in names.items():
        grouping = F.when(F.col("m") == number, label).otherwise(grouping)
    method = F.when(F.col("m") < 4, X.CLUSTERWISE).when(F.col("m") == 4, "mutual_info").when(F.col("m") == 5, "f_value").otherwise("RF_FI")
    domain = F.when(F.col("s_suppkey") % 2 == 0, "wind").otherwise("pv")
    kind = F.when(F.col("s_suppkey") % 4 < 2, "digital_twin").otherwise("forecast_available")
    return base.select(
        "s_suppkey", X.scenario_label(domain, kind).alias("scenario"), X.method_label(method, grouping, X.METHOD_LABELS).alias("method")
    )


@query(
    r"""
    WITH s AS (SELECT l_suppkey, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std, median(l_quantity) AS med,
                      quantile_cont(l_quantity, 0.025) AS lo, quantile_cont(l_quantity, 0.975) AS hi FROM lineitem GROUP BY 1)
    SELECT l_suppkey, printf('$%.3f \pm %.3f$', mean, std) AS plain,
           printf('$\textcolor{%s}{%.3f \pm %.3f}$', CASE WHEN mean - std - 0.0006 > 0 THEN 'darkred' ELSE 'darkgreen' END, mean, std) AS coloured,
           printf('$%.2f\%%\, (\text{95\%% CI}: %.2f\!-\!%.2f\%%)$', med, lo, hi) AS ranged
    FROM s
    """
)
def formatted_numbers(spark, folder):
    """Mean with deviation, median with interval, as text."""
    items = load(spark, folder, "lineitem")
    stats = items.groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("std"))
    spots = quantiles(items, "l_quantity", [0.025, 0.5, 0.975], "l_suppkey", names=["low", "median", "high"])
    return stats.join(spots, "l_suppkey").select(
        "l_suppkey",
        X.value_and_error(F.col("mean"), F.col("std"), 3).alias("plain"),
        X.value_and_error(F.col("mean"), F.col("std"), 3, colour=True).alias("coloured"),
        X.median_and_interval(F.col("median"), F.col("low"), F.col("high"), 0.95).alias("ranged"),
    )


@query(
    """
    SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND regexp_matches(p_name, 'red|blue') AND NOT regexp_matches(p_name, 'ring$')
    """
)
def filter_run_names(spark, folder):
    """Include and exclude patterns plus equality."""
    return filter_runs(load(spark, folder, "part"), "red|blue", "ring$", "p_name", p_type="PROMO").select("p_partkey", "p_name")


@query(
    """
    WITH k AS (SELECT event_id, event_type || '/' || user_id || '/' || (event_id % 3) AS key FROM events)
    SELECT event_id, substr(key, 7) AS below, string_split(key, '/')[2] AS second, string_split(key, '/')[-1] AS last FROM k WHERE starts_with(key, 'error/')
    """
)
def key_paths(spark, folder):
    """Prefix lookup and parts of a key path."""
    key = F.concat_ws("/", "event_type", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string"))
    keyed = load(spark, folder, "events").select("event_id", key.alias("key")).filter(X.under_prefix(F.col("key"), "error"))
    return keyed.select(
        "event_id", F.expr("substring(key, 7)").alias("below"), X.key_part(F.col("key"), 1).alias("second"), X.key_part(F.col("key"), -1).alias("last")
    )


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def nested_key_paths(spark, folder):
    """Flat key-path columns to nested structs and back."""
    flat = load(spark, folder, "nation").select(
        F.col("n_nationkey").alias("id/key"), F.col("n_name").alias("id/name"), F.col("n_regionkey").alias("place/region/key")
    )
    again = X.flatten_struct(X.unflatten_struct(flat))
    return again.select(F.col("`id/key`").alias("n_nationkey"), F.col("`id/name`").alias("n_name"), F.col("`place/region/key`").alias("n_regionkey"))


@query("SELECT p_partkey, round(p_size * p_retailprice, 4) AS area FROM part")
def metadata_product(spark, folder):
    """Product of two metadata columns."""
    return load(spark, folder, "part").select("p_partkey", F.round(P.product(F.col("p_size"), F.col("p_retailprice")), 4).alias("area"))


SUN_TERMS_SQL = """
terms AS (
  SELECT *, 280.46646 + t * (36000.76983 + t * 0.0003032) AS l0raw, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS m,
         0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS ecc, radians(125.04 - 1934.136 * t) AS om
  FROM base),
terms2 AS (
  SELECT *, l0raw - 360 * floor(l0raw / 360) AS l0,
         sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289 AS c,
         radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(om)) AS eps
  FROM terms),
terms3 AS (
  SELECT *, degrees(asin(sin(eps) * sin(radians(l0 + c - 0.00569 - 0.00478 * sin(om))))) AS dec, pow(tan(eps / 2), 2) AS y, radians(l0) AS l FROM terms2),
sun AS (
  SELECT *, 4 * degrees(y * sin(2 * l) - 2 * ecc * sin(m) + 4 * ecc * y * sin(m) * cos(2 * l) - 0.5 * y * y * sin(4 * l) - 1.25 * ecc * ecc * sin(2 * m)) AS eqt
  FROM terms3)
"""


def site_events(spark, folder):
    """Events with a site per user: coordinates and altitude from the user id."""
    user = F.col("user_id")
    return load(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (user % 41 - 20).cast("double").alias("lat"),
        (user % 90 + 80).cast("double").alias("lon"),
        (user % 10 * 100).cast("double").alias("alt"),
        (user % 4 + 2).cast("double").alias("haze"),
        (F.lit(95000) + F.col("event_id") % 6000).cast("double").alias("nwp_pressure"),
        (user % 30 - 5).cast("double").alias("nwp_temperature"),
    )


@query(
    f"""
    WITH base AS (
      SELECT event_id, date_trunc('day', ts) AS day, (user_id % 41 - 20)::DOUBLE AS lat, (user_id % 90 + 80)::DOUBLE AS lon, (user_id % 10 * 100)::DOUBLE AS alt,
             (epoch_us(date_trunc('day', ts) + INTERVAL 12 HOUR) / 86400000000.0 + 2440587.5 - 2451545.0) / 36525.0 AS t
      FROM events),
    {SUN_TERMS_SQL},
    h AS (SELECT *, 720 - 4 * lon - eqt AS noon,
             degrees(acos(cos(radians(90.833 + degrees(acos(6356900.0 / (6356900.0 + alt))))) / (cos(radians(lat)) * cos(radians(dec))) - tan(radians(lat)) * tan(radians(dec)))) AS rise,
             degrees(acos(cos(radians(96.0)) / (cos(radians(lat)) * cos(radians(dec))) - tan(radians(lat)) * tan(radians(dec)))) AS civil
          FROM sun)
    SELECT event_id, round(noon - 4 * civil, 4) + 0.0 AS dawn, round(noon - 4 * rise, 4) + 0.0 AS sunrise, round(noon, 4) + 0.0 AS noon,
           round(noon + 4 * rise, 4) + 0.0 AS sunset, round(noon + 4 * civil, 4) + 0.0 AS dusk
    FROM h
    """
)
def sun_times(spark, folder):
    """Dawn, sunrise, noon, sunset and dusk in minutes after UTC midnight."""
    timed = solar.add_sun_minutes(site_events(spark, folder), F.to_date("ts"), "lat", "lon", "alt")
    return timed.select("event_id", *[rounded(name, 4).alias(name) for name in solar.SUN_TIMES])


POSITION_SQL = f"""
base AS (
  SELECT event_id, ts, (user_id % 41 - 20)::DOUBLE AS lat, (user_id % 90 + 80)::DOUBLE AS lon, (user_id % 10 * 100)::DOUBLE AS alt,
         (user_id % 4 + 2)::DOUBLE AS haze, (95000 + event_id % 6000)::DOUBLE AS p, (user_id % 30 - 5)::DOUBLE AS temp,
         (epoch_us(ts) / 86400000000.0 + 2440587.5 - 2451545.0) / 36525.0 AS t
  FROM events),
{SUN_TERMS_SQL},
a AS (SELECT *, (epoch_us(ts) % 86400000000) / 60000000.0 + eqt + 4 * lon AS tst0 FROM sun),
a2 AS (SELECT *, radians((tst0 - 1440 * floor(tst0 / 1440)) / 4 - 180) AS ha FROM a),
a3 AS (SELECT *, degrees(asin(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(radians(dec)) + cos(radians(lat)) * cos(radians(dec)) * cos(ha))))) AS el,
              degrees(atan2(sin(ha), cos(ha) * sin(radians(lat)) - tan(radians(dec)) * cos(radians(lat)))) + 180 AS az0 FROM a2),
pos AS (SELECT *, az0 - 360 * floor(az0 / 360) AS az,
               el + CASE WHEN el > -0.83 THEN (p / 101000.0) * (283.0 / (273.0 + temp)) * 1.02 / tan(radians(el + 10.3 / (el + 5.11))) / 60 ELSE 0 END AS app FROM a3)
"""


@query(
    f"""
    WITH {POSITION_SQL}
    SELECT event_id, round(90 - app, 4) + 0.0 AS apparent_zenith, round(90 - el, 4) + 0.0 AS zenith, round(app, 4) + 0.0 AS apparent_elevation,
           round(el, 4) + 0.0 AS elevation, round(az, 4) + 0.0 AS azimuth, round(eqt, 4) + 0.0 AS equation_of_time
    FROM pos
    """
)
def sun_position(spark, folder):
    """Zenith, elevation, azimuth and equation of time."""
    placed = solar.add_solar_position(site_events(spark, folder), "ts", "lat", "lon", "nwp_pressure", "nwp_temperature")
    return placed.select("event_id", *[rounded(name, 4).alias(name) for name in solar.POSITION])


@query(
    f"""
    WITH {POSITION_SQL},
    m AS (SELECT *, CASE WHEN 90 - app < 90 THEN 1 / (cos(radians(90 - app)) + 0.50572 * pow(96.07995 - (90 - app), -1.6364)) END AS rel,
                 greatest(cos(radians(90 - app)), 0) AS cz, exp(-alt / 8000) AS f1, exp(-alt / 1250) AS f2,
                 2 * pi() * (dayofyear(ts) - 1) / 365.0 AS b FROM pos),
    m2 AS (SELECT *, rel * 100 * pow((44331.514 - alt) / 11880.516, 1 / 0.1902632) / 101325.0 AS am,
                  1366.1 * (1.00011 + 0.034221 * cos(b) + 0.00128 * sin(b) + 0.000719 * cos(2 * b) + 0.000077 * sin(2 * b)) AS i0 FROM m),
    m3 AS (SELECT *, CASE WHEN am IS NULL THEN 0 ELSE (5.09e-5 * alt + 0.868) * i0 * cz * exp(-(3.92e-5 * alt + 0.0387) * am * (f1 + f2 * (haze - 1))) END AS ghi FROM m2),
    m4 AS (SELECT *, coalesce(least(greatest((0.664 + 0.163 / f1) * exp(-0.09 * am * (haze - 1)) * i0, 0),
                                ghi * greatest(CASE WHEN cz > 0 THEN (1 - (0.1 - 0.2 * exp(-haze)) / (0.1 + 0.882 / f1)) / cz END, 0)), 0) AS dni FROM m3)
    SELECT event_id, coalesce(round(rel, 3), -1) AS airmass_relative, coalesce(round(am, 3), -1) AS airmass_absolute,
           round(ghi, 2) + 0.0 AS ghi, round(CASE WHEN am IS NULL THEN 0 ELSE dni END, 2) + 0.0 AS dni,
           round(ghi - CASE WHEN am IS NULL THEN 0 ELSE dni END * cz, 2) + 0.0 AS dhi
    FROM m4
    """
)
def clear_sky_irradiance(spark, folder):
    """Airmass and clear-sky irradiance."""
    sky = solar.add_sky(site_events(spark, folder), "ts", "lat", "lon", "alt", "haze", "nwp")
    return sky.select(
        "event_id",
        *[F.coalesce(F.round(f"nwp_{c}", 3), F.lit(-1.0)).alias(c) for c in ("airmass_relative", "airmass_absolute")],
        *[rounded(f"nwp_{c}", 2).alias(c) for c in ("ghi", "dni", "dhi")],
    )
