"""Splits, regular grids, remaining life and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.catalog import wind
from seriesmill.functions.timefeat import add_cyclical_encodings, day_of_year, days_to_event, minute_of_day
from seriesmill.operators import reshape as R
from seriesmill.operators.ordered import next_event
from seriesmill.operators.split import describe_splits, split_by_time, split_head_tail
from seriesmill.queries.registry import load, query, rounded

DAY = 86_400

SPLIT_SQL = """
span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) - min(epoch_us(ts)) AS total FROM events),
placed AS (SELECT e.*, epoch_us(ts) - lo AS offs, total FROM events e, span),
split AS (
  SELECT *, CASE WHEN offs <= total * 0.75 - 43200000000.0 THEN 'train'
                 WHEN offs >= total * 0.75 + 43200000000.0 THEN 'test' END AS split
  FROM placed)
"""


@query(
    f"""
    WITH {SPLIT_SQL},
    j AS (SELECT e.event_id, e.split, e.ts, dayofyear(e.ts) AS doy, hour(e.ts) * 60 + minute(e.ts) AS mod, f.ts AS next_ts
          FROM split e ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'error') f ON e.user_id = f.user_id AND e.ts <= f.ts
          WHERE e.split IS NOT NULL)
    SELECT split, count(*) AS n_rows, count(next_ts) AS n_with_next,
           round(avg(floor((epoch_us(next_ts) - epoch_us(ts)) / 86400000000.0)), 6) AS mean_days_left,
           cast(sum(CASE WHEN (epoch_us(next_ts) - epoch_us(ts)) / 86400000000.0 < 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_imminent,
           round(avg(sin(2 * pi() * (doy - 1) / 365.0)), 6) + 0.0 AS mean_day_sin, round(avg(cos(2 * pi() * mod / 1439.0)), 6) + 0.0 AS mean_minute_cos
    FROM j GROUP BY split
    """
)
def failure_horizon_by_split(spark, folder):
    """Time features, next error per user, days left, split with a one-day gap, summary per split."""
    events = load(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    errors = events.filter(F.col("event_type") == "error").select("user_id", F.col("ts").alias("error_ts"))
    timed = events.select(
        "event_id", "user_id", "ts", day_of_year(F.col("ts")).alias("DayOfYear"), minute_of_day(F.col("ts")).alias("MinuteOfDay")
    )
    encoded = add_cyclical_encodings(timed, ["DayOfYear", "MinuteOfDay"], wind.CYCLIC_RANGES)
    split = split_by_time(encoded, "ts", (0.75, 0.25), DAY).filter(F.col("split").isNotNull())
    joined = next_event(split, errors, "user_id", "ts", "error_ts")
    days = days_to_event(F.col("ts"), F.col("error_ts"))
    return joined.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("error_ts").alias("n_with_next"),
        rounded(F.avg(F.when(F.col("error_ts").isNotNull(), days))).alias("mean_days_left"),
        F.sum((days < 1).cast("long")).alias("n_imminent"),
        rounded(F.avg("DayOfYear_sin")).alias("mean_day_sin"),
        rounded(F.avg("MinuteOfDay_cos")).alias("mean_minute_cos"),
    )


@query(f"WITH {SPLIT_SQL} SELECT event_id, coalesce(split, 'gap') AS split FROM split")
def split_with_gap(spark, folder):
    """Train and test parts around a gap of one day."""
    split = split_by_time(load(spark, folder, "events"), "ts", (0.75, 0.25), DAY)
    return split.select("event_id", F.coalesce("split", F.lit("gap")).alias("split"))


@query(
    """
    WITH s AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) - min(epoch_us(ts)) AS total FROM events),
    p AS (SELECT ts, epoch_us(ts) - lo AS o, total FROM events, s),
    q AS (SELECT ts, CASE WHEN o <= total * 0.6 THEN 'train' WHEN o <= total * 0.8 THEN 'val' ELSE 'test' END AS split FROM p)
    SELECT split, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n_rows FROM q GROUP BY 1
    """
)
def describe_three_way_split(spark, folder):
    """Three parts without a gap: span and size."""
    split = split_by_time(load(spark, folder, "events"), "ts", (0.6, 0.2, 0.2))
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")}
    return describe_splits(split, "ts").withColumns(shown)


@query(
    """
    SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
    """
)
def head_and_tail(spark, folder):
    """Ordered split by row count."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return split_head_tail(orders, [F.col("o_orderdate"), F.col("o_orderkey")], [F.col("o_orderdate")], 0.8).select("o_orderkey", "split")


@query(
    """
    WITH d AS (SELECT user_id || '/' || event_type AS series, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
    r AS (SELECT series, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
    g AS (SELECT series, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM r)
    SELECT g.series, strftime(g.day, '%Y-%m-%d') AS day, coalesce(d.n, -1) AS n FROM g LEFT JOIN d USING (series, day)
    """
)
def fill_missing_days(spark, folder):
    """A row per series (user and event type) and day between first and last."""
    series = F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("series")
    daily = load(spark, folder, "events").groupBy(series, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    filled = R.fill_gaps(daily, "day", "series")
    return filled.select("series", F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(-1)).alias("n"))


def _asset_days(spark, folder):
    return load(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("serial_number"), F.col("ts").alias("date"), ((F.col("event_type") == "error") & (F.col("value") > 120)).alias("failure")
    )


RUL_SQL = """
a AS (SELECT user_id, max(ts) AS last, bool_or(event_type = 'error' AND value > 120) AS failed FROM events GROUP BY 1),
rul AS (SELECT event_id, failed, floor((epoch_us(last) - epoch_us(ts)) / 86400000000.0) + 1 AS rul FROM events JOIN a USING (user_id))
"""


@query(f"WITH {RUL_SQL} SELECT event_id, CASE WHEN failed THEN rul ELSE -1 END AS rul FROM rul")
def remaining_life(spark, folder):
    """Days until an asset's last record; unlimited for assets that never failed."""
    rul = R.add_rul(_asset_days(spark, folder))
    return rul.select("event_id", F.when(F.col("rul") == float("inf"), -1.0).otherwise(F.col("rul")).alias("rul"))


@query(
    f"""
    WITH {RUL_SQL} SELECT event_id, CASE WHEN NOT failed THEN -1 ELSE least(rul, 10) END AS rul, CASE WHEN failed AND least(rul, 10) <= 7 THEN 1.0 ELSE 0.0 END::DOUBLE AS label
    FROM rul WHERE NOT failed OR rul <= 20
    """
)
def capped_remaining_life(spark, folder):
    """Horizon and cap for failing assets only, then labels."""
    rul = R.add_binary_labels(R.add_rul(_asset_days(spark, folder), max_rul=20, cap=10), 7, keep_rul=True)
    return rul.select("event_id", F.when(F.col("rul") == float("inf"), -1.0).otherwise(F.col("rul")).alias("rul"), "label")


@query(
    """
    WITH a AS (SELECT user_id, bool_or(event_type = 'error' AND value > 120) AS failed FROM events GROUP BY 1)
    SELECT event_id, user_id AS serial_number FROM events JOIN a USING (user_id)
    WHERE failed OR ('0x' || substr(md5(user_id || '|' || 42), 1, 8))::BIGINT / 4294967296.0 < 0.3
    """
)
def sampled_healthy_assets(spark, folder):
    """All failing assets and a hashed share of the healthy ones."""
    return R.add_rul(_asset_days(spark, folder), healthy_sample=0.3, seed=42).select("event_id", "serial_number")
