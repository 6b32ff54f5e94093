"""Joins, including the next-event join."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions.timefeat import days_to_event
from seriesmill.operators import joins as J
from seriesmill.operators.leakage import distance_histogram
from seriesmill.operators.ordered import next_event
from seriesmill.queries.registry import load, query, rounded


@query(
    """
    SELECT day, n_orders, n_shipped
    FROM (SELECT o_orderdate AS day, count(*) AS n_orders FROM orders GROUP BY 1)
    JOIN (SELECT l_shipdate AS day, count(*) AS n_shipped FROM lineitem GROUP BY 1) USING (day)
    """
)
def join_two_sources_at_instant(spark, folder):
    """Two readings tables joined on the instant."""
    left = load(spark, folder, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n_orders"))
    right = load(spark, folder, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n_shipped"))
    return J.join_at_instant(left, right, "day")


@query(
    """
    SELECT e.event_id, e.user_id, coalesce(f.event_id, -1) AS error_id,
           CASE WHEN f.ts IS NULL THEN -1 ELSE floor((epoch_us(f.ts) - epoch_us(e.ts)) / 86400000000.0) END AS days_left
    FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') f
      ON e.user_id = f.user_id AND e.ts <= f.ts
    """
)
def next_event_per_asset(spark, folder):
    """The next error of the same user at or after each event, and whole days until then."""
    events = load(spark, folder, "events")
    errors = events.filter(F.col("event_type") == "error").select("user_id", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    joined = next_event(events.select("event_id", "user_id", "ts"), errors, "user_id", "ts", "error_ts", ["error_id"])
    left = days_to_event(F.col("ts"), F.col("error_ts"))
    return joined.select(
        "event_id",
        "user_id",
        F.coalesce("error_id", F.lit(-1)).alias("error_id"),
        F.when(left == float("inf"), -1.0).otherwise(left).alias("days_left"),
    )


@query(
    """
    SELECT e.user_id, count(*) AS n_events, count(*) FILTER (f.ts IS NULL) AS n_without_next
    FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') f
      ON e.user_id = f.user_id AND e.ts <= f.ts
    GROUP BY e.user_id
    """
)
def events_without_next(spark, folder):
    """Events after the last error of their user stay, with no next event."""
    events = load(spark, folder, "events")
    errors = events.filter(F.col("event_type") == "error").select("user_id", F.col("ts").alias("error_ts"))
    joined = next_event(events.select("event_id", "user_id", "ts"), errors, "user_id", "ts", "error_ts")
    return joined.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count(F.when(F.col("error_ts").isNull(), 1)).alias("n_without_next")
    )


@query(
    """
    WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders),
    u AS (SELECT DISTINCT o_custkey, o_orderdate FROM orders)
    SELECT o.o_orderkey, coalesce(strftime(n.o_orderdate, '%Y-%m-%d'), 'none') AS next_day
    FROM o ASOF LEFT JOIN u n ON o.o_custkey = n.o_custkey AND o.o_orderdate + INTERVAL 1 DAY <= n.o_orderdate
    """
)
def next_order_date(spark, folder):
    """The customer's next order on a later day."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    probe = orders.withColumn("from_day", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    later = orders.select("o_custkey", F.col("o_orderdate").alias("next_ts"))
    joined = next_event(probe, later, "o_custkey", "from_day", "next_ts", chunk_seconds=90 * 86_400)
    return joined.select("o_orderkey", F.coalesce(F.date_format("next_ts", "yyyy-MM-dd"), F.lit("none")).alias("next_day"))


@query(
    """
    WITH f AS (SELECT user_id, ts FROM events WHERE event_type = 'error'),
    j AS (SELECT e.event_id, e.user_id, e.ts, f.ts AS fts FROM events e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts <= f.ts),
    r AS (SELECT *, CASE WHEN fts IS NULL THEN 'inf'::DOUBLE ELSE floor((epoch_us(fts) - epoch_us(ts)) / 86400000000.0) END AS rul FROM j)
    SELECT event_id, coalesce(CASE WHEN rul < 1e9 THEN rul END, -1.0) AS rul_or_minus_one, rul < 2 AS impending_failure FROM r
    """
)
def next_failure_with_horizon(spark, folder):
    """Remaining days to the next failure of the year and the imminent-failure flag."""
    events = load(spark, folder, "events")
    failures = events.filter(F.col("event_type") == "error").select("user_id", "ts", F.col("props").alias("Remarks"))
    joined = J.attach_next_failure(events.select("event_id", "user_id", "ts"), failures, "user_id", "ts", horizon_days=2)
    shown = F.when(F.col("rul") < 1e9, F.col("rul")).otherwise(-1.0)
    return joined.select("event_id", shown.alias("rul_or_minus_one"), "impending_failure")


@query(
    """
    SELECT o.o_orderkey, count(*) AS n_later, round(sum(l.l_quantity), 2) AS quantity
    FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND o.o_orderdate <= l.l_shipdate GROUP BY 1
    """
)
def join_with_inequality(spark, folder):
    """Equi-join with an order condition."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    items = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_quantity")
    joined = J.join_before(orders, items, "o_orderkey", F.col("o_orderdate") <= F.col("l_shipdate"))
    return joined.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_later"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    """
    SELECT o.o_orderkey, coalesce(s.n, 0) AS n_items FROM orders o
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) s ON o.o_orderkey = s.l_orderkey
    """
)
def attach_back(spark, folder):
    """Left join that keeps every reading."""
    counts = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = J.attach(load(spark, folder, "orders").select("o_orderkey"), counts, "o_orderkey")
    return joined.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_items"))


@query("SELECT c_custkey, n_name, coalesce(n_regionkey, -1) AS n_regionkey FROM customer LEFT JOIN nation ON CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey END = n_nationkey")
def attach_metadata(spark, folder):
    """Dimension columns on every reading; readings without a key stay."""
    key = F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey"))
    customers = load(spark, folder, "customer").select("c_custkey", key.alias("n_nationkey"))
    return J.attach_dimension(customers, load(spark, folder, "nation"), "n_nationkey").select("c_custkey", "n_name", F.coalesce("n_regionkey", F.lit(-1)).alias("n_regionkey"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7")
def metadata_of_one_asset(spark, folder):
    """The metadata row of one asset."""
    return J.dimension_row(load(spark, folder, "nation"), "n_nationkey", 7)


@query(
    """
    WITH a AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events WHERE user_id = 3),
    b AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events WHERE user_id = 5)
    SELECT strftime(min(h), '%Y-%m-%d %H') AS start, strftime(max(h), '%Y-%m-%d %H') AS "end" FROM a JOIN b USING (h)
    """
)
def common_time_span(spark, folder):
    """First and last instant two assets share."""
    events = load(spark, folder, "events").withColumn("h", F.date_trunc("hour", "ts"))
    span = J.time_overlap(events, "user_id", "h", 3, 5)
    return span.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), F.date_format("end", "yyyy-MM-dd HH").alias("end"))


@query(
    """
    WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) FILTER (event_id % 3 = 0) AS te, count(*) FILTER (event_id % 3 <> 0) AS tr
               FROM events GROUP BY 1, 2)
    SELECT a.event_type, date_diff('day', a.day, b.day) AS days, cast(sum(a.te * b.tr) AS DOUBLE) AS pairs
    FROM d a JOIN d b USING (event_type) GROUP BY 1, 2 HAVING sum(a.te * b.tr) > 0
    """
)
def pair_distances(spark, folder):
    """How many test/train pairs of a group lie how many days apart, without forming pairs."""
    days = load(spark, folder, "events").withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    test, train = days.filter(F.col("event_id") % 3 == 0), days.filter(F.col("event_id") % 3 != 0)
    return distance_histogram(test, train, "day", "event_type")


@query(
    """
    WITH r AS (SELECT l_suppkey % 5 AS model, l_linenumber AS n_features, l_returnflag AS kind, round(avg(l_extendedprice), 4) AS runtime
               FROM lineitem GROUP BY 1, 2, 3)
    SELECT b.model, b.n_features, b.kind, coalesce(o.runtime, -1) AS runtime_ours, b.runtime AS runtime_baseline
    FROM (SELECT * FROM r WHERE kind = 'A' AND n_features < 5) o RIGHT JOIN (SELECT * FROM r WHERE kind <> 'A') b
      ON o.model = b.model AND o.n_features = b.n_features
    """
)
def ours_against_baseline(spark, folder):
    """Right join of one method's runs with the baseline's."""
    runs = load(spark, folder, "lineitem").groupBy(
        (F.col("l_suppkey") % 5).alias("model"), F.col("l_linenumber").alias("n_features"), F.col("l_returnflag").alias("kind")
    ).agg(rounded(F.avg("l_extendedprice"), 4).alias("runtime"))
    ours = runs.filter((F.col("kind") == "A") & (F.col("n_features") < 5)).drop("kind")
    joined = J.compare_runs(ours, runs.filter(F.col("kind") != "A"), ["model", "n_features"], "right")
    return joined.withColumnRenamed("kind_baseline", "kind").withColumn("runtime_ours", F.coalesce("runtime_ours", F.lit(-1.0)))


@query("SELECT o_orderkey, o_totalprice, round(o_totalprice / 1000, 6) + 0.0 AS thousands, year(o_orderdate) AS year FROM orders")
def derived_columns(spark, folder):
    """Derived columns side by side; no join."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return J.add_columns(orders, thousands=rounded(F.col("o_totalprice") / 1000), year=F.year("o_orderdate").cast("long")).drop("o_orderdate")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def absent_keys(spark, folder):
    """Keys that have no match."""
    ids = load(spark, folder, "orders").filter(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey"))
    return J.members(load(spark, folder, "customer").select("c_custkey"), ids, "c_custkey", present=False)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def present_keys(spark, folder):
    """Keys that have a match."""
    ids = load(spark, folder, "orders").filter(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey"))
    return J.members(load(spark, folder, "customer").select("c_custkey"), ids, "c_custkey")
