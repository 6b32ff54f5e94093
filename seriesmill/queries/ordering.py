"""Lags, positions, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import ordered as O
from seriesmill.operators import sets as S
from seriesmill.operators.aggregates import best_row, group_top, value_counts
from seriesmill.operators.clock import repair_repeated_hour
from seriesmill.operators.split import first_match
from seriesmill.queries.registry import load, query, rounded


@query(
    """
    SELECT event_id, coalesce(lag(value, 1) OVER w, -1) AS value_lag_1, coalesce(lag(value, 2) OVER w, -1) AS value_lag_2
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """
)
def lagged_values(spark, folder):
    """Lags per user without sorting a user in one task."""
    events = load(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    lagged = O.add_lags(events, [1, 2], "value", "user_id", "ts", ["event_id"])
    return lagged.select("event_id", *[F.coalesce(f"value_lag_{k}", F.lit(-1.0)).alias(f"value_lag_{k}") for k in (1, 2)])


@query(
    """
    SELECT event_id, value AS step0, coalesce(lag(value, 1) OVER w, -1) AS step1, coalesce(lag(value, 3) OVER w, -1) AS step2,
           user_id % 7 AS other0, 3 AS n_steps
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """
)
def lagged_tensor(spark, folder):
    """Arrays of shape (steps, features) per row."""
    events = load(spark, folder, "events").select("event_id", "user_id", "ts", "value", (F.col("user_id") % 7).alias("other"))
    series = O.lagged_series(events, [1, 3], ["value", "other"], "user_id", "ts", ["event_id"])
    at = [F.coalesce(F.col("series")[i][0], F.lit(-1.0)).alias(f"step{i}") for i in range(3)]
    return series.select("event_id", *at, F.col("series")[0][1].cast("long").alias("other0"), F.size("series").alias("n_steps"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id) AS top FROM events")
def group_maximum(spark, folder):
    """The group maximum on every row: aggregate and join, not a window over a group."""
    events = load(spark, folder, "events").select("event_id", "user_id", "value")
    return group_top(events, "user_id", "value", "top").select("event_id", "top")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1
    """
)
def keep_first_of_copies(spark, folder):
    """The first row of each key."""
    items = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return O.first_in_group(items, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query(
    """
    SELECT o_custkey, cast(sum(n) AS BIGINT) AS n_rows, count(*) AS n_instants, cast(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_repeated
    FROM (SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1
    """
)
def repeated_instants(spark, folder):
    """Instants that occur more than once in a group."""
    return O.order_violations(load(spark, folder, "orders"), "o_custkey", "o_orderdate")


@query(
    """
    WITH s AS (SELECT l_suppkey, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY 1), t AS (SELECT unnest(range(0, 31)) AS slot)
    SELECT l_suppkey, strftime(TIMESTAMP '2016-10-30 00:00:00' + to_minutes(10 * slot), '%Y-%m-%d %H:%M') AS at,
           round(q + slot, 4) AS a, round(q * 2 - slot * 0.5, 4) AS b
    FROM s, t
    """
)
def repair_clock_change(spark, folder):
    """Readings whose hour 01:00 was recorded as a second 02:00 return to the regular grid."""
    base = load(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 4).alias("q"))
    slots = base.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(30))))
    late = F.when(F.col("slot").between(6, 11), 60).otherwise(0)
    recorded = F.to_timestamp(F.lit("2016-10-30 00:00:00")) + F.make_dt_interval(mins=F.col("slot") * 10 + late)
    readings = slots.select(
        "l_suppkey", recorded.alias("ts"), (F.col("q") + F.col("slot")).alias("a"), (F.col("q") * 2 - F.col("slot") * 0.5).alias("b")
    )
    fixed = repair_repeated_hour(readings, "l_suppkey", "ts", ["a", "b"])
    return fixed.select("l_suppkey", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), rounded("a", 4).alias("a"), rounded("b", 4).alias("b"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def sorted_positions(spark, folder):
    """Sort order as a dense position, counted per day and added up."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return O.row_index(orders, [F.col("o_orderdate"), F.col("o_orderkey")], [F.col("o_orderdate")], name="position").drop("o_orderdate")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC")
def sorted_rows(spark, folder):
    """Global sort."""
    customers = load(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return S.sort_rows(customers, ["c_acctbal", "c_custkey"], ascending=False)


@query("SELECT p_name, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def ten_most_frequent(spark, folder):
    """Top-10 values."""
    return S.top_values(value_counts(load(spark, folder, "part"), "p_name"), "p_name", 10)


@query(
    """
    SELECT c_nationkey, c_mktsegment, c_custkey, c_acctbal FROM (
      SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1
    """
)
def best_per_group(spark, folder):
    """The best row of each group."""
    customers = load(spark, folder, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")
    return best_row(customers, ["c_nationkey", "c_mktsegment"], "c_acctbal", ["c_custkey"], largest=True)


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey DESC LIMIT 7")
def select_k_best(spark, folder):
    """The k highest scores; later positions win ties."""
    scores = load(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    return S.select_k_best(scores, 7, "s_acctbal", "s_suppkey")


@query(
    """
    SELECT a.s_suppkey, a.s_acctbal > b.s_acctbal AS better_max, a.s_acctbal < b.s_acctbal AS better_min,
           abs(a.s_acctbal - 5000) < abs(b.s_acctbal - 5000) AS closer
    FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
    """
)
def better_than_neighbour(spark, folder):
    """Comparison under max, min and closeness to a number."""
    supplier = load(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    other = supplier.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_acctbal").alias("other"))
    x, y = F.col("s_acctbal"), F.col("other")
    return supplier.join(other, "s_suppkey").select(
        "s_suppkey",
        S.is_better(x, y, "max").alias("better_max"),
        S.is_better(x, y, "min").alias("better_min"),
        S.is_better(x, y, 5000.0).alias("closer"),
    )


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 15 OFFSET 5")
def run_list_slice(spark, folder):
    """A slice of an ordered run list."""
    return S.list_runs(load(spark, folder, "supplier").select("s_suppkey", "s_name"), "s_suppkey", start=5, end=20, limit=50)


@query(
    """
    SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier
    """
)
def stacked_frames(spark, folder):
    """Vertical concatenation."""
    return S.stack(
        load(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")),
        load(spark, folder, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")),
    )


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def id_set_difference(spark, folder):
    """Set difference of ids."""
    ids = load(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    return S.id_difference(ids, load(spark, folder, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("id")), "id")


@query(
    """
    WITH s AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 40) AS a, list(DISTINCT event_type) FILTER (value < 20) AS b FROM events GROUP BY 1)
    SELECT user_id, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS similarity
    FROM s WHERE a IS NOT NULL AND b IS NOT NULL
    """
)
def set_similarity(spark, folder):
    """Shared share of two sets."""
    sets = load(spark, folder, "events").groupBy("user_id").agg(
        F.collect_set(F.when(F.col("value") > 40, F.col("event_type"))).alias("a"),
        F.collect_set(F.when(F.col("value") < 20, F.col("event_type"))).alias("b"),
    )
    present = sets.filter((F.size("a") > 0) & (F.size("b") > 0))
    return present.select("user_id", rounded(S.jaccard(F.col("a"), F.col("b"))).alias("similarity"))


@query(
    """
    SELECT event_id, CASE WHEN value <= 30 THEN 'low' WHEN value >= 20 AND value <= 80 THEN 'middle' WHEN value >= 70 THEN 'high' END AS part FROM events
    """
)
def first_split_wins(spark, folder):
    """Overlapping parts: a row belongs to the first that holds it."""
    value = F.col("value")
    part = first_match([("low", value <= 30), ("middle", (value >= 20) & (value <= 80)), ("high", value >= 70)])
    return load(spark, folder, "events").select("event_id", part.alias("part"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_owner_items(spark, folder):
    """Distinct (owner, item) pairs."""
    return S.distinct_pairs(load(spark, folder, "lineitem"), "l_suppkey", "l_returnflag")


@query("SELECT p_name, row_number() OVER (ORDER BY md5(p_name || '|42'), p_name) - 1 AS position FROM (SELECT DISTINCT p_name FROM part)")
def shuffled_names(spark, folder):
    """A reproducible random order."""
    return S.shuffled_positions(load(spark, folder, "part").select("p_name").distinct(), "p_name", 42).withColumn("position", F.col("position").cast("long"))
