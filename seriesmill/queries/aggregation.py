"""Grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import aggregates as A
from seriesmill.queries.registry import load, query, rounded


@query(
    """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem)
    WHERE rn = 1
    """
)
def cheapest_item_per_supplier(spark, folder):
    """The row with the group minimum; ties by key."""
    items = load(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return A.best_row(items, "l_suppkey", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    """
    SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std,
           min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, round(var_samp(l_quantity), 4) AS l_quantity_var
    FROM lineitem GROUP BY 1
    """
)
def column_moments(spark, folder):
    """mean, std, min, max and variance."""
    found = A.moments(load(spark, folder, "lineitem"), ["l_quantity"], "l_returnflag")
    return found.withColumns(
        {
            "l_quantity_mean": rounded("l_quantity_mean"),
            "l_quantity_std": rounded("l_quantity_std"),
            "l_quantity_var": rounded("l_quantity_var", 4),
        }
    )


@query(
    """
    SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS std,
           min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 3) AS q25, round(quantile_cont(l_extendedprice, 0.5), 3) AS q50,
           round(quantile_cont(l_extendedprice, 0.75), 3) AS q75, max(l_extendedprice) AS max
    FROM lineitem GROUP BY 1
    """
)
def describe_per_station(spark, folder):
    """Summary with exact quartiles."""
    found = A.describe(load(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag")
    return found.withColumns({c: rounded(c, 3) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    """
    SELECT l_returnflag, 'min' AS mode, round(min(l_extendedprice), 3) AS value FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'max', round(max(l_extendedprice), 3) FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'avg', round(avg(l_extendedprice), 3) FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'median', round(median(l_extendedprice), 3) FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'p=95', round(quantile_cont(l_extendedprice, 0.95), 3) FROM lineitem GROUP BY 1
    """
)
def aggregation_modes(spark, folder):
    """min, max, avg, median and a percentile."""
    items = load(spark, folder, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("value"))
    parts = [
        A.aggregate_values(items, "value", mode, "l_returnflag").select("l_returnflag", F.lit(mode).alias("mode"), rounded("value", 3).alias("value"))
        for mode in ("min", "max", "avg", "median", "p=95")
    ]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


@query(
    """
    SELECT l_returnflag, l_linestatus, round(median(l_discount), 6) AS discount FROM lineitem GROUP BY 1, 2
    """
)
def median_per_group(spark, folder):
    """Median per combination of keys."""
    return A.aggregate_values(load(spark, folder, "lineitem"), "l_discount", "median", ["l_returnflag", "l_linestatus"]).select(
        "l_returnflag", "l_linestatus", rounded("l_discount").alias("discount")
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, round(list_avg(v), 9) AS mean, round(list_stddev_pop(v), 8) AS std
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, [l_quantity, l_discount * 100, l_tax * 100, l_extendedprice / 1000] AS v FROM lineitem)
    """
)
def list_cell_statistics(spark, folder):
    """Mean and population deviation of list cells."""
    cells = F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_extendedprice") / 1000)
    stats = A.list_statistics(cells)
    return load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(stats["mean"], 9).alias("mean"), rounded(stats["std"], 8).alias("std")
    )


@query(
    """
    SELECT l_returnflag, round(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / sum(l_quantity), 8) AS ratio FROM lineitem GROUP BY 1
    """
)
def ratio_of_sums(spark, folder):
    """A share as a ratio of two sums."""
    items = load(spark, folder, "lineitem").withColumn("hit", (F.col("l_discount") > 0.05).cast("int"))
    return A.ratio_of_sums(items, "hit", "l_quantity", "l_returnflag").withColumn("ratio", rounded("ratio", 8))


@query(
    """
    WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1)
    SELECT CASE WHEN n = 1 THEN 'Others' ELSE p_name END AS p_name, cast(sum(n) AS BIGINT) AS count FROM c GROUP BY 1
    """
)
def value_counts_with_others(spark, folder):
    """Value counts with single values folded."""
    return A.fold_rare(A.value_counts(load(spark, folder, "part"), "p_name"), "p_name")


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice > 200000 THEN 100.0 ELSE 0.0 END), 6) AS percent FROM orders GROUP BY 1")
def percent_meeting_condition(spark, folder):
    """Share of rows in percent."""
    return load(spark, folder, "orders").groupBy("o_orderpriority").agg(rounded(A.percent_true(F.col("o_totalprice") > 200000)).alias("percent"))


@query(
    """
    SELECT cast(n AS BIGINT) AS size, count(*) AS count FROM (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) GROUP BY 1
    """
)
def list_size_histogram(spark, folder):
    """How many rows have a list of each size."""
    lists = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("v"))
    return A.size_histogram(lists, "v").withColumn("size", F.col("size").cast("long"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY 1")
def distinct_per_group(spark, folder):
    """Exact distinct count per group."""
    return A.distinct_count(load(spark, folder, "lineitem"), "l_partkey", "l_returnflag")


@query(
    """
    SELECT 'status' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'year', cast(year(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'total', '', count(*) FROM orders
    """
)
def run_counts_by_dimension(spark, folder):
    """Counts along several dimensions in one pass."""
    orders = load(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    return A.counts_by(orders, {"status": "o_orderstatus", "priority": "o_orderpriority", "year": "year"})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, folder):
    """Keys that occur more than once."""
    return A.repeated_keys(load(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """
    WITH q AS (SELECT l_returnflag, count(l_quantity) AS n, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median,
                      quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1)
    SELECT l_returnflag, any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
           min(l_quantity) FILTER (l_quantity >= q1 - 1.5 * (q3 - q1) AND l_quantity <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
           max(l_quantity) FILTER (l_quantity >= q1 - 1.5 * (q3 - q1) AND l_quantity <= q3 + 1.5 * (q3 - q1)) AS whisker_high
    FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1
    """
)
def box_plot_statistics(spark, folder):
    """Quartiles and whiskers."""
    return A.box_statistics(load(spark, folder, "lineitem"), "l_quantity", "l_returnflag")
