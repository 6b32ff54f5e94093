"""Literature-table counts on comma lists made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import literature as L
from seriesmill.queries.registry import load, query, rounded
from seriesmill.queries.scalars import LISTS_SQL, part_lists

MAPPING = {"ECONOMY": "Cheap", "PROMO": "Cheap", "Wind Speed Only": "Wind", "No Wind Speed": "Wind"}
MAP_SQL = "CASE item WHEN 'ECONOMY' THEN 'Cheap' WHEN 'PROMO' THEN 'Cheap' WHEN 'Wind Speed Only' THEN 'Wind' WHEN 'No Wind Speed' THEN 'Wind' ELSE item END"
ITEMS_SQL = f"{LISTS_SQL}, items AS (SELECT DISTINCT p_partkey, trim(unnest(string_split(cell, ','))) AS item FROM lists)"


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_type <> 'PROMO' AND p_retailprice < 1500")
def inclusion_criteria(spark, folder):
    """Papers that meet three boolean criteria."""
    part = load(spark, folder, "part").select(
        "p_partkey", (F.col("p_size") > 10).alias("No Survey"), (F.col("p_type") != "PROMO").alias("Results"), (F.col("p_retailprice") < 1500).alias("Full Text")
    )
    return L.included_papers(part, ["No Survey", "Results", "Full Text"]).select("p_partkey")


@query("SELECT round(100.0 * count(*) FILTER (p_type IN ('PROMO', 'ECONOMY')) / count(*), 6) AS percent FROM part")
def availability_share(spark, folder):
    """Share of papers with an accepted answer."""
    return L.availability(load(spark, folder, "part"), "p_type", ["PROMO", "ECONOMY"]).withColumn("percent", rounded("percent"))


@query(
    f"""
    WITH {ITEMS_SQL}, m AS (SELECT DISTINCT p_partkey, {MAP_SQL} AS item FROM items), c AS (SELECT item, count(*) AS n FROM m GROUP BY 1)
    SELECT CASE WHEN n = 1 THEN 'Others' ELSE item END AS item, cast(sum(n) AS BIGINT) AS count FROM c GROUP BY 1
    """
)
def category_frequencies(spark, folder):
    """Papers per category, single ones folded."""
    return L.category_counts(part_lists(spark, folder), "p_partkey", "cell", MAPPING)


@query(
    f"""
    WITH {ITEMS_SQL}, s AS (SELECT DISTINCT p_partkey, CASE item WHEN 'ECONOMY' THEN 'Eco.' WHEN 'Brand#1' THEN 'B1' ELSE item END AS item FROM items)
    SELECT item, count(*) AS count FROM s WHERE item <> 'PROMO' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
    """
)
def top_items_with_short_names(spark, folder):
    """Ten most used items under short names."""
    return L.top_items(part_lists(spark, folder), "p_partkey", "cell", {"ECONOMY": "Eco.", "Brand#1": "B1"}, 10, without=["PROMO"])


@query(
    f"""
    WITH {ITEMS_SQL}
    SELECT CASE WHEN item IN ('ECONOMY', 'PROMO') THEN 'Cheap' ELSE 'Wind' END AS category, item, count(*) AS count FROM items
    WHERE item IN ('ECONOMY', 'PROMO', 'Wind Speed Only', 'No Wind Speed') GROUP BY 1, 2
    """
)
def category_members(spark, folder):
    """Item counts inside chosen categories."""
    categories = {"Cheap": ["ECONOMY", "PROMO"], "Wind": ["Wind Speed Only", "No Wind Speed"], "Unused": ["LARGE"]}
    return L.members_of(part_lists(spark, folder), "p_partkey", "cell", categories, ["Cheap", "Wind"])


@query(f"WITH {ITEMS_SQL} SELECT n_items, count(*) AS n_papers FROM (SELECT p_partkey, count(*) AS n_items FROM items GROUP BY 1) GROUP BY 1")
def items_per_paper(spark, folder):
    """How many papers use how many items."""
    return L.usage_distribution(part_lists(spark, folder), "p_partkey", "cell")
