"""Counts over review tables with comma-list cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.text import append_when_absent, map_values, split_list
from seriesmill.operators.aggregates import fold_rare, percent_true, value_counts
from seriesmill.operators.sets import top_values


def included_papers(df: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """Papers that meet every boolean criterion."""
    keep = F.lit(True)
    for name in criteria:
        keep = keep & F.col(f"`{name}`")
    return df.filter(keep)


def availability(df: DataFrame, column: str, accepted: Sequence[str]) -> DataFrame:
    """Percentage of papers whose cell is one of the accepted answers."""
    return df.agg(percent_true(F.col(f"`{column}`").isin(list(accepted))).alias("percent"))


def add_implied_feature(df: DataFrame, column: str, item: str, only: str, without: str) -> DataFrame:
    return df.withColumn(column, append_when_absent(F.col(f"`{column}`"), item=item, only=only, without=without))


def listed_items(df: DataFrame, paper: str, column: str, item: str = "item") -> DataFrame:
    """Distinct (paper, item) pairs of a comma-list column."""
    return df.select(paper, F.explode(split_list(F.col(f"`{column}`"))).alias(item)).distinct()


def category_counts(df: DataFrame, paper: str, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Papers per category; categories with a single paper are added up as ``Others``."""
    pairs = listed_items(df, paper, column)
    mapped = pairs.withColumn("item", map_values(F.col("item"), mapping)).distinct()
    return fold_rare(value_counts(mapped, "item"), "item")


def top_items(df: DataFrame, paper: str, column: str, short: Mapping[str, str], k: int = 10, without: Sequence[str] = ()) -> DataFrame:
    """The k items most papers use, under their short names."""
    pairs = df.select(paper, F.explode(split_list(F.col(f"`{column}`"))).alias("item"))
    named = pairs.withColumn("item", map_values(F.col("item"), short))
    if without:
        named = named.filter(~F.col("item").isin(list(without)))
    return top_values(value_counts(named.distinct(), "item"), "item", k)


def members_of(df: DataFrame, paper: str, column: str, categories: Mapping[str, Sequence[str]], wanted: Sequence[str]) -> DataFrame:
    """``category, item, count`` for the items of the wanted categories."""
    mapping = {item: name for name in wanted for item in categories[name]}
    pairs = listed_items(df, paper, column).filter(F.col("item").isin(list(mapping)))
    return pairs.groupBy(map_values(F.col("item"), mapping).alias("category"), "item").agg(F.count(F.lit(1)).alias("count"))


def usage_distribution(df: DataFrame, paper: str, column: str) -> DataFrame:
    """How many papers use how many distinct items."""
    per_paper = listed_items(df, paper, column).groupBy(paper).agg(F.count(F.lit(1)).alias("n_items"))
    return per_paper.groupBy("n_items").agg(F.count(F.lit(1)).alias("n_papers"))
