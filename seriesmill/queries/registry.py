"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.session import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql.strip()
        return function

    return register


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounded, with a plain zero instead of a negative one."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits) + F.lit(0.0)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


def with_holes(lineitem: DataFrame) -> DataFrame:
    """Line items in which every seventh discount is missing and tax is missing for one line number."""
    return lineitem.withColumns(
        {
            "l_discount": F.when(F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(7)) != 0, F.col("l_discount")),
            "l_tax": F.when(F.col("l_linenumber") != 3, F.col("l_tax")),
        }
    )


HOLES_SQL = """
holes AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN l_discount END AS l_discount,
         CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax,
         l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)
"""
