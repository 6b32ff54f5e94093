"""Writers for result tables and run lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_results(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Persist a results table as Parquet."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def run_lines(runs: DataFrame, name: str = "name", index: str = "position") -> DataFrame:
    """``0007 run-name`` lines in list order."""
    return runs.orderBy(index).select(F.concat(F.lpad(F.col(index).cast("string"), 4, "0"), F.lit(" "), F.col(name)).alias("value"))


def export_runs(runs: DataFrame, path: str, fmt: str) -> None:
    """Write a run list as ``txt``, ``csv`` (sorted columns, missing as empty) or ``json`` lines."""
    if fmt == "txt":
        run_lines(runs).write.mode("overwrite").text(path)
    elif fmt == "csv":
        runs.select(*sorted(runs.columns)).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
    elif fmt == "json":
        runs.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def to_json_lines(df: DataFrame) -> DataFrame:
    """Every row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
