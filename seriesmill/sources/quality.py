"""Checks on a frame that was just read."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.operators.columns import is_missing, rename_columns


def untagged_columns(df: DataFrame, tags: Mapping) -> list[str]:
    return [c for c in df.columns if c not in tags]


def quality_report(df: DataFrame, tags: Mapping, labelled: Iterable[str] = ()) -> DataFrame:
    """One row per finding: ``level, check, detail, n``; the table is read once.

    An empty table and untagged columns are errors; missing values, text columns
    and columns without a display label are warnings.
    """
    labelled = set(labelled)
    text = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    untagged = untagged_columns(df, tags)
    unlabelled = [c for c in df.columns if c not in labelled]
    missing = sum((F.sum(is_missing(df, c).cast("long")) for c in df.columns), F.lit(0))

    def finding(level: str, check: str, detail: str, n) -> F.Column:
        return F.struct(F.lit(level).alias("level"), F.lit(check).alias("check"), F.lit(detail).alias("detail"), n.cast("long").alias("n"))

    findings = F.array(
        finding("error", "empty table", "", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)),
        finding("error", "columns without tags", ",".join(untagged), F.lit(len(untagged))),
        finding("warning", "missing values", "", F.coalesce(missing, F.lit(0))),
        finding("warning", "text columns", ",".join(text), F.lit(len(text))),
        finding("warning", "columns without label", ",".join(unlabelled), F.lit(len(unlabelled))),
    )
    return df.agg(findings.alias("found")).select(F.inline("found")).filter(F.col("n") > 0)


def validated(df: DataFrame, tags: Mapping, labelled: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """The frame and its warnings; errors are raised.  Runs one job over a handful of counters."""
    found = quality_report(df, tags, labelled).collect()
    errors = [f"{row.check} {row.detail}".strip() for row in found if row.level == "error"]
    if errors:
        raise ValueError("; ".join(errors))
    return df, [f"{row.check}: {row.n} {row.detail}".strip() for row in found]


def rename_checked(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename every column; a column the map does not know is an error."""
    unknown = [c for c in df.columns if c not in names]
    if unknown:
        raise ValueError(f"columns missing from the name map: {unknown}")
    return rename_columns(df, names)
