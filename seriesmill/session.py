"""Session settings, lineage cuts and null-safe joins shared by the operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "seriesmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer switched on.

    Shuffle partitions are left to the cluster's setting; adaptive execution
    coalesces them for small data and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``folder/name.parquet``; the session clock is set to UTC first."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="seriesmill-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    Runs one job.  The copy outlives any executor.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other, keeping the left keys."""
    renamed = right.withColumnsRenamed({name: f"__right_{name}" for name in on})
    condition = F.lit(True)
    for name in on:
        condition = condition & left[name].eqNullSafe(renamed[f"__right_{name}"])
    return left.join(renamed, condition, how).drop(*[f"__right_{name}" for name in on])


def as_list(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def require_columns(df: DataFrame, columns) -> None:
    missing = [name for name in as_list(columns) if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
