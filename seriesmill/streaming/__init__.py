"""Row-wise operators on streams.

The batch operators that look at one row at a time run unchanged on a streaming
frame.  There is no stateful stream operator here, because nothing in the
covered work is one; whole-table operators refuse a stream in Spark itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_landing(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a landing folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def apply_row_steps(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chain row-wise operators on a stream."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming frame")
    for step in steps:
        stream = stream.transform(step)
    return stream


def write_landing(stream: DataFrame, folder: str, checkpoint: str):
    """Append a stream to a Parquet folder, exactly once; processes what is there and stops."""
    return (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
