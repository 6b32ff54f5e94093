import pytest
from pyspark.sql import functions as F

from seriesmill.queries import streams
from seriesmill.streaming import capabilities as C


@pytest.fixture(scope="module")
def readings(spark, tmp_path_factory):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    made = events.select(F.col("user_id").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), value.alias("value"), (F.col("value") / 2).alias("other"), (F.col("event_id") % 20 + 1).cast("double").alias("speed"))
    path = str(tmp_path_factory.mktemp("readings") / "landing")
    made.repartition(3).write.parquet(path)
    return spark.read.parquet(path), path


@pytest.mark.parametrize("name", sorted(C.OPERATORS))
def test_streams_give_the_rows_of_the_batch(readings, name):
    frame, path = readings
    found = C.stream_rows(frame, C.OPERATORS[name], path)
    assert (found is None) == (name in streams.WHOLE_TABLE)
    if found is not None:
        batch = C.OPERATORS[name](frame)
        assert found.columns == batch.columns and found.count() > 0
        assert found.exceptAll(batch).isEmpty() and batch.exceptAll(found).isEmpty()


def test_table_of_flags(spark, readings):
    chosen = {k: C.OPERATORS[k] for k in ("keep_columns", "filter_rows", "normalise")}
    rows = {r.operator: (r.streamable, r.n) for r in C.capabilities(readings[0], chosen).collect()}
    assert rows == {"keep_columns": (True, readings[0].count()), "filter_rows": (True, readings[0].filter("value > 50").count()), "normalise": (False, 0)}
