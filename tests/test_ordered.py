import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.operators.ordered import add_lags, first_in_group, lagged_series, next_event, order_violations, row_index


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def stamp(text):
    return pd.Timestamp(text).to_pydatetime()


@pytest.mark.parametrize("chunk", [60, 3600, 10 * 86_400])
def test_lags_cross_chunks(spark, chunk):
    rng = np.random.default_rng(1)
    seconds = np.sort(rng.choice(200_000, 300, replace=False))
    pdf = pd.DataFrame(
        {"g": np.where(rng.random(300) < 0.7, "hot", "cold"), "ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(seconds, unit="s"), "v": rng.random(300)}
    )
    got = add_lags(spark.createDataFrame(pdf), [1, 4], "v", "g", "ts", chunk_seconds=chunk).toPandas().sort_values("ts").reset_index(drop=True)
    for k in (1, 4):
        expected = pdf.groupby("g")["v"].shift(k)
        np.testing.assert_allclose(got[f"v_lag_{k}"].to_numpy(dtype=float), expected.to_numpy())


def test_lag_keeps_missing_values(spark):
    rows = [("a", stamp("2024-01-01 00:10"), 1.0), ("a", stamp("2024-01-01 00:20"), None), ("a", stamp("2024-01-01 05:00"), 3.0)]
    got = add_lags(frame(spark, rows, "g string, ts timestamp, v double"), [1, 2], "v", "g", "ts").orderBy("ts").collect()
    assert [r.v_lag_1 for r in got] == [None, 1.0, None]
    assert [r.v_lag_2 for r in got] == [None, None, 1.0]


def test_lagged_series_shape(spark):
    rows = [("a", stamp(f"2024-01-01 0{i}:00"), float(i), float(-i)) for i in range(4)]
    got = lagged_series(frame(spark, rows, "g string, ts timestamp, x double, y double"), [1, 2], ["x", "y"], "g", "ts").orderBy("ts").collect()
    assert got[3].series == [[3.0, -3.0], [2.0, -2.0], [1.0, -1.0]]
    assert got[0].series == [[0.0, 0.0], [None, None], [None, None]]
    with pytest.raises(ValueError):
        lagged_series(frame(spark, rows, "g string, ts timestamp, x double, y double"), [1, 1], ["x"], "g", "ts")


def test_next_event_edges(spark):
    readings = frame(
        spark,
        [
            ("a", stamp("2024-01-01 00:00"), 1),
            ("a", stamp("2024-01-05 12:00"), 2),  # at the event
            ("a", stamp("2024-01-05 12:01"), 3),  # after the last event
            ("b", stamp("2024-01-01 00:00"), 4),  # asset without events
            (None, stamp("2024-01-01 00:00"), 5),
        ],
        "asset string, ts timestamp, id int",
    )
    events = frame(
        spark,
        [("a", stamp("2024-01-05 12:00"), "z"), ("a", stamp("2024-01-05 12:00"), "y"), (None, stamp("2024-01-06 00:00"), "n")],
        "asset string, at timestamp, what string",
    )
    got = {r.id: (r.at, r.what) for r in next_event(readings, events, "asset", "ts", "at", ["what"]).collect()}
    event = stamp("2024-01-05 12:00")
    assert got == {1: (event, "y"), 2: (event, "y"), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_next_event_refuses_name_clash(spark):
    readings = frame(spark, [("a", stamp("2024-01-01"))], "asset string, ts timestamp")
    with pytest.raises(ValueError):
        next_event(readings, readings, "asset", "ts", "ts")


def test_next_event_has_no_pair_join(spark, folder):
    from seriesmill.session import read_table

    events = read_table(spark, folder, "events")
    errors = events.select("user_id", F.col("ts").alias("at"))
    plan = next_event(events, errors, "user_id", "ts", "at")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_row_index_with_hot_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"), (F.col("id") * 37 % 1009).alias("k"))
    got = row_index(df, [F.col("k")], [F.floor(F.col("k") / 50)], "g").toPandas()
    expected = got.groupby("g")["k"].rank().astype(int) - 1
    assert (got.row_index == expected).all()


def test_first_in_group_and_violations(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 5, "w")]
    df = frame(spark, rows, "g string, k int, v string")
    assert sorted(tuple(r) for r in first_in_group(df, "g", ["k", "v"]).collect()) == [("a", 1, "y"), ("b", 5, "w")]
    assert {r.g: (r.n_rows, r.n_instants, r.n_repeated) for r in order_violations(df, "g", "k").collect()} == {"a": (3, 2, 1), "b": (1, 1, 0)}
