import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from seriesmill.operators import aggregates as A
from seriesmill.operators.quantiles import quantiles


@pytest.mark.parametrize("levels", [2, 6])
def test_matches_numpy(spark, levels):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 2000, p=[0.8, 0.15, 0.05]), "v": np.round(rng.gamma(1.0, 50.0, 2000), 1)})
    probs = [0.0, 0.1, 0.5, 0.9999, 1.0]
    got = quantiles(spark.createDataFrame(pdf), "v", probs, "g", levels=levels).toPandas().set_index("g")
    for g, own in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g].to_numpy(dtype=float), np.quantile(own.v, probs))


def test_weights_are_multiplicities(spark):
    pdf = pd.DataFrame({"v": [1.0, 2.0, 5.0, 9.0], "w": [3, 0, 2, 1]})
    got = quantiles(spark.createDataFrame(pdf), "v", [0.5, 0.7], weight="w").first()
    np.testing.assert_allclose([got.q0, got.q1], np.quantile([1, 1, 1, 5, 5, 9], [0.5, 0.7]))


def test_missing_infinite_and_null_group(spark):
    rows = [("a", 1.0), ("a", None), ("a", float("nan")), ("a", float("inf")), (None, 4.0), (None, 6.0), ("one", 7.0)]
    got = {r.g: r.q0 for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0.5], "g").collect()}
    assert got[None] == 5.0 and got["one"] == 7.0 and got["a"] == float("inf")


def test_one_value_repeated(spark):
    got = quantiles(spark.range(500).selectExpr("3.5D AS v"), "v", [0.25, 0.75]).first()
    assert (got.q0, got.q1) == (3.5, 3.5)


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def mixed_groups():
    rng = np.random.default_rng(5)
    return pd.DataFrame({"g": ["big"] * 900 + ["mid"] * 300 + ["few"] * 20, "v": np.round(rng.normal(0.0, 9.0, 1220), 2)})


def test_rows_of_large_groups_stay_where_they_are(spark, no_small_tables):
    pdf = mixed_groups()
    found = quantiles(spark.createDataFrame(pdf), "v", [0.1, 0.5], "g", bin_rows=100)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    got = found.toPandas().set_index("g")
    for g, own in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g].to_numpy(dtype=float), np.quantile(own.v, [0.1, 0.5]))


def test_rows_are_expanded_once_to_count_the_bins(spark):
    df = spark.createDataFrame(mixed_groups())
    expand = lambda rows: rows.withColumn("b", F.explode(F.array(F.lit(0), F.lit(1))))
    found = quantiles(df, "v", [0.5], ["g", "b"], expand=expand, expanded=["b"], bin_rows=100)
    assert found.count() == 6
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("== Initial Plan ==")[0]


def test_box_statistics_of_large_and_small_groups(spark, no_small_tables, monkeypatch):
    monkeypatch.setattr(A, "BIN_ROWS", 100)
    pdf = mixed_groups()
    found = A.box_statistics(spark.createDataFrame(pdf), "v", "g")
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    got = {r.g: r for r in found.collect()}
    assert len(got) == 3
    for g, own in pdf.groupby("g"):
        q1, q3 = np.quantile(own.v, [0.25, 0.75])
        inside = own.v[(own.v >= q1 - 1.5 * (q3 - q1)) & (own.v <= q3 + 1.5 * (q3 - q1))]
        assert (got[g].n, got[g].whisker_low, got[g].whisker_high) == (len(own), inside.min(), inside.max())
