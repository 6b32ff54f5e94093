import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.functions.draws import hash_share
from seriesmill.functions.special import digamma, incomplete_beta, t_quantile
from seriesmill.operators import neighbours as N
from seriesmill.operators.evaluation import mean_interval
from seriesmill.operators.scoring import mutual_information

SHAPE = "row_id long, a double, b double, c double, d double, flat double, gone double, y double, extra string"


def psi(n):
    return -np.euler_gamma + np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])


def brute(x, y, tx, ty, ids, k=3):
    """The estimator from all pairs of rows."""
    there = ~np.isnan(x) & ~np.isnan(y)
    x, y, tx, ty, ids = x[there], y[there], tx[there], ty[there], ids[there]
    n = len(x)
    if n < 2:
        return 0.0
    u, v = np.empty(n, int), np.empty(n, int)
    u[np.lexsort((ids, tx, x))] = range(n)
    v[np.lexsort((ids, ty, y))] = range(n)
    du, dv = np.abs(u[:, None] - u), np.abs(v[:, None] - v)
    joint = np.maximum(du, dv)
    np.fill_diagonal(joint, n + 1)
    e = np.sort(joint, axis=1)[:, min(k, n - 1) - 1][:, None]
    table = psi(n + 1)
    count = [(d < e).sum(1) - 1 for d in (du, dv)]
    return max(0.0, table[n - 1] + table[min(k, n - 1) - 1] - np.mean(table[count[0]] + table[count[1]]))


def rows_of(n, seed):
    draw = np.random.default_rng(seed)
    y = draw.normal(size=n)
    a = y + 0.1 * draw.normal(size=n)
    b = draw.normal(size=n)
    c = np.where(np.arange(n) % 3 == 0, 0.0, np.round(y))  # a third of all rows has one value
    d = np.where(draw.random(n) < 0.2, np.nan, np.sin(3 * y))
    y = np.where(draw.random(n) < 0.1, np.nan, y)
    return pd.DataFrame({"row_id": range(n), "a": a, "b": b, "c": c, "d": d, "flat": 1.0, "gone": np.nan, "y": y, "extra": "7"})


def expected(spark, table, features, k=3):
    frame = spark.createDataFrame(table[["row_id"]])
    out = {}
    for i, f in enumerate(features):
        shares = frame.select("row_id", *[hash_share(F.col("row_id"), F.lit(i), axis, method="xxhash64").alias(axis) for axis in "xy"]).toPandas().sort_values("row_id")
        out[f] = brute(table[f].to_numpy(), table.y.to_numpy(), shares.x.to_numpy(), shares.y.to_numpy(), table.row_id.to_numpy(), k)
    return out


@pytest.mark.parametrize("rank_rows", [N.RANK_ROWS, 50])
def test_scores_equal_all_pairs(spark, rank_rows):
    table = rows_of(2000, 1)
    features = ["a", "b", "c", "d", "flat", "gone"]
    frame = spark.createDataFrame(table, SHAPE).repartition(5)
    frame = frame.withColumn("gone", F.lit(None).cast("double"))
    found = {r.feature: r.score for r in N.neighbour_information(frame, features, "y", "row_id", rank_rows=rank_rows).collect()}
    want = expected(spark, table, features)
    assert found == pytest.approx(want, abs=1e-9)
    assert found["a"] > 1 > found["c"] > 0.2 > found["b"] and found["d"] > 0.8 and found["gone"] == 0


def test_known_value_of_correlated_normals(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=5000)
    y = 0.8 * x + 0.6 * draw.normal(size=5000)
    frame = spark.createDataFrame(pd.DataFrame({"row_id": range(5000), "x": np.exp(x), "y": y}))
    score = N.neighbour_information(frame, ["x"], "y", "row_id").first().score
    assert score == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.04)


def test_far_neighbours_take_wider_cells(spark):
    # most points on the diagonal, a few outliers far away from everything: only they are left over by the strips
    n = 3000
    u = np.arange(n)
    v = u.copy()
    away = [10, 500, 1500, 2900, 2999]
    v[away] = v[away[::-1]]
    ranks = spark.createDataFrame(pd.DataFrame({"position": np.zeros(n, np.int32), "u": u, "v": v}))
    found = N.neighbour_distances(ranks, ranks.groupBy("position").agg(F.count("u").alias("n")), 3, width=0.2).toPandas().sort_values("u")
    joint = np.maximum(np.abs(u[:, None] - u), np.abs(v[:, None] - v))
    np.fill_diagonal(joint, 10 * n)
    assert found.e.tolist() == np.sort(joint, axis=1)[:, 2].tolist()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9])
def test_few_rows(spark, n):
    table = rows_of(12, 2).dropna(subset=["y"]).head(n)
    frame = spark.createDataFrame([tuple(r) for r in table.itertuples(index=False)], SHAPE)
    found = {r.feature: r.score for r in N.neighbour_information(frame, ["a", "flat"], "y", "row_id").collect()}
    assert found == pytest.approx(expected(spark, table, ["a", "flat"]) if n else {"a": 0, "flat": 0}, abs=1e-9)


def test_digamma(spark):
    points = [1.0, 2.0, 3.5, 10.0, 1e6]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in points], "x double").select(digamma(F.col("x"))).collect()]
    # digamma(7/2) = 46/15 - gamma - 2 ln 2
    want = [-np.euler_gamma, 1 - np.euler_gamma, 46 / 15 - np.euler_gamma - 2 * math.log(2), psi(10)[9], math.log(1e6) - 5e-7 - 1 / 12e12]
    assert got == pytest.approx(want, abs=1e-13)


def test_incomplete_beta(spark):
    # I_x(a, 1) = x^a, I_x(1, b) = 1 - (1 - x)^b, I_x(1/2, 1/2) = 2 / pi * asin(sqrt(x))
    rows = [(3.0, 1.0, 0.3, 0.027), (1.0, 4.0, 0.9, 1 - 1e-4), (0.5, 0.5, 0.2, 2 / math.pi * math.asin(math.sqrt(0.2))), (2.0, 2.0, 0.0, 0.0), (2.0, 2.0, 1.0, 1.0), (200.0, 0.5, 0.99, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double, x double, want double").select(incomplete_beta(F.col("a"), F.col("b"), F.col("x"))).collect()]
    for g, row in zip(got, rows):
        if row[3] is not None:
            assert g == pytest.approx(row[3], abs=1e-12)


def test_t_quantiles_equal_the_tables(spark):
    tabled = {
        0.975: {1: 12.706204736432095, 2: 4.302652729696142, 3: 3.182446305284263, 4: 2.7764451051977987, 5: 2.5705818366147395, 10: 2.2281388519649385, 30: 2.0422724563012373, 100: 1.9839715184496334, 1000: 1.9623390808264078},
        0.95: {1: 6.313751514675043, 10: 1.8124611228107335},
        0.995: {3: 5.840909309732673},
    }
    for p, row in tabled.items():
        frame = spark.createDataFrame([(n,) for n in row], "n long")
        high = {r.n: r.q for r in frame.select("n", t_quantile(p, F.col("n")).alias("q")).collect()}
        low = {r.n: r.q for r in frame.select("n", t_quantile(1 - p, F.col("n")).alias("q")).collect()}
        assert high == pytest.approx(row, abs=1e-9, rel=1e-9) and low == pytest.approx({n: -q for n, q in row.items()}, abs=1e-9, rel=1e-9)
    assert [r[0] for r in spark.createDataFrame([(0,), (None,)], "n long").select(t_quantile(0.9, F.col("n"))).collect()] == [None, None]
    with pytest.raises(ValueError):
        t_quantile(1.0, F.lit(3))


def test_mean_interval_takes_its_own_quantile(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", 5.0), ("b", 2.0), ("c", None)]
    found = {r.g: (r["mean"], r.low, r.high) for r in mean_interval(spark.createDataFrame(rows, "g string, x double"), "x", group="g").collect()}
    half = 2 / math.sqrt(3) * 4.302652729696142
    assert found["a"] == pytest.approx((3.0, 3 - half, 3 + half)) and found["b"] == (2.0, None, None) and found["c"] == (None, None, None)


@pytest.mark.parametrize("binning", ["width", "quantile"])
def test_missing_values_do_not_count_in_bins(spark, binning):
    draw = np.random.default_rng(8)
    n = 4000
    x, y = draw.random(n), draw.random(n)
    table = pd.DataFrame({"x": x, "holes": np.where(y > 0.9, np.nan, x), "same": y, "y": y, "odd": np.where(np.arange(n) < 4, np.nan, y)})
    frame = spark.createDataFrame(table).withColumns({"holes": F.when(~F.isnan("holes"), F.col("holes")), "gone": F.lit(None).cast("double")})
    found = {r.feature: r.score for r in mutual_information(frame, ["x", "holes", "same", "odd", "gone"], "y", 8, binning).collect()}
    assert found["holes"] == pytest.approx(found["x"], abs=0.01) and found["x"] < 0.02
    assert found["odd"] == pytest.approx(found["same"], abs=0.02) and found["same"] > 2 and found["gone"] == 0


def test_estimator_is_chosen_by_name(spark):
    frame = spark.createDataFrame(rows_of(50, 3), SHAPE)
    by_name = mutual_information(frame, ["a"], "y", estimator="neighbours", row_id="row_id").first().score
    assert by_name == N.neighbour_information(frame, ["a"], "y", "row_id").first().score
    for wrong in ({"estimator": "neighbours"}, {"estimator": "odd"}, {"binning": "odd"}):
        with pytest.raises(ValueError):
            mutual_information(frame, ["a"], "y", **wrong)
