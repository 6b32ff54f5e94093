import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import evaluation as E
from seriesmill.operators.leakage import data_leakage, distance_histogram


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(10, 3, 400)
    parts = [pd.DataFrame({"row_id": range(400), "candidate": c, "y": y, "y_hat": y + rng.normal(b, s, 400)}) for c, b, s in (("base", 0, 1), ("good", 0, 0.5), ("bad", 1, 2))]
    return pd.concat(parts)


def test_metrics_against_numpy(spark, scored):
    got = E.regression_metrics(spark.createDataFrame(scored), "y", "y_hat", "candidate").toPandas().set_index("candidate")
    for name, own in scored.groupby("candidate"):
        e = own.y - own.y_hat
        expected = {
            "rmse": np.sqrt((e**2).mean()), "neg_rmse": -np.sqrt((e**2).mean()), "mse": (e**2).mean(), "mae": e.abs().mean(),
            "me": e.mean(), "ame": abs(e.mean()), "mde": e.median(), "amde": abs(e.median()), "mdae": e.abs().median(),
            "r2": max(0, 1 - (e**2).sum() / ((own.y - own.y.mean()) ** 2).sum()),
        }
        for metric, value in expected.items():
            assert got.loc[name, metric] == pytest.approx(value, rel=1e-9), metric


def test_metrics_without_group(spark, scored):
    own = spark.createDataFrame(scored[scored.candidate == "bad"])
    row = E.regression_metrics(own, "y", "y_hat", [], ["rmse", "mdae", "mde"]).first()
    e = scored[scored.candidate == "bad"].eval("y - y_hat")
    assert (row.rmse, row.mdae, row.mde) == pytest.approx((np.sqrt((e**2).mean()), e.abs().median(), e.median()))


@pytest.mark.parametrize("mode", ["poisson", "multinomial"])
def test_bootstrap_shares_draws_and_matches_brute_force(spark, scored, mode):
    df = spark.createDataFrame(scored)
    weights = E.draw_weights(df, "row_id", 6, 3, method="xxhash64", mode=mode).toPandas()
    per_row = weights.groupby(["row_id", "replicate"]).weight.nunique()
    assert (per_row == 1).all()
    if mode == "multinomial":
        assert (weights[weights.candidate == "base"].groupby("replicate").weight.sum() == 400).all()
    got = E.paired_bootstrap(df, "row_id", "y", "y_hat", 6, 3, "candidate", ["neg_rmse", "mdae"], mode=mode).toPandas().set_index(["candidate", "replicate"])
    assert len(got) == 18
    for key, own in weights.groupby(["candidate", "replicate"]):
        e = np.repeat((own.y - own.y_hat).to_numpy(), own.weight)
        assert got.loc[key, "neg_rmse"] == pytest.approx(-np.sqrt((e**2).mean()))
        assert got.loc[key, "mdae"] == pytest.approx(np.median(np.abs(e)))


def test_bootstrap_modes_agree(spark, scored):
    df = spark.createDataFrame(scored[scored.candidate == "base"])
    spans = []
    for mode in ("poisson", "multinomial"):
        boot = E.paired_bootstrap(df, "row_id", "y", "y_hat", 200, 1, mode=mode)
        spans.append(E.percentile_interval(boot, "neg_rmse").first())
    assert spans[0].median == pytest.approx(spans[1].median, abs=0.02)
    assert spans[0].ci_low == pytest.approx(spans[1].ci_low, abs=0.04)


def test_non_inferiority(spark, scored):
    boot = E.paired_bootstrap(spark.createDataFrame(scored), "row_id", "y", "y_hat", 50, 2, "candidate")
    found = {r.candidate: r.non_inferior for r in E.non_inferiority(boot, "candidate", "base", "neg_rmse").collect()}
    assert found == {"good": True, "bad": False}
    loose = {r.candidate: r.non_inferior for r in E.non_inferiority(boot, "candidate", "base", "neg_rmse", margin=50).collect()}
    assert loose["bad"]


def test_skipping_metrics(spark):
    rows = [(10.0, 8.0), (0.0, 1.0), (5.0, 0.0), (-4.0, -2.0), (7.0, float("nan")), (7.0, None)]
    row = E.skipping_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()
    assert row.mape == pytest.approx((2 / 10 + 2 / -4) / 2 * 100)
    assert row.mae == pytest.approx((2 + 1 + 5 + 2) / 4)


def brute_leakage(test, train, alpha):
    def total(a, b):
        d = a.merge(b, on="g").eval("ts_y - ts_x").dt.days.to_numpy(dtype=float)
        return np.exp(-d[d >= 0]).sum() + alpha * np.exp(d[d < 0]).sum()

    return total(test, train) / total(test, test)


@pytest.mark.parametrize("alpha", [0.0, 0.3])
@pytest.mark.parametrize("days", [0.5, 40, 3000])
def test_leakage_equals_all_pairs(spark, alpha, days):
    rng = np.random.default_rng(int(days * 10))

    def sample(n):
        micros = rng.integers(0, int(days * 86_400_000_000), n)
        return pd.DataFrame({"g": rng.choice(["hot", "cold"], n, p=[0.9, 0.1]), "ts": pd.Timestamp("2019-12-25 03:00") + pd.to_timedelta(micros, unit="us")})

    test, train = sample(60), sample(80)
    train = pd.concat([train, test.head(3)])  # equal instants
    got = data_leakage(spark.createDataFrame(test), spark.createDataFrame(train), "ts", "g", alpha).first().leakage
    assert got == pytest.approx(brute_leakage(test, train, alpha), rel=1e-9)


def test_distance_histogram_counts_pairs(spark):
    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"g": rng.choice(["a", "b"], 80), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 500, 80) * 600, unit="s")})
    test, train = rows[:30], rows[30:]
    got = distance_histogram(spark.createDataFrame(test), spark.createDataFrame(train), "ts", "g", 600).toPandas()
    pairs = test.merge(train, on="g")
    expected = pairs.assign(days=(pairs.ts_y - pairs.ts_x).dt.days).groupby(["g", "days"]).size()
    assert got.set_index(["g", "days"]).pairs.sort_index().astype(int).to_dict() == expected.sort_index().to_dict()


@pytest.mark.parametrize("block", [4, 64, 1024])
def test_distance_histogram_by_blocks(spark, block):
    rng = np.random.default_rng(2)
    start = np.datetime64("1969-12-20")
    sides = [pd.DataFrame({"g": rng.choice(["a", "b", None], n, p=[0.6, 0.3, 0.1]), "ts": start + rng.integers(0, 40 * 24, n).astype("timedelta64[h]")}) for n in (300, 500)]
    got = distance_histogram(spark.createDataFrame(sides[0]), spark.createDataFrame(sides[1]), "ts", "g", 3600, block).toPandas()
    want = {}
    for name in ("a", "b", None):
        t, r = (s.ts[s.g.isna() if name is None else s.g == name].to_numpy() for s in sides)
        days, n = np.unique((r[None, :] - t[:, None]) // np.timedelta64(1, "D"), return_counts=True)
        want.update({(name, int(d)): float(k) for d, k in zip(days, n)})
    assert {(None if pd.isna(r.g) else r.g, r.days): r.pairs for r in got.itertuples()} == want


def test_convolution_equals_all_pairs_dense_and_sparse():
    from seriesmill.operators.leakage import convolve_days

    rng = np.random.default_rng(0)
    for many in (3, 40):
        (a, n), (b, m) = (lambda s: (s, rng.integers(1, 9, len(s)).astype(float)))(rng.choice(64, many, False)), (lambda s: (s, rng.integers(1, 9, len(s)).astype(float)))(rng.choice(64, many, False))
        want = {}
        for x, k in zip(a, n):
            for y, j in zip(b, m):
                want[y - x] = want.get(y - x, 0) + k * j
        gaps, sums = convolve_days((a, n), (b, m), 64)
        assert dict(zip(gaps.tolist(), sums.tolist())) == want


@pytest.mark.parametrize("margin", [6.0, 0.0, 300.0])
def test_draws_with_replacement_are_exact_and_do_not_follow_partitions(spark, scored, margin, monkeypatch):
    # margin 0 makes half of the replicates draw too much at first, a large one leaves every draw to the positions
    fill = E._fill_up
    monkeypatch.setattr(E, "_fill_up", lambda *a: fill(*a, margin=margin))
    df = spark.createDataFrame(scored)
    one = E.draw_weights(df.coalesce(1), "row_id", 40, 3, mode="multinomial", method="xxhash64").toPandas()
    two = E.draw_weights(df.repartition(7), "row_id", 40, 3, mode="multinomial", method="xxhash64").toPandas()
    keys = ["candidate", "row_id", "replicate"]
    assert one.sort_values(keys).weight.tolist() == two.sort_values(keys).weight.tolist()
    base = one[one.candidate == "base"]
    assert (base.groupby("replicate").weight.sum() == 400).all()
    # as by drawing with replacement: mean 1, variance 1 - 1/n, rows of a pair negatively correlated as 1/n
    table = base.pivot(index="row_id", columns="replicate", values="weight").reindex(range(400)).fillna(0).to_numpy()
    assert table.mean() == 1 and abs(table.var() - (1 - 1 / 400)) < 0.04
    shares = np.bincount(table.astype(int).reshape(-1), minlength=4)[:4] / table.size
    assert np.abs(shares - np.exp(-1) / np.array([1, 1, 2, 6])).max() < 0.015
    assert E.draw_weights(df.limit(0), "row_id", 3, 1, mode="multinomial").count() == 0
