import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import search as S


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.normal(size=(n, 3))
    table = pd.DataFrame(x, columns=["a", "b", "c"])
    table["y"] = 4 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=n)
    table["row_id"] = range(n)
    return spark.createDataFrame(table).repartition(4).cache()


SPACE = {"regParam": [0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]}


def search(frame, **more):
    args = {"family": "linear", "space": SPACE, "parallelism": 2} | more
    return S.halving_search(frame, ["a", "b", "c"], "y", [F.col("row_id")], [F.floor(F.col("row_id") / 1000)], "row_id", **args)


def test_finds_the_known_optimum_and_logs_every_trial(frame):
    # least squares without a penalty is best on the holdout, whatever the sample
    best, log = search(frame, eta=3, least_share=1 / 9)
    assert best == {"regParam": 0.0}
    rows = log.toPandas().sort_values(["rung", "trial"])
    assert rows.groupby("rung").size().tolist() == [9, 3, 1] and sorted(set(rows.share.round(6))) == [0.111111, 0.333333, 1.0]
    assert (rows.outcome == "done").all() and (rows.seconds > 0).all() and rows.mse.notna().all()
    # a rung takes the best of the one before
    for k in (0, 1):
        here, there = rows[rows.rung == k], rows[rows.rung == k + 1]
        assert set(there.trial) == set(here.sort_values("mse").trial[: len(there)])
    assert rows[rows.rung == 2].mse.iloc[0] == pytest.approx(0.01, rel=0.2)
    assert json.loads(rows[rows.rung == 2].params.iloc[0]) == best


def test_samples_are_nested_and_reruns_agree(frame):
    one, two = (search(frame, trials=4, least_share=1 / 3)[1].toPandas().sort_values(["rung", "trial"]) for _ in range(2))
    assert one.mse.tolist() == pytest.approx(two.mse.tolist()) and one.params.tolist() == two.params.tolist()
    shares = frame.select(S.hash_share(F.col("row_id"), "sample", 42, method="xxhash64").alias("s")).toPandas().s
    assert abs((shares < 1 / 3).mean() - 1 / 3) < 0.03


def test_budget_ends_the_search(frame, monkeypatch):
    with pytest.raises(ValueError):
        search(frame, budget_seconds=0.0)
    # the clock runs out after the first rung
    real, calls = S.fit_model, []

    def slow(*a):
        calls.append(1)
        return real(*a)

    monkeypatch.setattr(S, "fit_model", slow)
    clock = S.time.monotonic
    monkeypatch.setattr(S.time, "monotonic", lambda: clock() + (1e6 if len(calls) >= 3 else 0))
    best, log = search(frame, trials=9, budget_seconds=1e5, parallelism=1, seconds_per_fit=1e5)
    rows = log.toPandas()
    assert set(rows.outcome) == {"done", "skipped"} and set(rows.rung) == {0} and (rows.outcome == "done").sum() == 3
    done = rows[rows.outcome == "done"].sort_values("mse")
    assert json.loads(done.params.iloc[0]) == best


def test_a_fit_beyond_its_time_is_cancelled(frame, monkeypatch):
    real = S.fit_model

    def heavy(rows, features, target, family, params):
        if params["regParam"] == 0.0:
            # a job that would take minutes
            rows.crossJoin(rows.select(F.col("a").alias("z"))).crossJoin(rows.select(F.col("a").alias("w"))).agg(F.sum(F.sin(F.col("z") * F.col("w")))).collect()
        return real(rows, features, target, family, params)

    monkeypatch.setattr(S, "fit_model", heavy)
    best, log = search(frame, space={"regParam": [0.0, 8.0]}, seconds_per_fit=8.0, least_share=1.0)
    rows = log.toPandas().set_index("params")
    assert best == {"regParam": 8.0} and rows.loc['{"regParam": 0.0}', "outcome"] == "out_of_time"
    assert rows.loc['{"regParam": 0.0}', "seconds"] < 60


@pytest.mark.parametrize("n, eta, least, want", [(9, 3, 1 / 9, [9, 3, 1]), (25, 3, 1 / 27, [25, 9, 3, 1]), (1, 3, 0.01, [1]), (4, 2, 1.0, [4]), (5, 2, 0.5, [5, 3])])
def test_rungs(n, eta, least, want):
    rungs = S.rung_sizes(n, eta, least)
    assert [r[0] for r in rungs] == want and rungs[-1][1] == 1.0 and rungs[0][1] >= least - 1e-12


def test_candidates():
    found = S.draw_candidates({"a": [1, 2], "b": [3, 4]}, 3, 1, {"a": 2, "b": 3})
    assert found[0] == {"a": 2, "b": 3} and len(found) == 3 and len({json.dumps(f) for f in found}) == 3
    assert found == S.draw_candidates({"a": [1, 2], "b": [3, 4]}, 3, 1, {"a": 2, "b": 3})


def test_tuning_keeps_only_what_fits_read(spark, monkeypatch):
    from seriesmill.operators import models as L

    kept, cut = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    df = spark.range(200).selectExpr("id AS t", "cast(id % 7 AS double) AS x", "cast(id % 7 * 3 AS double) AS y", "'more' AS other")
    best, trials = L.tune(df, ["x"], "y", [F.col("t")], [F.lit(0)], "linear", {"regParam": [0.0, 10.0]})
    assert kept == [["x", "y", "split"]] and best == {"regParam": 0.0} and trials.count() == 2
