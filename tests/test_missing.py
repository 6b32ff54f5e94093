"""Groups without values, NaN, unknown keys and holes in matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.functions.draws import POISSON_STEPS
from seriesmill.operators.aggregates import aggregate_values, best_row, box_statistics, describe, moments
from seriesmill.operators.evaluation import regression_metrics
from seriesmill.operators.gram import GramScorer
from seriesmill.operators.joins import attach_dimension
from seriesmill.operators.models import build_estimator
from seriesmill.operators.quantiles import quantiles
from seriesmill.operators.reshape import fill_gaps
from seriesmill.operators.rows import filter_assets
from seriesmill.operators.scoring import correlation_matrix, correlation_pairs, f_scores
from seriesmill.operators.selection import ClusterSelector


@pytest.fixture(scope="module")
def holes(spark):
    nan = float("nan")
    return spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("c", nan), ("c", 1.0), ("c", 3.0), (None, 5.0)], "g string, v double")


def test_groups_without_values_stay(holes):
    got = {r.g: r for r in describe(holes, "v", "g").collect()}
    assert set(got) == {"a", "b", "c", None}
    assert got["b"]["count"] == 0 and got["b"].q50 is None
    assert (got["c"]["count"], got["c"].mean, got["c"].q50, got["c"]["max"]) == (2, 2.0, 2.0, 3.0)
    for mode in ("median", "p=25", "avg"):
        assert {r.g for r in aggregate_values(holes, "v", mode, "g").collect()} == {"a", "b", "c", None}
    boxes = {r.g: r for r in box_statistics(holes, "v", "g").collect()}
    assert boxes["b"].n == 0 and boxes["b"].median is None and boxes["c"].n == 2
    assert moments(holes, ["v"], "g").filter("g = 'c'").first().v_mean == 2.0


@pytest.mark.parametrize("how", [{"levels": 3}, {"bin_rows": 50}, {}])
def test_bins_belong_to_a_group(spark, how):
    """A group whose values lie close together beside one that is spread wide."""
    rng = np.random.default_rng(1)
    rows = [("wide", float(v)) for v in rng.uniform(0, 1e6, 300)] + [("narrow", 500.0 + float(v) * 1e-6) for v in rng.uniform(0, 1, 300)] + [("none", None)]
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0.1, 0.5], "g", **how).collect()}
    for g in ("wide", "narrow"):
        own = [v for name, v in rows if name == g]
        np.testing.assert_allclose([got[g].q0, got[g].q1], np.quantile(own, [0.1, 0.5]), rtol=1e-12)
    assert got["none"].q0 is None


def test_metrics_skip_missing_rows(spark):
    nan = float("nan")
    rows = [("a", 1.0, 2.0), ("a", 3.0, nan), ("a", None, 1.0), ("a", 5.0, 5.0), ("b", None, 1.0)]
    got = {r.g: r for r in regression_metrics(spark.createDataFrame(rows, "g string, y double, p double"), "y", "p", "g", ["rmse", "mae", "mdae", "mde"]).collect()}
    assert got["a"].mae == 0.5 and got["a"].rmse == pytest.approx(np.sqrt(0.5)) and got["a"].mdae == 0.5
    assert got["b"].rmse is None and got["b"].mdae is None


def test_best_row_ranks_the_column_itself(spark):
    big = 2**53
    rows = spark.createDataFrame([("a", big + 1, 1), ("a", big, 2), ("a", None, 0)], "g string, s long, t int")
    assert best_row(rows, "g", "s", ["t"]).first().t == 2
    assert best_row(rows, "g", "s", ["t"], largest=True).first().t == 1


def test_matrix_with_holes_is_pairwise(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(200, 3))
    data[:, 2] += data[:, 0]
    data[rng.random(data.shape) < 0.2] = np.nan
    rows = [tuple(None if np.isnan(x) and k % 2 else float(x) for x in row) for k, row in enumerate(data)]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    import pandas as pd

    want = pd.DataFrame(data).corr().to_numpy()
    np.testing.assert_allclose(correlation_matrix(frame, ["a", "b", "c"]), want, atol=1e-10)
    got = {(r.feature_a, r.feature_b): r.r for r in correlation_pairs(frame, ["a", "b", "c"]).collect()}
    assert got["a", "c"] == pytest.approx(want[0, 2])
    assert f_scores(frame, ["a", "b"], "c").count() == 2
    with pytest.raises(Exception, match="missing value"):
        GramScorer(frame.withColumn("split", F.when(F.rand(1) < 0.5, "train").otherwise("val")).withColumn("id", F.monotonically_increasing_id()), ["a", "b"], "c", ["id"])


def test_metadata_must_be_one_row_per_asset(spark):
    readings = spark.createDataFrame([("s1", 1), ("s2", 2), (None, 3)], "asset string, v int")
    good = spark.createDataFrame([("s1", "x"), ("s2", "y"), ("s3", "z")], "asset string, site string")
    assert {(r.v, r.site) for r in attach_dimension(readings, good, "asset").collect()} == {(1, "x"), (2, "y"), (3, None)}
    for bad in (good.filter("asset <> 's2'"), good.union(good.filter("asset = 's1'"))):
        with pytest.raises(Exception, match="rows of metadata"):
            attach_dimension(readings, bad, "asset").collect()


def test_missing_features_stop_a_model(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (2.0, 4.0)], "x double, y double")
    with pytest.raises(Exception, match="(?i)null"):
        build_estimator(["x"], "y", "linear").fit(frame)


def test_lists_and_tables_filter_alike(spark):
    frame = spark.range(3000).withColumn("serial_number", F.col("id").cast("string"))
    ids = [str(k) for k in range(0, 2400, 2)]
    table = spark.createDataFrame([(k,) for k in ids], "asset string")
    assert filter_assets(frame, ids).count() == filter_assets(frame, table).count() == len(ids)


def test_draws_are_not_cut():
    assert len(POISSON_STEPS) > 12 and POISSON_STEPS[-1] < 1.0
    weights = np.searchsorted(POISSON_STEPS, np.linspace(0, 1, 2_000_001)[:-1], side="right")
    assert weights.max() > 6 and abs(weights.mean() - 1) < 1e-4


def test_grid_of_many_steps(spark):
    ends = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 03:00:00", 2), ("b", "2024-01-05 00:00:00", 3)], "g string, t string, v int")
    frame = ends.withColumn("ts", F.to_timestamp("t")).drop("t")
    got = fill_gaps(frame, "ts", "g", "1 SECOND")
    assert got.filter("g = 'a'").count() == 3 * 3600 + 1 and got.filter("g = 'b'").count() == 1
    assert got.filter("v IS NOT NULL").count() == 3
    months = fill_gaps(spark.createDataFrame([("a", "2024-01-31"), ("a", "2024-03-31")], "g string, d string").withColumn("ts", F.to_timestamp("d")), "ts", "g", "1 MONTH")
    assert months.count() == 3


class Many:
    """Scores sets from a table and remembers which were asked for together."""

    def __init__(self):
        self.batches, self.tuned = [], []

    def score(self, features):
        return np.full(20, -float(len(features)))

    def point_score(self, features):
        return -float(len(features))

    def score_many(self, sets):
        self.batches.append(len(sets))
        return [self.score(s) for s in sets]

    def retune(self, features):
        self.tuned.append(len(features))


def test_several_sets_in_flight_and_tuning():
    clusters = {k: [f"f{k}"] for k in range(9)}
    scorer = Many()
    plain = ClusterSelector(Many(), clusters, 4, fast_mode=False, in_flight=1).fit()
    assert ClusterSelector(scorer, clusters, 4, fast_mode=False, in_flight=4).fit().log == plain.log
    assert max(scorer.batches) == 4
    for tuning, count in (("warm_up", 1), ("iteration", 5), ("set", None)):
        scorer = Many()
        ClusterSelector(scorer, clusters, 4, fast_mode=False, tuning=tuning).fit()
        assert len(scorer.tuned) == count or (count is None and len(scorer.tuned) > 20)
    with pytest.raises(ValueError):
        ClusterSelector(Many(), clusters, 4, tuning="often")


def test_resume_refuses_other_clusters(spark):
    clusters = {k: [f"f{k}"] for k in range(5)}
    done = ClusterSelector(Many(), clusters, 2, fast_mode=False).fit()
    log = done.metrics_frame(spark)
    again = ClusterSelector(Many(), clusters, 2, fast_mode=False).resume(log, done.clusters, 2).fit()
    assert again.taken == done.taken
    with pytest.raises(ValueError, match="clusters"):
        ClusterSelector(Many(), {0: ["f0", "f1"], 1: ["f2"], 2: ["f3"]}, 2).resume(log, done.clusters, 2)
