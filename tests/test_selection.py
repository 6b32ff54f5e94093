import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import RegressionEvaluator

from seriesmill.operators import clustering as C
from seriesmill.operators.gram import GramScorer, gram_sums, replicate_weights
from seriesmill.operators.models import ModelScorer, build_estimator, fit_model, test_fits, tune
from seriesmill.operators.scoring import correlation_matrix, correlation_pairs, f_scores, mutual_information
from seriesmill.operators.selection import ClusterSelector, aggregate_scores, sequential_selection
from seriesmill.operators.sets import select_k_best
from pyspark.sql import functions as F

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    n = 600
    x = pd.DataFrame({k: rng.normal(size=n) for k in "abcd"})
    x["e"] = x.a + 0.01 * rng.normal(size=n)
    x["y"] = 3 * x.a - 2 * x.b + 0.3 * x.c + rng.normal(size=n) * 0.5 + 1e4
    x["row_id"] = range(n)
    x["split"] = np.where(x.index < 420, "train", "val")
    return x


@pytest.fixture(scope="module")
def frame(spark, table):
    return spark.createDataFrame(table)


@pytest.fixture(scope="module")
def scorer(frame):
    return GramScorer(frame, FEATURES, "y", ["row_id"], replicates=40)


def test_gram_equals_fitted_model(frame, scorer):
    train, val = frame.filter("split = 'train'"), frame.filter("split = 'val'")
    for features in (["a"], ["a", "b", "d"], FEATURES):
        scored = fit_model(train, features, "y", "linear").predict(val)
        rmse = RegressionEvaluator(labelCol="y", predictionCol="y_hat").evaluate(scored)
        assert -scorer.point_score(features) == pytest.approx(rmse, rel=1e-6)


def test_replicates_are_weighted_errors(table, scorer, spark, frame):
    ids = np.array([r.h for r in frame.select("row_id", F.xxhash64("row_id").alias("h")).orderBy("row_id").collect()], dtype=np.int64)
    w = replicate_weights(ids.view(np.uint64), 40, 42)
    train, val = table[table.split == "train"], table[table.split == "val"]
    design = lambda t: np.c_[np.ones(len(t)), t[["a", "c"]]]
    beta = np.linalg.lstsq(design(train), train.y, rcond=None)[0]
    e2 = (val.y - design(val) @ beta).to_numpy() ** 2
    wv = w[val.index]
    expected = -np.sqrt((wv * e2[:, None]).sum(axis=0) / wv.sum(axis=0))
    np.testing.assert_allclose(scorer.score(["a", "c"]), expected, rtol=1e-8)
    assert 0.9 < w.mean() < 1.1 and 0.85 < w.var() < 1.15


def test_gram_does_not_depend_on_partitions(frame):
    one = gram_sums(frame.coalesce(1), ["a", "y"], "split", ["row_id"], 5, "val", centre=[0.0, 1e4])
    many = gram_sums(frame.repartition(7), ["a", "y"], "split", ["row_id"], 5, "val", centre=[0.0, 1e4])
    for p, q in zip(one, many):
        assert (p.part, p.replicate) == (q.part, q.replicate)
        np.testing.assert_allclose(p.gram, q.gram, rtol=1e-9)


def test_collinear_and_constant_features(spark, table):
    df = spark.createDataFrame(table.assign(copy=table.a * 2, flat=1.0))
    own = GramScorer(df, ["a", "copy", "flat"], "y", ["row_id"], replicates=0)
    assert own.point_score(["a", "copy", "flat"]) == pytest.approx(own.point_score(["a"]), rel=1e-6)


def brute_backward(scorer, features, n, beta=0.05):
    """Reference loop for singleton clusters without early exit."""
    left = list(features)
    base = scorer.score(left)
    while len(left) > n:
        scores = {f: scorer.score([g for g in left if g != f]) for f in left}
        passing = [f for f in left if np.quantile(scores[f] - base, beta) >= 0]
        pool = passing or left
        gone = max(pool, key=lambda f: np.median(scores[f]))
        base = scores[gone]
        left.remove(gone)
    return left


@pytest.mark.parametrize("n", [1, 2, 4])
def test_backward_singletons_match_brute_loop(scorer, n):
    got = ClusterSelector(scorer, C.singletons(FEATURES), n, fast_mode=False).fit()
    assert sorted(got.selected) == sorted(brute_backward(scorer, FEATURES, n))


class Table:
    """Scores looked up in a dictionary of frozensets."""

    def __init__(self, scores):
        self.scores, self.asked = scores, []

    def score(self, features):
        self.asked.append(frozenset(features))
        value = self.scores.get(frozenset(features), -9.0)
        return np.array(value if isinstance(value, list) else [value] * 4)

    def point_score(self, features):
        return float(np.mean(self.score(features)))


def fs(*names):
    return frozenset(names)


def test_fast_mode_stops_at_first_passing_cluster():
    scores = Table({fs("a", "b", "c"): -1.0, fs("b", "c"): -1.0, fs("a", "c"): -0.5, fs("a", "b"): -0.1})
    got = ClusterSelector(scores, C.singletons(["a", "b", "c"]), 2).fit()
    assert got.taken == [0]
    assert fs("a", "c") not in scores.asked
    keys = {(k, v) for k, _, _, v in got.log if not k.startswith("validation")}
    assert {("fast_stop_iteration", 0.0), ("fast_stop_evaluated_clusters", 1.0), ("selected_cluster_id", 0.0)} <= keys


def test_without_fast_mode_best_passing_cluster_wins():
    scores = Table({fs("a", "b", "c"): -1.0, fs("b", "c"): -1.0, fs("a", "c"): -0.5, fs("a", "b"): -0.7})
    assert ClusterSelector(scores, C.singletons(["a", "b", "c"]), 2, fast_mode=False).fit().taken == [1]


def test_cluster_too_large_leads_to_feature_level():
    clusters = {0: ["a", "b", "c"], 1: ["d"]}
    scores = Table({fs("a", "b", "c", "d"): -1.0, fs("d"): -0.1, fs("a", "b", "c"): -5.0, fs("b", "c", "d"): -2.0, fs("a", "c", "d"): -1.0})
    got = ClusterSelector(scores, clusters, 3).fit()
    # removing the large cluster would leave too few; of its features b is not inferior
    assert got.selected == ["a", "c", "d"] and got.clusters == {0: ["a", "c"], 1: ["d"], 2: ["b"]}
    assert ("feature_level_evaluated_features", 0, 0, 2.0) in got.log


def test_fallback_and_early_stopping():
    clusters = {0: ["a", "b"], 1: ["c"]}
    table = {fs("a", "b", "c"): -1.0, fs("c"): -2.0, fs("a", "b"): -4.0, fs("b", "c"): -3.0, fs("a", "c"): -1.5}
    got = ClusterSelector(Table(table), clusters, 2).fit()
    assert got.selected == ["a", "c"]
    assert ("feature_level_none_non-inferior_iteration", 0, 0, 0.0) in got.log
    stopped = ClusterSelector(Table(table), clusters, 2, early_stopping=True).fit()
    assert stopped.selected == ["a", "b", "c"] and stopped.taken == []


def test_forward_baseline_is_all_clusters_then_previous_winner():
    table = Table({fs("a", "b", "c"): -1.0, fs("a"): -3.0, fs("b"): -2.0, fs("c"): -4.0, fs("a", "b"): -1.5, fs("b", "c"): -2.5})
    got = ClusterSelector(table, C.singletons(["a", "b", "c"]), 2, direction="forward").fit()
    assert got.selected == ["b", "a"] and got.taken == [1, 0]


def test_fixed_features_and_checks(scorer):
    got = ClusterSelector(scorer, C.singletons(["b", "c", "d"]), 1, fixed=["a"]).fit()
    assert got.selected[0] == "a" and len(got.selected) == 2
    with pytest.raises(ValueError, match="disjoint"):
        ClusterSelector(scorer, C.singletons(["a"]), 1, fixed=["a"])
    with pytest.raises(ValueError, match="larger"):
        ClusterSelector(scorer, C.singletons(["a"]), 2)
    with pytest.raises(ValueError):
        ClusterSelector(scorer, C.singletons(["a"]), 1, direction="sideways")


def test_resume_repeats_the_same_selection(spark, scorer):
    clusters = {0: ["a", "e"], 1: ["b", "c"], 2: ["d"]}
    full = ClusterSelector(scorer, clusters, 1, fast_mode=False).fit()
    for at in range(1, len(full.taken)):
        again = ClusterSelector(scorer, clusters, 1, fast_mode=False).resume(full.metrics_frame(spark), full.clusters, at).fit()
        assert again.taken[:at] == full.taken[:at]
        assert again.selected == full.selected
        counted = [r for r in again.log if r[0] == "selected_cluster_id"]
        assert len(counted) == len(again.taken)


def test_sequential_selection(scorer):
    best = max(itertools.combinations(FEATURES, 1), key=lambda s: scorer.point_score(list(s)))
    assert sequential_selection(scorer, FEATURES, 1) == list(best)
    assert len(sequential_selection(scorer, FEATURES, 3, "backward")) == 3
    with pytest.raises(ValueError):
        sequential_selection(scorer, FEATURES, 0)


def test_aggregation_modes():
    x = np.array([1.0, 2.0, 10.0])
    assert [aggregate_scores(x, m) for m in ("min", "max", "median", "p=50")] == [1, 10, 2, 2]
    with pytest.raises(ValueError):
        aggregate_scores(x, "mode")


def test_transform(scorer, frame):
    got = ClusterSelector(scorer, C.singletons(FEATURES), 2).fit()
    assert got.transform(frame).columns == got.get_feature_names_out() == got.selected


def test_median_linkage():
    # two tight pairs far apart
    points = np.array([[0.0], [0.05], [1.0], [1.04]])
    distance = np.abs(points - points.T)
    labels = C.median_linkage_groups(distance, 0.1)
    assert labels[0] == labels[1] != labels[2] == labels[3]
    assert len(set(C.median_linkage_groups(distance, 0.0))) == 4
    assert len(set(C.median_linkage_groups(distance, 2.0))) == 1
    # an equilateral triangle: the second merge is lower (0.866) than the first (1.0);
    # the largest height in the subtree decides, so a cut between them joins nothing
    triangle = np.ones((3, 3)) - np.eye(3)
    assert len(set(C.median_linkage_groups(triangle, 0.9))) == 3
    assert len(set(C.median_linkage_groups(triangle, 1.0))) == 1


def scanned_groups(distance, cut):
    """Median linkage that looks at every pair before each merge."""
    groups = {i: ([i], 0.0) for i in range(len(distance))}
    d = {(i, j): distance[i][j] for i in groups for j in groups if i < j}
    label = list(groups)
    while len(groups) > 1:
        (i, j), height = min(d.items(), key=lambda x: (x[1], x[0]))
        for k in groups:
            if k not in (i, j):
                a, b = d[min(i, k), max(i, k)], d[min(j, k), max(j, k)]
                d[min(i, k), max(i, k)] = max(0.0, a * a / 2 + b * b / 2 - height * height / 4) ** 0.5
        d = {pair: v for pair, v in d.items() if j not in pair}
        members, peak = groups[i][0] + groups[j][0], max(groups[i][1], groups[j][1], height)
        del groups[j]
        groups[i] = (members, peak)
        if peak <= cut:
            for m in members:
                label[m] = min(members)
    return label


@pytest.mark.parametrize("seed", range(12))
def test_median_linkage_equals_scanning_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 30))
    # random matrices, points in space, and few values so that most pairs are tied
    distance = [rng.random((n, n)), np.linalg.norm(rng.normal(size=(n, 1, 2)) - rng.normal(size=(1, n, 2)), axis=2), rng.integers(0, 4, (n, n)).astype(float)][seed % 3]
    distance = np.maximum(distance, distance.T)
    np.fill_diagonal(distance, 0)
    for cut in (0.1, 0.6, 1.0, 3.0):
        assert C.median_linkage_groups(distance, cut) == scanned_groups(distance, cut)


def test_clusters(spark, frame, table):
    corr = correlation_matrix(frame, FEATURES)
    np.testing.assert_allclose(corr, table[FEATURES].corr(), atol=1e-9)
    assert C.feature_clusters(frame, FEATURES, "correlation") == {0: ["a", "e"], 1: ["b"], 2: ["c"], 3: ["d"]}
    pair = C.correlation_clusters(["w_sin", "w_cos", "sinus"], np.eye(3))
    assert pair == {0: ["w_sin", "w_cos"], 1: ["sinus"]}
    with pytest.raises(ValueError):
        C.correlation_clusters(["a", "b"], np.array([[1, np.nan], [np.nan, 1]]))
    assert C.packed_clusters(["p", "w_sin", "q", "w_cos", "r"], 2) == {0: ["r", "q"], 1: ["w_sin", "w_cos"], 2: ["p"]}
    with pytest.raises(ValueError):
        C.feature_clusters(frame, FEATURES, "random")
    with pytest.raises(RuntimeError):
        C.check_coverage({0: ["a"]}, ["a", "b"])
    packed = C.feature_clusters(frame, FEATURES, "random", group_size=2, seed=1)
    assert packed == C.feature_clusters(frame, FEATURES, "random", group_size=2, seed=1)


def test_scores(spark, frame, table):
    pairs = {(r.feature_a, r.feature_b): r.r for r in correlation_pairs(frame, ["a", "b"]).collect()}
    assert pairs[("a", "b")] == pytest.approx(table.a.corr(table.b))
    holes = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 4.0)], "p double, q double")
    assert correlation_pairs(holes, ["p", "q"]).first().r == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 4])[0, 1])
    flat = frame.withColumn("flat", F.lit(1.0)).withColumn("twin", F.col("y") * 2)
    scores = {r.feature: r.score for r in f_scores(flat, ["a", "flat", "twin"], "y").collect()}
    r = table.a.corr(table.y)
    assert scores["a"] == pytest.approx(r * r / (1 - r * r) * 598, rel=1e-6)
    assert scores["flat"] == 0.0 and scores["twin"] > 1e12
    best = [r.feature for r in select_k_best(f_scores(frame, FEATURES, "y"), 2).collect()]
    assert set(best) == {"a", "e"}
    ranked = {r.feature: r.score for r in mutual_information(frame, FEATURES, "y", 8).collect()}
    assert ranked["a"] > ranked["b"] > ranked["d"]


def test_estimators(spark, frame):
    with pytest.raises(NotImplementedError):
        build_estimator(["a"], "y", "gp")
    with pytest.raises(ValueError):
        build_estimator(["a"], "y", "rf", {"x_scaler": "odd"})
    best, trials = tune(frame, ["a", "b"], "y", [F.col("row_id")], [F.floor(F.col("row_id") / 100)], "rf", {"maxDepth": [1, 4], "numTrees": [4]}, start={"maxDepth": 4, "numTrees": 4})
    assert best["maxDepth"] == 4 and trials.count() == 2
    scored = ModelScorer(frame, FEATURES, "y", "row_id", family="linear", params={"x_scaler": "minmax", "y_transform": "minmax"}, replicates=5)
    good, bad = scored.score_many([["a", "b"], ["d"]])
    assert np.median(good) > np.median(bad)
    assert scored.point_score(["a", "b"]) == pytest.approx(-0.6, abs=0.15)
    scored.close()
    records = test_fits(frame.filter("split = 'train'"), frame.filter("split = 'val'"), ["a"], "y", "row_id", "linear", fits=2, replicates=3, metrics=["rmse", "mae"])
    assert records.count() == 12 and records.select("key").distinct().count() == 2
