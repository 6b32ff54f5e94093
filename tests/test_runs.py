import pytest
from pyspark.errors import PySparkException

from seriesmill.catalog.literature import FEATURE_CATEGORIES, IMPLIED_FEATURE, MODEL_CATEGORIES, SHORT_NAMES, item_to_category
from seriesmill.functions import text as X
from seriesmill.operators import literature as L
from seriesmill.operators import runs as R
from seriesmill.operators.aggregates import list_statistics
from seriesmill.operators.sets import filter_runs, is_better, jaccard, list_runs
from pyspark.sql import functions as F

SCHEMA = "run string, key string, step int, idx int, value double"


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [("r1", "testing/rmse", s, i, 10.0 * s + i) for s in (0, 1) for i in (0, 1)]
    rows += [("r2", "testing/rmse", 0, 0, 4.0)]
    for run, shift in (("r1", 0.5), ("r2", -0.5)):
        for it in (0, 1):
            for i in range(4):
                rows.append((run, f"validation/{it}/baseline/neg_rmse", it, i, -2.0))
                rows.append((run, f"validation/{it}/{it}/neg_rmse", it, i, -2.0 + shift))
        rows += [(run, "selected_cluster_id", 0, 0, 0.0), (run, "selected_cluster_id", 1, 0, 1.0)]
    rows += [("r1", "fast_stop_iteration", 0, 0, 0.0), ("r1", "fast_stop_iteration", 1, 0, 1.0)]
    rows += [("r2", "feature_level_iteration", 0, 0, 0.0), ("r2", "feature_level_none_non-inferior_iteration", 0, 0, 0.0)]
    rows += [("r2", "feature_level_evaluated_features", 0, 0, 5.0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def tables(spark):
    runs = spark.createDataFrame([("r1", "success"), ("r2", "success"), ("r3", "failed")], "run string, status string")
    features = spark.createDataFrame([("r1", ["b", "a"]), ("r3", ["z"])], "run string, features array<string>")
    return runs, features


def test_results(metrics, tables):
    got = {r.run: r for r in R.build_results(*tables[:1], metrics, tables[1], ["rmse", "mae"]).collect()}
    assert set(got) == {"r1", "r2"}
    assert got["r1"].rmse == [0.0, 1.0, 10.0, 11.0] and got["r1"].mae is None
    assert got["r1"].selected_features == ["b", "a"] and got["r2"].selected_features is None
    assert (got["r1"].fast_stops, got["r1"].total_iterations, got["r1"].fitted_models, got["r1"].fallbacks) == (2, 2, 3, 0)
    assert (got["r2"].fallbacks, got["r2"].feature_level_total_evaluated, got["r2"].safe_removals) == (1, 5, 0)
    for mode, value in (("min", 0.0), ("avg", 5.5), ("median", 5.5), ("p=100", 11.0)):
        one = R.build_results(tables[0], metrics, tables[1], ["rmse"], mode).filter("run = 'r1'").first()
        assert one.rmse == value


def test_explanations(spark, metrics):
    clusters = spark.createDataFrame([(r, c, [f"f{c}"]) for r in ("r1", "r2") for c in (0, 1)], "run string, cluster_id int, features array<string>")
    texts = R.explanations(metrics, clusters)
    got = {r.run: r.explanation for r in texts.collect()}
    assert got["r1"].startswith("Iteration 0 | Cluster (id=0): [f0]\nReason: Passed non-inferiority test -> stopped early.\nCluster ID: 0 | RMSE: 1.5 |")
    assert "0.500 (0.500 - 0.500)" in got["r1"] and "\n\nIteration 1" in got["r1"]
    assert "Best median score. Didn't pass non-inferiority test." in got["r2"]
    assert R.best_explanation(metrics, texts).first().run == "r2"


def test_appending(spark, metrics):
    new = spark.createDataFrame([("r1", "testing/rmse", 0, 0, 99.0), ("r9", "x", 0, 0, 1.0)], SCHEMA)
    both = R.append_metrics(metrics, new)
    assert both.filter("value = 99").first().step == 2 and both.filter("run = 'r9'").first().step == 0
    assert R.append_metrics(metrics, new, "overwrite").filter("run = 'r1' AND key = 'testing/rmse'").count() == 1
    with pytest.raises(PySparkException, match="already exists"):
        R.append_metrics(metrics, new, "error").collect()
    with pytest.raises(ValueError):
        R.append_metrics(metrics, new, "maybe")
    numbered = R.next_steps(new.drop("step"), ["idx"])
    assert {r.step for r in numbered.collect()} == {0}


def test_keys(metrics):
    assert R.has_key(metrics, "testing/rmse") and not R.has_key(metrics, "testing")
    assert R.has_key(metrics, "testing", strict=False) and not R.has_key(metrics, "test", strict=False)
    assert R.records_below(metrics, "validation/0").select("key").distinct().count() == 2
    copied = R.copy_records(metrics, "validation/0/0", "validation/1/baseline2")
    assert copied.filter("key = 'validation/1/baseline2/neg_rmse'").count() == 8


def test_best_run(metrics):
    assert R.best_run(metrics, "testing/rmse", "min").first().run == "r1"
    assert R.best_run(metrics, "testing/rmse", 4.5).first().run == "r2"
    assert R.best_run(metrics, "nothing", "max").count() == 0


def test_agreement(spark):
    rows = [("g", "A", 1, ["x", "y"]), ("g", "A", 2, ["z"]), ("g", "B", 1, ["x"]), ("h", "A", 1, ["q"]), ("h", "B", 1, ["q"])]
    runs = spark.createDataFrame(rows, "grp string, method string, k int, sel array<string>")
    pairs = R.method_pairs(runs, "method", "sel", ["grp"], ["k"])
    assert sorted(r.score for r in pairs.collect()) == [0.5, 1.0]
    matrix = {r.method: r for r in R.agreement_matrix(pairs, ["A", "B", "C"]).collect()}
    assert matrix["A"]["B"] == matrix["B"]["A"] == 0.75 and matrix["C"]["C"] == 1.0 and matrix["A"]["C"] is None
    with pytest.raises(ValueError):
        R.agreement(pairs, "sum")


def test_relative_gain(spark):
    runs = spark.createDataFrame([("m", "random", 50.0), ("m", "singletons", 100.0), ("n", "singletons", 10.0)], "model string, c string, fs_runtime double")
    gains = R.relative_gain(runs, "c", ["random"], "singletons", ["model"])
    assert sorted((r.model, r.gain) for r in gains.collect()) == [("m", 50.0), ("n", None)]
    row = R.gain_summary(gains).first()
    assert row.median == 50.0 and row.text.startswith("$50.0\\%")


def test_small_pieces(spark):
    one = spark.range(1)
    pick = lambda *c: one.select(*c).first()
    assert pick(X.value_and_error(F.lit(1.5), F.lit(0.25), 2, True).alias("t")).t == "$\\textcolor{darkred}{1.50 \\pm 0.25}$"
    parsed = pick(X.parse_name(F.lit("a=1_b=x=y_flag_a=2")).alias("p")).p
    assert parsed == {"a": "2", "b": "x=y", "flag": "True"}
    assert tuple(pick(jaccard(F.array(), F.array()), is_better(F.lit(None).cast("double"), F.lit(1.0), "max"), is_better(F.lit(1.0), F.lit(None), "min"))) == (1.0, False, True)
    stats = list_statistics(F.array(F.lit(1.0), F.lit(3.0)))
    assert tuple(pick(stats["mean"], stats["std"])) == (2.0, 1.0)
    assert pick(X.key_part(F.lit("/a/b"), 1), X.key_part(F.lit("a/b"), 5))[1] is None
    runs = spark.createDataFrame([(f"n{i}", i % 2) for i in range(9)], "name string, k int")
    assert [r.name for r in list_runs(runs, "name", 2, 6, 3).collect()] == ["n2", "n3", "n4"]
    assert filter_runs(runs, "n[0-4]", "n3", k=1).count() == 1


def test_literature(spark):
    rows = [
        ("d1", "Wind Speed Only", "RF, ANN", True),
        ("d2", "No Wind Speed, Wind Direction", "RF", True),
        ("d3", "Wind Direction , inflow angle", "Unheard", True),
        ("d4", "Voltage", "SVR", False),
    ]
    papers = spark.createDataFrame(rows, "doi string, `Used Features` string, `Used Models` string, ok boolean")
    kept = L.add_implied_feature(L.included_papers(papers, ["ok"]), "Used Features", **IMPLIED_FEATURE)
    pairs = sorted((r.doi, r.item) for r in L.listed_items(kept, "doi", "Used Features").collect())
    assert pairs == [("d1", "Wind Speed"), ("d2", "No Wind Speed"), ("d2", "Wind Direction"), ("d3", "Wind Direction"), ("d3", "Wind Speed"), ("d3", "inflow angle")]
    counts = {r.item: r["count"] for r in L.category_counts(kept, "doi", "Used Features", item_to_category(FEATURE_CATEGORIES)).collect()}
    assert counts == {"Wind Speed": 2, "Inflow Direction": 2, "Others": 1}
    models = {r.item: r["count"] for r in L.category_counts(kept, "doi", "Used Models", item_to_category(MODEL_CATEGORIES)).collect()}
    assert models == {"Tree-based": 2, "Others": 2}
    top = L.top_items(kept, "doi", "Used Features", SHORT_NAMES["feature"], 1).first()
    assert (top.item, top["count"]) == ("Wind Dir.", 2)
    inside = L.members_of(kept, "doi", "Used Features", FEATURE_CATEGORIES, ["Inflow Direction"])
    assert sorted((r.item, r["count"]) for r in inside.collect()) == [("Wind Direction", 2), ("inflow angle", 1)]
    assert {r.n_items: r.n_papers for r in L.usage_distribution(kept, "doi", "Used Features").collect()} == {1: 1, 2: 1, 3: 1}
    assert L.availability(papers, "doi", ["d1"]).first().percent == 25.0
