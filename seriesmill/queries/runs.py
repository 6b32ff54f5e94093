"""Analytics over run tables derived from suppliers and their line items.

A run is a supplier.  Its settings come from the supplier key, its test metrics
and loop records from the supplier's line items, its features from the brands
it sells.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesmill.functions.text import CLUSTERWISE, METHOD_LABELS, method_family, method_label, scenario_label
from seriesmill.operators import runs as R
from seriesmill.operators.aggregates import box_statistics, ratio_of_sums
from seriesmill.queries.registry import load, query, rounded
from seriesmill.session import checkpoint_folder
from seriesmill.sources.metric_store import read_metrics, write_metrics

RUNS_SQL = """
runs AS (
  SELECT 'run_' || s_suppkey AS run, s_suppkey AS k, CASE WHEN s_suppkey % 10 = 9 THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN s_suppkey % 2 = 0 THEN 'wind' ELSE 'pv' END AS domain,
         CASE WHEN s_suppkey % 4 < 2 THEN 'digital_twin' ELSE 'forecast_available' END AS type,
         CASE s_suppkey % 3 WHEN 0 THEN 'mlp' WHEN 1 THEN 'lgbm' ELSE 'rf' END AS model,
         CASE WHEN s_suppkey % 7 < 4 THEN 'clusterwise' WHEN s_suppkey % 7 = 4 THEN 'mutual_info' WHEN s_suppkey % 7 = 5 THEN 'f_value' ELSE 'RF_FI' END AS method,
         CASE s_suppkey % 7 WHEN 0 THEN 'feature_importance' WHEN 1 THEN 'correlation' WHEN 2 THEN 'random' WHEN 3 THEN 'singletons' END AS clustering,
         CASE WHEN s_suppkey % 5 < 3 THEN 10 ELSE 2 END AS n_features, s_acctbal + 2000 AS fs_runtime
  FROM supplier),
labelled AS (
  SELECT *, CASE domain WHEN 'wind' THEN 'WT' ELSE 'PV' END || CASE type WHEN 'digital_twin' THEN '-S1' ELSE '-S2' END AS scenario,
         CASE WHEN clustering = 'feature_importance' THEN 'CW' || chr(10) || '(FI)' WHEN clustering = 'correlation' THEN 'CW' || chr(10) || '(corr.)'
              WHEN clustering = 'random' THEN 'CW' || chr(10) || '(rnd.)' WHEN clustering = 'singletons' THEN 'SFS'
              WHEN method = 'mutual_info' THEN 'MI' WHEN method = 'f_value' THEN 'F-value' ELSE 'RF FI' END AS label
  FROM runs)
"""

TESTING_SQL = """
testing AS (
  SELECT 'run_' || l_suppkey AS run, CASE l_linenumber % 3 WHEN 1 THEN 'testing/rmse' WHEN 2 THEN 'testing/mae' ELSE 'testing/r2' END AS key,
         l_linenumber AS step, l_orderkey AS idx, l_extendedprice / 1000 AS value
  FROM lineitem)
"""

SCORES_SQL = """
scores AS (
  SELECT 'run_' || l_suppkey AS run, l_orderkey % 3 AS iteration, CASE l_partkey % 4 WHEN 0 THEN 'baseline' ELSE cast(l_partkey % 4 AS VARCHAR) END AS candidate,
         l_linenumber AS idx, round(-avg(l_extendedprice) / 1000, 9) AS neg_rmse
  FROM lineitem GROUP BY 1, 2, 3, 4)
"""

LOOP_SQL = """
grp AS (SELECT 'run_' || l_suppkey AS run, l_orderkey % 3 AS iteration, count(*) AS n FROM lineitem GROUP BY 1, 2),
loop AS (
  SELECT run, 'selected_cluster_id' AS key, iteration AS step, n % 4 AS value FROM grp
  UNION ALL SELECT run, 'fast_stop_iteration', iteration, iteration FROM grp WHERE n % 3 = 0
  UNION ALL SELECT run, 'feature_level_iteration', iteration, iteration FROM grp WHERE n % 3 = 1
  UNION ALL SELECT run, 'feature_level_evaluated_features', iteration, n % 5 FROM grp WHERE n % 3 = 1
  UNION ALL SELECT run, 'feature_level_none_non-inferior_iteration', iteration, iteration FROM grp WHERE n % 6 = 1)
"""


def run_table(spark, folder):
    k = F.col("s_suppkey")
    clustering = F.when(k % 7 == 0, "feature_importance").when(k % 7 == 1, "correlation").when(k % 7 == 2, "random").when(k % 7 == 3, "singletons")
    method = F.when(k % 7 < 4, CLUSTERWISE).when(k % 7 == 4, "mutual_info").when(k % 7 == 5, "f_value").otherwise("RF_FI")
    runs = load(spark, folder, "supplier").select(
        F.concat(F.lit("run_"), k.cast("string")).alias("run"),
        F.when(k % 10 == 9, "failed").otherwise("success").alias("status"),
        F.when(k % 2 == 0, "wind").otherwise("pv").alias("domain"),
        F.when(k % 4 < 2, "digital_twin").otherwise("forecast_available").alias("type"),
        F.when(k % 3 == 0, "mlp").when(k % 3 == 1, "lgbm").otherwise("rf").alias("model"),
        method.alias("method"),
        clustering.alias("clustering"),
        F.when(k % 5 < 3, 10).otherwise(2).alias("n_features"),
        (F.col("s_acctbal") + 2000).alias("fs_runtime"),
        k.alias("k"),
    )
    return runs.withColumns(
        {
            "scenario": scenario_label(F.col("domain"), F.col("type")),
            "label": method_label(F.col("method"), F.col("clustering"), METHOD_LABELS),
        }
    )


def _run_of_item():
    return F.concat(F.lit("run_"), F.col("l_suppkey").cast("string")).alias("run")


def testing_metrics(spark, folder):
    kind = F.col("l_linenumber") % 3
    key = F.when(kind == 1, "testing/rmse").when(kind == 2, "testing/mae").otherwise("testing/r2")
    return load(spark, folder, "lineitem").select(
        _run_of_item(), key.alias("key"), F.col("l_linenumber").alias("step"), F.col("l_orderkey").alias("idx"), (F.col("l_extendedprice") / 1000).alias("value")
    )


def validation_metrics(spark, folder):
    candidate = F.when(F.col("l_partkey") % 4 == 0, "baseline").otherwise((F.col("l_partkey") % 4).cast("string"))
    grouped = load(spark, folder, "lineitem").groupBy(
        _run_of_item(), (F.col("l_orderkey") % 3).alias("iteration"), candidate.alias("candidate"), F.col("l_linenumber").cast("long").alias("idx")
    ).agg(rounded(-F.avg("l_extendedprice") / 1000, 9).alias("value"))
    key = F.concat_ws("/", F.lit("validation"), F.col("iteration").cast("string"), "candidate", F.lit("neg_rmse"))
    return grouped.select("run", key.alias("key"), F.col("iteration").cast("int").alias("step"), "idx", "value")


def loop_metrics(spark, folder):
    groups = load(spark, folder, "lineitem").groupBy(_run_of_item(), (F.col("l_orderkey") % 3).alias("iteration")).agg(F.count(F.lit(1)).alias("n"))
    n, it = F.col("n"), F.col("iteration")
    records = [
        (F.lit(True), "selected_cluster_id", n % 4),
        (n % 3 == 0, "fast_stop_iteration", it),
        (n % 3 == 1, "feature_level_iteration", it),
        (n % 3 == 1, "feature_level_evaluated_features", n % 5),
        (n % 6 == 1, "feature_level_none_non-inferior_iteration", it),
    ]
    cells = F.array(*[F.when(when, F.struct(F.lit(key).alias("key"), value.cast("double").alias("value"))) for when, key, value in records])
    return groups.select("run", it.cast("int").alias("step"), F.inline(F.array_compact(cells))).select(
        "run", "key", "step", F.lit(0).cast("long").alias("idx"), "value"
    )


def all_metrics(spark, folder):
    return testing_metrics(spark, folder).unionByName(validation_metrics(spark, folder)).unionByName(loop_metrics(spark, folder))


def run_features(spark, folder):
    parts = load(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    sold = load(spark, folder, "lineitem").join(parts, "l_partkey")
    return sold.groupBy(_run_of_item()).agg(F.sort_array(F.collect_set("p_brand")).alias("features"))


FEATURES_SQL = """
feats AS (SELECT 'run_' || l_suppkey AS run, list_sort(list(DISTINCT p_brand)) AS features
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
"""


@query(
    f"""
    WITH {RUNS_SQL}, {TESTING_SQL}, {FEATURES_SQL}, {LOOP_SQL}, {SCORES_SQL},
    t AS (SELECT run, round(median(value) FILTER (key = 'testing/rmse'), 8) AS rmse, round(median(value) FILTER (key = 'testing/mae'), 8) AS mae FROM testing GROUP BY 1),
    c AS (SELECT run, count(*) FILTER (key = 'fast_stop_iteration') AS fast_stops, count(*) FILTER (key = 'selected_cluster_id') AS total_iterations FROM loop GROUP BY 1),
    m AS (SELECT run, count(DISTINCT (iteration, candidate)) FILTER (candidate <> 'baseline') + 1 AS fitted FROM scores GROUP BY 1)
    SELECT run, domain, type, model, n_features, rmse, mae, coalesce(array_to_string(features, ','), '') AS features, fast_stops, total_iterations, fitted AS fitted_models
    FROM runs LEFT JOIN t USING (run) LEFT JOIN feats USING (run) LEFT JOIN c USING (run) LEFT JOIN m USING (run) WHERE status = 'success'
    """
)
def results_table(spark, folder):
    """One row per successful run with settings, metrics, features and counters."""
    results = R.build_results(
        run_table(spark, folder), all_metrics(spark, folder), run_features(spark, folder), ["rmse", "mae"], "median"
    )
    return results.select(
        "run", "domain", "type", "model", "n_features", rounded("rmse", 8).alias("rmse"), rounded("mae", 8).alias("mae"),
        F.coalesce(F.array_join("selected_features", ","), F.lit("")).alias("features"), "fast_stops", "total_iterations", "fitted_models",
    )


@query(
    f"""
    WITH {LOOP_SQL}, {SCORES_SQL},
    m AS (SELECT run, count(DISTINCT (iteration, candidate)) FILTER (candidate <> 'baseline') + 1 AS fitted_models FROM scores GROUP BY 1),
    c AS (SELECT run, count(*) FILTER (key = 'feature_level_iteration') AS feature_level_entries,
           count(*) FILTER (key = 'fast_stop_iteration') AS fast_stops, count(*) FILTER (key = 'selected_cluster_id') AS total_iterations,
           count(*) FILTER (key = 'feature_level_none_non-inferior_iteration') AS fallbacks,
           cast(coalesce(sum(value) FILTER (key = 'feature_level_evaluated_features'), 0) AS BIGINT) AS feature_level_total_evaluated,
           count(*) FILTER (key = 'feature_level_iteration') - count(*) FILTER (key = 'feature_level_none_non-inferior_iteration') AS safe_removals
    FROM loop GROUP BY 1)
    SELECT c.*, fitted_models FROM c LEFT JOIN m USING (run)
    """
)
def loop_counters(spark, folder):
    """All counters of each run's selection loop."""
    return R.loop_counters(validation_metrics(spark, folder).unionByName(loop_metrics(spark, folder)))


@query(
    f"""
    WITH {LOOP_SQL},
    k AS (SELECT run, value AS iteration, max(CASE WHEN key = 'fast_stop_iteration' THEN 1 ELSE 0 END) AS a,
                 max(CASE WHEN key = 'feature_level_none_non-inferior_iteration' THEN 1 ELSE 0 END) AS b, max(CASE WHEN key = 'feature_level_iteration' THEN 1 ELSE 0 END) AS c
          FROM loop WHERE key IN ('fast_stop_iteration', 'feature_level_none_non-inferior_iteration', 'feature_level_iteration') GROUP BY 1, 2)
    SELECT l.run, cast(l.step AS INTEGER) AS iteration, cast(l.value AS INTEGER) AS cluster_id,
           CASE WHEN a = 1 THEN 'Passed non-inferiority test -> stopped early.' WHEN b = 1 THEN 'Best median score. Didn''t pass non-inferiority test.'
                WHEN c = 1 THEN 'Passed non-inferiority test -> stopped early.' ELSE '' END AS reason
    FROM loop l LEFT JOIN k ON k.run = l.run AND k.iteration = l.step WHERE l.key = 'selected_cluster_id'
    """
)
def selection_reasons(spark, folder):
    """Why each round took its cluster."""
    return R.decisions(loop_metrics(spark, folder))


@query(
    f"""
    WITH {SCORES_SQL}
    SELECT a.run, cast(a.iteration AS INTEGER) AS iteration, a.candidate, round(median(-a.neg_rmse), 12) + 0.0 AS rmse,
           round(median(a.neg_rmse - b.neg_rmse), 12) + 0.0 AS diff_median,
           round(quantile_cont(a.neg_rmse - b.neg_rmse, 0.05), 12) + 0.0 AS diff_p05, round(quantile_cont(a.neg_rmse - b.neg_rmse, 0.95), 12) + 0.0 AS diff_p95
    FROM scores a JOIN scores b ON a.run = b.run AND a.iteration = b.iteration AND a.idx = b.idx AND b.candidate = 'baseline' GROUP BY 1, 2, 3
    """
)
def candidate_differences(spark, folder):
    """Paired score differences of every candidate in every round."""
    found = R.candidate_differences(validation_metrics(spark, folder))
    return found.select("run", "iteration", "candidate", *[rounded(c, 12).alias(c) for c in ("rmse", "diff_median", "diff_p05", "diff_p95")])


def _clusters(spark, folder):
    runs = run_table(spark, folder).select("run", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cluster_id"))
    return runs.withColumn("features", F.array(F.concat(F.lit("f"), F.col("cluster_id").cast("string")), F.lit("g")))


TEXTS_SQL = f"""
{SCORES_SQL}, {LOOP_SQL},
lines AS (
  SELECT run, iteration, string_agg(printf('Cluster ID: %s | RMSE: %.11f | Difference Median (P05-P95) = %.3f (%.3f - %.3f)', candidate, rmse, dm, lo, hi), chr(10) ORDER BY candidate) AS lines
  FROM (SELECT a.run, a.iteration, a.candidate, median(-a.neg_rmse) AS rmse, median(a.neg_rmse - b.neg_rmse) AS dm,
               quantile_cont(a.neg_rmse - b.neg_rmse, 0.05) AS lo, quantile_cont(a.neg_rmse - b.neg_rmse, 0.95) AS hi
        FROM scores a JOIN scores b ON a.run = b.run AND a.iteration = b.iteration AND a.idx = b.idx AND b.candidate = 'baseline' GROUP BY 1, 2, 3)
  GROUP BY 1, 2),
flags AS (SELECT run, value AS iteration, bool_or(key = 'fast_stop_iteration') AS a, bool_or(key = 'feature_level_none_non-inferior_iteration') AS b, bool_or(key = 'feature_level_iteration') AS c
          FROM loop WHERE key IN ('fast_stop_iteration', 'feature_level_none_non-inferior_iteration', 'feature_level_iteration') GROUP BY 1, 2),
blocks AS (
  SELECT l.run, l.step AS iteration,
         printf('Iteration %d | Cluster (id=%d): [f%d, g]', l.step::BIGINT, l.value::BIGINT, l.value::BIGINT)
         || CASE WHEN a THEN chr(10) || 'Reason: Passed non-inferiority test -> stopped early.' WHEN b THEN chr(10) || 'Reason: Best median score. Didn''t pass non-inferiority test.'
                 WHEN c THEN chr(10) || 'Reason: Passed non-inferiority test -> stopped early.' ELSE '' END || chr(10) || lines AS block
  FROM loop l LEFT JOIN flags f ON f.run = l.run AND f.iteration = l.step JOIN lines ON lines.run = l.run AND lines.iteration = l.step WHERE l.key = 'selected_cluster_id'),
texts AS (SELECT run, string_agg(block, chr(10) || chr(10) ORDER BY iteration) AS explanation FROM blocks GROUP BY 1)
"""


@query(f"WITH {TEXTS_SQL} SELECT run, explanation FROM texts")
def selection_explanations(spark, folder):
    """The whole decision text of each run."""
    metrics = validation_metrics(spark, folder).unionByName(loop_metrics(spark, folder))
    return R.explanations(metrics, _clusters(spark, folder), 11)


@query(
    f"""
    WITH {TESTING_SQL}, {TEXTS_SQL}, m AS (SELECT run, avg(value) AS v FROM testing WHERE key = 'testing/rmse' GROUP BY 1)
    SELECT run, round(v, 8) AS mean_metric, explanation FROM m JOIN texts USING (run) ORDER BY v, run LIMIT 1
    """
)
def explanation_of_best_run(spark, folder):
    """The explained run with the lowest mean error."""
    metrics = validation_metrics(spark, folder).unionByName(loop_metrics(spark, folder))
    texts = R.explanations(metrics, _clusters(spark, folder), 11)
    return R.best_explanation(testing_metrics(spark, folder), texts).select("run", rounded("mean_metric", 8).alias("mean_metric"), "explanation")


PAIR_SCORES_SQL = f"""
{RUNS_SQL}, {FEATURES_SQL},
firsts AS (SELECT * FROM (SELECT l.*, f.features, row_number() OVER (PARTITION BY n_features, domain, model, type, label ORDER BY k) AS rn
                          FROM labelled l JOIN feats f USING (run)) WHERE rn = 1),
pairs AS (SELECT a.n_features, a.domain, a.model, a.type, a.label AS method_a, b.label AS method_b,
                 len(list_intersect(a.features, b.features)) / len(list_distinct(list_concat(a.features, b.features))) AS score
          FROM firsts a JOIN firsts b ON a.n_features = b.n_features AND a.domain = b.domain AND a.model = b.model AND a.type = b.type AND a.label < b.label)
"""


def _pairs(spark, folder):
    runs = run_table(spark, folder).join(run_features(spark, folder), "run")
    return R.method_pairs(runs, "label", "features", ["n_features", "domain", "model", "type"], ["k"])


@query(f"WITH {PAIR_SCORES_SQL} SELECT n_features, domain, model, type, method_a, method_b, round(score, 6) AS score FROM pairs")
def method_pair_similarity(spark, folder):
    """Similarity of the features two methods chose in the same setting."""
    return _pairs(spark, folder).withColumn("score", rounded("score"))


@query(
    f"""
    WITH {PAIR_SCORES_SQL}, a AS (SELECT method_a, method_b, avg(score) AS v FROM pairs GROUP BY 1, 2)
    SELECT method_a, method_b, round(v, 6) AS agreement FROM a UNION ALL SELECT method_b, method_a, round(v, 6) FROM a
    UNION ALL SELECT DISTINCT m, m, 1.0 FROM (SELECT method_a AS m FROM a UNION ALL SELECT method_b FROM a)
    """
)
def method_agreement(spark, folder):
    """Mean similarity per method pair, both directions and diagonal."""
    return R.agreement(_pairs(spark, folder), "mean").withColumn("agreement", rounded("agreement"))


METHODS = {"CW\n(FI)": "cw_fi", "CW\n(corr.)": "cw_corr", "CW\n(rnd.)": "cw_rnd", "SFS": "sfs", "MI": "mi", "F-value": "f_value", "RF FI": "rf_fi"}
MATRIX_SQL = ", ".join(f"CASE WHEN m = '{m}' THEN 1.0 ELSE coalesce(round((SELECT median(score) FROM s WHERE a = m AND b = '{m}'), 6), -1) END AS {n}" for m, n in METHODS.items())


@query(
    f"""
    WITH {PAIR_SCORES_SQL}, s AS (SELECT method_a AS a, method_b AS b, score FROM pairs UNION ALL SELECT method_b, method_a, score FROM pairs)
    SELECT m AS method, {MATRIX_SQL} FROM (VALUES {", ".join(f"('{m}')" for m in METHODS)}) v(m)
    """
)
def method_agreement_matrix(spark, folder):
    """Median similarity as a matrix of all methods."""
    matrix = R.agreement_matrix(_pairs(spark, folder), list(METHODS), "median")
    return matrix.select("method", *[F.coalesce(rounded(F.col(f"`{m}`")), F.lit(-1.0)).alias(n) for m, n in METHODS.items()])


def _gains_sql(ours: str, how: str) -> str:
    return f"""
{RUNS_SQL},
base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, n_features, scenario ORDER BY run) AS rn FROM labelled WHERE clustering = 'singletons') WHERE rn = 1),
gains AS (SELECT coalesce(o.scenario, b.scenario) AS scenario, 100 * (b.fs_runtime - o.fs_runtime) / b.fs_runtime AS gain
          FROM (SELECT * FROM labelled WHERE clustering IN ({ours})) o
          {how} JOIN base b ON o.model = b.model AND o.n_features = b.n_features AND o.scenario = b.scenario)
"""


@query(
    f"""
    WITH {_gains_sql("'feature_importance'", "RIGHT")}
    SELECT scenario, round(median(gain), 4) AS median, round(quantile_cont(gain, 0.025), 4) AS ci_low, round(quantile_cont(gain, 0.975), 4) AS ci_high,
           round(avg(gain), 4) AS mean_gain FROM gains GROUP BY 1
    """
)
def relative_runtime_gain(spark, folder):
    """Runtime gain of the importance clusters over the baseline per scenario; a scenario without a run has none."""
    gains = R.relative_gain(run_table(spark, folder), "clustering", ["feature_importance"], "singletons", ["model", "n_features", "scenario"], how="right", order="run")
    found = R.gain_summary(gains, "scenario")
    return found.select("scenario", *[rounded(c, 4).alias(c) for c in ("median", "ci_low", "ci_high", "mean_gain")])


@query(
    f"""
    WITH {_gains_sql("'feature_importance', 'correlation', 'random'", "LEFT")}
    SELECT round(avg(gain), 4) AS mean_gain, round(median(gain), 4) AS median, round(quantile_cont(gain, 0.025), 4) AS ci_low, round(quantile_cont(gain, 0.975), 4) AS ci_high FROM gains
    """
)
def overall_runtime_gain(spark, folder):
    """Runtime gain over all scenarios."""
    gains = R.relative_gain(
        run_table(spark, folder), "clustering", ["feature_importance", "correlation", "random"], "singletons",
        ["model", "n_features", "scenario"], how="left", order="run",
    )
    return R.gain_summary(gains).select(*[rounded(c, 4).alias(c) for c in ("mean_gain", "median", "ci_low", "ci_high")])


BEST_SQL = f"""
{RUNS_SQL}, {TESTING_SQL}, {FEATURES_SQL},
st AS (SELECT run, avg(value) FILTER (key = 'testing/rmse') AS rm, stddev_pop(value) FILTER (key = 'testing/rmse') AS rs,
              avg(value) FILTER (key = 'testing/mae') AS mm, stddev_pop(value) FILTER (key = 'testing/mae') AS ms FROM testing GROUP BY 1),
best AS (SELECT * FROM (SELECT l.*, st.*, feats.features, row_number() OVER (PARTITION BY scenario ORDER BY rm, l.run) AS rn
         FROM labelled l JOIN st ON st.run = l.run JOIN feats ON feats.run = l.run) WHERE rn = 1)
"""


BEST_ITEMS_SQL = r"""
i AS (
  SELECT scenario, 'feature ' || pos AS item, value FROM f
  UNION ALL SELECT scenario, 'label', label FROM best UNION ALL SELECT scenario, 'model', model FROM best
  UNION ALL SELECT scenario, 'rmse', printf('$%.4f \pm %.4f$', rm, rs) FROM best
  UNION ALL SELECT scenario, 'mae', printf('$%.4f \pm %.4f$', mm, ms) FROM best)
"""

SCENARIOS = {"WT-S1": "wt1", "WT-S2": "wt2", "PV-S1": "pv1", "PV-S2": "pv2"}


@query(
    f"""
    WITH {BEST_SQL}, f AS (SELECT scenario, unnest(features) AS value, unnest(range(len(features))) AS pos FROM best), {BEST_ITEMS_SQL} SELECT * FROM i
    """
)
def best_feature_items(spark, folder):
    """Features and metrics of the best run per scenario."""
    return R.best_features(
        run_table(spark, folder), testing_metrics(spark, folder), run_features(spark, folder), "scenario", ["rmse", "mae"], ["label", "model"], 4
    )


@query(
    f"""
    WITH {BEST_SQL}, f AS (SELECT scenario, unnest(features) AS value, unnest(range(len(features))) AS pos FROM best), {BEST_ITEMS_SQL}
    SELECT item, {", ".join(f"coalesce(max(value) FILTER (scenario = '{s}'), '') AS {n}" for s, n in SCENARIOS.items())} FROM i GROUP BY 1
    """
)
def best_feature_table(spark, folder):
    """The same as a table with scenarios as columns."""
    wide = R.best_features_table(best_feature_items(spark, folder), "scenario", list(SCENARIOS))
    return wide.select("item", *[F.coalesce(f"`{s}`", F.lit("")).alias(n) for s, n in SCENARIOS.items()])


@query(
    f"""
    WITH {RUNS_SQL}, {TESTING_SQL}, v AS (SELECT scenario, label, value AS rmse FROM testing JOIN labelled USING (run) WHERE key = 'testing/rmse'),
    q AS (SELECT scenario, label, count(*) AS n, quantile_cont(rmse, 0.25) AS q1, median(rmse) AS median, quantile_cont(rmse, 0.75) AS q3 FROM v GROUP BY 1, 2)
    SELECT scenario, label, n, round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3,
           round(min(rmse) FILTER (rmse >= q1 - 1.5 * (q3 - q1)), 8) AS whisker_low, round(max(rmse) FILTER (rmse <= q3 + 1.5 * (q3 - q1)), 8) AS whisker_high
    FROM v JOIN q USING (scenario, label) GROUP BY ALL
    """
)
def box_statistics_per_method(spark, folder):
    """Box-plot numbers of the error per scenario and method."""
    values = _errors(spark, folder)
    found = box_statistics(values, "rmse", ["scenario", "label"])
    return found.select("scenario", "label", "n", *[rounded(c, 8).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


BOX = ("q1", "median", "q3", "whisker_low", "whisker_high")
WHISKERS_SQL = "round(min({v}) FILTER ({v} >= q1 - 1.5 * (q3 - q1)), 8) AS whisker_low, round(max({v}) FILTER ({v} <= q3 + 1.5 * (q3 - q1)), 8) AS whisker_high"


def _errors(spark, folder):
    return R.metric_values(testing_metrics(spark, folder), run_table(spark, folder), "rmse")


@query(
    f"""
    WITH {RUNS_SQL}, {TESTING_SQL},
    v AS (SELECT n_features, CASE WHEN label LIKE 'CW%' THEN 'CW' ELSE label END AS family, value FROM testing JOIN labelled USING (run) WHERE key = 'testing/rmse'),
    q AS (SELECT n_features, family, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY 1, 2)
    SELECT n_features, family, n, round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3, {WHISKERS_SQL.format(v="value")}
    FROM v JOIN q USING (n_features, family) GROUP BY n_features, family, n, q1, median, q3
    """
)
def box_statistics_per_size(spark, folder):
    """Box-plot numbers per number of features and method family."""
    families = {"CW": ["CW\n(FI)", "CW\n(corr.)", "CW\n(rnd.)"]}
    values = _errors(spark, folder).withColumn("family", method_family(F.col("label"), families))
    found = box_statistics(values, "rmse", ["n_features", "family"])
    return found.select("n_features", "family", "n", *[rounded(c, 8).alias(c) for c in BOX])


@query(
    f"""
    WITH {RUNS_SQL}, v AS (SELECT label, fs_runtime / 60 AS minutes FROM labelled WHERE clustering IS NOT NULL),
    q AS (SELECT label, count(*) AS n, quantile_cont(minutes, 0.25) AS q1, median(minutes) AS median, quantile_cont(minutes, 0.75) AS q3 FROM v GROUP BY 1)
    SELECT label, n, round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3, {WHISKERS_SQL.format(v="minutes")} FROM v JOIN q USING (label) GROUP BY label, n, q1, median, q3
    """
)
def runtime_distribution(spark, folder):
    """Selection runtime in minutes per method."""
    runs = run_table(spark, folder).filter(F.col("clustering").isNotNull()).withColumn("minutes", F.col("fs_runtime") / 60)
    found = box_statistics(runs, "minutes", "label")
    return found.select("label", "n", *[rounded(c, 8).alias(c) for c in BOX])


@query(
    f"""
    WITH {RUNS_SQL}, {TESTING_SQL}
    SELECT domain, type, model, round(median(value), 8) AS rmse FROM testing JOIN labelled USING (run) WHERE key = 'testing/rmse' GROUP BY 1, 2, 3
    """
)
def median_error_per_model(spark, folder):
    """Median error per domain, type and model."""
    return R.median_by(_errors(spark, folder), "rmse", ["domain", "type", "model"]).withColumn("rmse", rounded("rmse", 8))


@query(
    f"""
    WITH {LOOP_SQL}, {RUNS_SQL},
    c AS (SELECT run, count(*) FILTER (key = 'fast_stop_iteration') AS f, count(*) FILTER (key = 'selected_cluster_id') AS t FROM loop GROUP BY 1)
    SELECT round(sum(f) / sum(t), 8) AS share FROM c JOIN runs USING (run) WHERE clustering IN ('correlation', 'feature_importance', 'random')
    """
)
def early_removal_share(spark, folder):
    """Share of rounds that ended early, over cluster-based runs."""
    counted = R.loop_counters(validation_metrics(spark, folder).unionByName(loop_metrics(spark, folder)))
    runs = run_table(spark, folder).filter(F.col("clustering").isin("correlation", "feature_importance", "random"))
    return ratio_of_sums(counted.join(runs, "run"), "fast_stops", "total_iterations", name="share").withColumn("share", rounded("share", 8))


def _summary_metrics(spark, folder):
    grouped = load(spark, folder, "lineitem").groupBy("l_suppkey", "l_returnflag")
    kind = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "val").otherwise("test")
    stats = grouped.agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std")).withColumn("kind", kind)
    cells = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in ("mean", "std")])
    name = F.concat(F.lit("supp="), F.col("l_suppkey").cast("string"), F.lit("_fast"))
    return stats.select(name.alias("run"), "kind", F.inline(cells)).select(
        "run", F.concat_ws("/", F.lit("metrics"), "stat", "kind", F.lit("loss")).alias("key"), F.lit(0).alias("step"), F.lit(0).alias("idx"), "value"
    )


@query(
    """
    SELECT 'supp=' || l_suppkey || '_fast' AS run, cast(l_suppkey AS VARCHAR) AS supp, 'True' AS fast,
           round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS train_mean, round(stddev_pop(l_quantity) FILTER (l_returnflag = 'A'), 6) AS train_std,
           round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS val_mean, round(stddev_pop(l_quantity) FILTER (l_returnflag = 'N'), 6) AS val_std,
           round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS test_mean, round(stddev_pop(l_quantity) FILTER (l_returnflag = 'R'), 6) AS test_std
    FROM lineitem GROUP BY l_suppkey
    """
)
def summary_by_prefix(spark, folder):
    """Metrics below a key prefix as columns, with the parts of the run name."""
    table = R.summary_table(_summary_metrics(spark, folder))
    return table.select(
        "run",
        F.col("name_parts")["supp"].alias("supp"),
        F.col("name_parts")["fast"].alias("fast"),
        *[rounded(F.col(f"`{stat}/{kind}/loss`")).alias(f"{kind}_{stat}") for kind in ("train", "val", "test") for stat in ("mean", "std")],
    )


@query(
    """
    SELECT 'supp=' || s_suppkey AS run, cast(s_suppkey AS VARCHAR) AS supp, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'True' END, 'no') AS fast FROM supplier
    """
)
def attributes_from_names(spark, folder):
    """Columns from the parts of run names."""
    name = F.concat(F.lit("supp="), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "_fast").otherwise(""))
    runs = load(spark, folder, "supplier").select(F.concat(F.lit("supp="), F.col("s_suppkey").cast("string")).alias("run"), name.alias("name"))
    return R.attach_attributes(runs, "name", ["supp", "fast"]).select("run", "supp", F.coalesce("fast", F.lit("no")).alias("fast"))


@query(
    f"""
    WITH {TESTING_SQL}
    SELECT 'max' AS target, run, round(value, 8) AS value FROM (SELECT run, max(value) AS value FROM testing WHERE key = 'testing/mae' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
    UNION ALL SELECT 'min', run, round(value, 8) FROM (SELECT run, min(value) AS value FROM testing WHERE key = 'testing/mae' GROUP BY 1 ORDER BY 2, 1 LIMIT 1)
    UNION ALL SELECT '50', run, round(value, 8) FROM (
      SELECT run, arg_min(value, (abs(value - 50), value)) AS value, min(abs(value - 50)) AS d FROM testing WHERE key = 'testing/mae' GROUP BY 1 ORDER BY d, 1 LIMIT 1)
    """
)
def best_run_by_objective(spark, folder):
    """The best run under max, min and closeness."""
    metrics = testing_metrics(spark, folder)
    parts = [
        R.best_run(metrics, "testing/mae", target).select(F.lit(name).alias("target"), "run", rounded("value", 8).alias("value"))
        for name, target in (("max", "max"), ("min", "min"), ("50", 50.0))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""
    WITH {TESTING_SQL}, old AS (SELECT * FROM testing WHERE step <= 6),
    last AS (SELECT run, key, max(step) AS m FROM old GROUP BY 1, 2)
    SELECT run, key, cast(step AS INTEGER) AS step, idx, value FROM old
    UNION ALL SELECT run, 'testing/rmse', cast(coalesce(m + 1, 0) AS INTEGER), idx, value FROM testing t LEFT JOIN (SELECT * FROM last WHERE key = 'testing/rmse') l USING (run) WHERE t.step = 7
    """
)
def append_metric_records(spark, folder):
    """New records continue the steps of their key."""
    metrics = testing_metrics(spark, folder)
    stored = metrics.filter(F.col("step") <= 6)
    new = metrics.filter(F.col("step") == 7).withColumns({"key": F.lit("testing/rmse"), "step": F.lit(0)})
    return R.append_metrics(stored, new)


@query(
    f"""
    WITH {TESTING_SQL}
    SELECT run, key, cast(step AS INTEGER) AS step, idx, value FROM testing WHERE key <> 'testing/mae'
    UNION ALL SELECT run, 'testing/mae', cast(step AS INTEGER), idx, value * 2 FROM testing WHERE key = 'testing/mae'
    """
)
def overwrite_metric_records(spark, folder):
    """New records replace their key."""
    metrics = testing_metrics(spark, folder)
    new = metrics.filter(F.col("key") == "testing/mae").withColumn("value", F.col("value") * 2)
    return R.append_metrics(metrics, new, "overwrite")


@query(
    f"""
    WITH {TESTING_SQL}, mae AS (SELECT * FROM testing WHERE key = 'testing/mae'),
    last AS (SELECT run, key, max(step) AS m FROM testing WHERE key <> 'testing/mae' AND step <= 3 GROUP BY 1, 2)
    SELECT run, key, cast(step AS INTEGER) AS step, idx, value, 'first' AS batch FROM testing WHERE key <> 'testing/mae' AND step <= 3
    UNION ALL SELECT t.run, t.key, cast(coalesce(m + 1, 0) + step AS INTEGER), idx, value, 'second' FROM testing t LEFT JOIN last USING (run, key) WHERE t.key <> 'testing/mae' AND t.step > 3
    UNION ALL SELECT run, key, cast(step AS INTEGER), idx, value * 2, 'third' FROM mae
    """
)
def stored_metric_records(spark, folder):
    """Records written to the shared folder in batches: one extends keys, once more after a failure, one replaces a key."""
    metrics = testing_metrics(spark, folder)
    path = f"{checkpoint_folder(spark)}/metrics-{uuid.uuid4().hex}"
    early, late = metrics.filter("step <= 3"), metrics.filter("step > 3 AND key <> 'testing/mae'")
    write_metrics(early, path, "first", "error")
    for _ in range(2):
        write_metrics(late, path, "second", "extend")
    write_metrics(metrics.filter("key = 'testing/mae'").withColumn("value", F.col("value") * 2), path, "third", "overwrite")
    return read_metrics(spark, path)


@query(
    f"""
    WITH {TESTING_SQL}, {SCORES_SQL}, k AS (SELECT run, key FROM testing UNION ALL SELECT run, 'validation/' || iteration || '/' || candidate || '/neg_rmse' FROM scores)
    SELECT run, bool_or(key = 'testing/rmse') AS exact, bool_or(starts_with(key, 'validation/2/3/')) AS below FROM k GROUP BY 1
    """
)
def key_existence(spark, folder):
    """Whether a key, or a key below a prefix, exists per run."""
    metrics = testing_metrics(spark, folder).unionByName(validation_metrics(spark, folder))
    exact = R.runs_with_key(metrics, "testing/rmse").withColumnRenamed("has_key", "exact")
    return exact.join(R.runs_with_key(metrics, "validation/2/3", strict=False).withColumnRenamed("has_key", "below"), "run")


@query(
    f"""
    WITH {SCORES_SQL}, v AS (SELECT run, 'validation/' || iteration || '/' || candidate || '/neg_rmse' AS key, idx, neg_rmse AS value FROM scores)
    SELECT run, key, cast(idx AS BIGINT) AS idx, value FROM v
    UNION ALL SELECT run, 'validation/1/baseline/' || substr(key, 16), cast(idx AS BIGINT), value FROM v WHERE starts_with(key, 'validation/0/2/')
    """
)
def copy_records_below(spark, folder):
    """Records below one prefix copied below another."""
    return R.copy_records(validation_metrics(spark, folder), "validation/0/2", "validation/1/baseline").drop("step")


@query(f"WITH {TESTING_SQL} SELECT run, round(avg(value), 11) AS mean, round(stddev_pop(value), 8) AS std FROM testing WHERE key = 'testing/rmse' GROUP BY 1")
def run_metric_statistics(spark, folder):
    """Mean and population deviation of a run's stored values."""
    found = _errors(spark, folder).groupBy("run").agg(F.avg("rmse").alias("mean"), F.stddev_pop("rmse").alias("std"))
    return found.select("run", rounded("mean", 11).alias("mean"), rounded("std", 8).alias("std"))
