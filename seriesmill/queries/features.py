"""Feature scores, clusters and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import clustering as C
from seriesmill.operators import scoring as S
from seriesmill.operators.columns import column_profile
from seriesmill.operators.gram import GramScorer
from seriesmill.operators.models import ModelScorer, fit_model, test_fits, tune
from seriesmill.operators.evaluation import regression_metrics
from seriesmill.operators.neighbours import neighbour_information
from seriesmill.operators.search import halving_search
from seriesmill.operators.selection import ClusterSelector, sequential_selection
from seriesmill.operators.sets import select_k_best
from seriesmill.operators.split import split_by_time
from seriesmill.queries.registry import load, query, rounded

FEATURES = ["l_quantity", "l_discount", "l_tax", "net", "taxed", "day_sin", "day_cos", "l_linenumber"]
TARGET = "l_extendedprice"

FRAME_SQL = """
f AS (SELECT l_orderkey, l_linenumber::DOUBLE AS l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_tax, l_extendedprice,
             l_extendedprice * (1 - l_discount) AS net, l_quantity * (1 + l_tax) AS taxed,
             round(sin(2 * pi() * (dayofyear(l_shipdate) - 1) / 365.0), 9) AS day_sin, round(cos(2 * pi() * (dayofyear(l_shipdate) - 1) / 365.0), 9) AS day_cos
      FROM lineitem)
"""


def feature_frame(spark, folder, *more):
    """Line items as a modelling table: eight features, the price as target, and the columns ``more``."""
    turn = (F.dayofyear("l_shipdate") - 1) * F.lit(2 * 3.141592653589793 / 365.0)
    return load(spark, folder, "lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        "l_shipdate",
        F.col("l_linenumber").cast("double").alias("l_linenumber"),
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_extendedprice",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("taxed"),
        F.round(F.sin(turn), 9).alias("day_sin"),
        F.round(F.cos(turn), 9).alias("day_cos"),
        *more,
    )


def split_frame(spark, folder):
    return split_by_time(feature_frame(spark, folder), "l_shipdate", (0.75, 0.25), 86_400, ("train", "val"))


PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM f" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]
)


@query(f"WITH {FRAME_SQL} SELECT feature_a, feature_b, round(r, 6) + 0.0 AS r FROM ({PAIRS_SQL})")
def correlation_pairs(spark, folder):
    """All pairwise correlations from one pass."""
    return S.correlation_pairs(feature_frame(spark, folder), FEATURES).withColumn("r", rounded("r"))


@query(
    f"""
    WITH {FRAME_SQL.replace("f AS (", "whole AS (")}, f AS (SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax, CASE WHEN l_linenumber <> 2 THEN net END AS net) FROM whole)
    SELECT feature_a, feature_b, round(abs(r), 6) + 0.0 AS r FROM ({PAIRS_SQL})
    """
)
def correlation_from_gram(spark, folder):
    """The absolute correlation matrix from the distributed Gram matrix, with holes in two features."""
    frame = feature_frame(spark, folder)
    holes = {"l_tax": F.when(F.col("l_linenumber") != 3, F.col("l_tax")), "net": F.when(F.col("l_linenumber") != 2, F.col("net"))}
    matrix = S.correlation_matrix(frame.withColumns(holes), FEATURES)
    rows = [
        (a, b, float(abs(matrix[i, j])))
        for i, a in enumerate(FEATURES)
        for j, b in enumerate(FEATURES)
        if i < j
    ]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, r double").withColumn("r", rounded("r"))


F_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS position, pow(corr({c}, {TARGET}), 2) / (1 - pow(corr({c}, {TARGET}), 2)) * (count(*) - 2) AS score FROM f"
    for i, c in enumerate(FEATURES)
)


@query(f"WITH {FRAME_SQL} SELECT feature, position, cast(printf('%.6e', score) AS DOUBLE) AS score FROM ({F_SQL})")
def f_value_scores(spark, folder):
    """F-value of each feature."""
    return S.f_scores(feature_frame(spark, folder), FEATURES, TARGET).withColumn("score", significant("score"))


@query(f"WITH {FRAME_SQL} SELECT feature FROM ({F_SQL}) ORDER BY score DESC, position DESC LIMIT 3")
def best_three_features(spark, folder):
    """The k features with the highest F-value."""
    return select_k_best(S.f_scores(feature_frame(spark, folder), FEATURES, TARGET), 3).select("feature")


def _mi_sql() -> str:
    """The histogram estimate over the complete rows of each feature."""
    bins = 10
    parts = []
    for i, c in enumerate(FEATURES):
        ranges = ", ".join(f"least(floor(({v} - min({v}) OVER ()) * {bins} / (max({v}) OVER () - min({v}) OVER ())), {bins - 1}) AS {b}" for v, b in ((c, "b1"), (TARGET, "b2")))
        parts.append(
            f"""
            SELECT '{c}' AS feature, {i} AS position, sum(n / t * ln(n * t / (nx * ny))) AS score FROM (
              SELECT DISTINCT b1, b2, count(*) OVER (PARTITION BY b1, b2)::DOUBLE AS n, count(*) OVER (PARTITION BY b1)::DOUBLE AS nx,
                     count(*) OVER (PARTITION BY b2)::DOUBLE AS ny, count(*) OVER ()::DOUBLE AS t
              FROM (SELECT {ranges} FROM f WHERE isfinite({c}) AND isfinite({TARGET})))
            """
        )
    return " UNION ALL ".join(parts)


@query(f"WITH {FRAME_SQL} SELECT feature, position, round(greatest(score, 0), 6) + 0.0 AS score FROM ({_mi_sql()})")
def mutual_information_scores(spark, folder):
    """Binned mutual information of each feature with the target."""
    return S.mutual_information(feature_frame(spark, folder), FEATURES, TARGET, 10, "width").withColumn("score", rounded("score"))


HOLES = {
    "l_tax": ("l_linenumber <> 3", None),
    "net": ("l_linenumber <> 2", float("nan")),
    "taxed": ("l_quantity < 40", float("inf")),
    TARGET: ("l_orderkey % 11 <> 0", None),
}
HOLES_SQL = f"""
whole AS ({FRAME_SQL.strip().removeprefix("f AS (").removesuffix(")")}),
f AS (SELECT * REPLACE ({", ".join(f"CASE WHEN {rule} THEN {c} ELSE {'NULL' if value is None else repr(str(value)) + '::DOUBLE'} END AS {c}" for c, (rule, value) in HOLES.items())}) FROM whole)
"""


@query(f"WITH {HOLES_SQL} SELECT feature, position, round(greatest(score, 0), 6) + 0.0 AS score FROM ({_mi_sql()})")
def mutual_information_with_holes(spark, folder):
    """The same with NULL, NaN and infinite values: each feature over its complete rows."""
    frame = feature_frame(spark, folder, "l_orderkey")
    frame = frame.withColumns({c: F.when(F.expr(rule), F.col(c)).otherwise(F.lit(value).cast("double")) for c, (rule, value) in HOLES.items()})
    return S.mutual_information(frame, FEATURES, TARGET, 10, "width").withColumn("score", rounded("score"))


BUYER_FEATURES = ["orders", "largest", "span", "nation", "urgent"]


def _neighbours_sql() -> str:
    """The neighbour estimate from all pairs of customers."""
    share = "('0x' || substr(md5(c_custkey || '|' || {i} || '|{axis}'), 1, 8))::BIGINT / 4294967296.0"
    parts = []
    for i, c in enumerate(BUYER_FEATURES):
        order = ", ".join(f"row_number() OVER (ORDER BY {v}, {share.format(i=i, axis=axis)}, c_custkey) - 1 AS {r}" for v, axis, r in ((c, "x", "u"), ("spent", "y", "v")))
        parts.append(f"SELECT {i} AS position, '{c}' AS feature, {order}, count(*) OVER () AS n FROM buyers WHERE {c} IS NOT NULL AND spent IS NOT NULL")
    return f"""
    r AS ({" UNION ALL ".join(parts)}),
    d AS (SELECT a.position, a.u, a.v, a.n, list_sort(min(greatest(abs(a.u - b.u), abs(a.v - b.v)), 3))[3] AS e
          FROM r a JOIN r b ON a.position = b.position AND a.u <> b.u GROUP BY a.position, a.u, a.v, a.n)
    """


BUYERS_SQL = """
buyers AS (SELECT c_custkey, orders, largest, span, c_nationkey::DOUBLE AS nation, urgent, spent
           FROM customer LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS orders, max(o_totalprice) AS largest, date_diff('day', min(o_orderdate), max(o_orderdate))::DOUBLE AS span,
                                           count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE AS urgent, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey)
"""


@query(
    f"""
    WITH {BUYERS_SQL},
    {_neighbours_sql().strip()},
    psi AS (SELECT m, -0.5772156649015329 + coalesce(sum(1.0 / m) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM (SELECT unnest(range(1, (SELECT max(n) + 2 FROM r))) AS m)),
    c AS (SELECT position, n, least(u, e - 1) + least(n - 1 - u, e - 1) + 1 AS nu, least(v, e - 1) + least(n - 1 - v, e - 1) + 1 AS nv FROM d),
    s AS (SELECT position, n, avg(a.p + b.p) AS m FROM c JOIN psi a ON a.m = nu JOIN psi b ON b.m = nv GROUP BY 1, 2)
    SELECT feature, s.position, round(greatest(a.p + b.p - s.m, 0), 6) + 0.0 AS score
    FROM s JOIN (SELECT DISTINCT position, feature FROM r) USING (position) JOIN psi a ON a.m = s.n JOIN psi b ON b.m = 3
    """
)
def neighbour_information_scores(spark, folder):
    """Nearest-neighbour mutual information of customers' habits with what they spend; customers without orders are incomplete."""
    orders = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    habits = orders.agg(
        F.count(F.lit(1)).cast("double").alias("orders"),
        F.max("o_totalprice").alias("largest"),
        F.date_diff(F.max(day), F.min(day)).cast("double").alias("span"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"),
        F.sum(F.col("o_totalprice").cast("decimal(18, 2)")).cast("double").alias("spent"),
    )
    buyers = load(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("nation")).join(habits, "c_custkey", "left")
    return neighbour_information(buyers, BUYER_FEATURES, "spent", "c_custkey", method="md5").withColumn("score", rounded("score"))


@query()
def forest_importance_scores(spark, folder):
    """Random forest importance of each feature."""
    return S.forest_importance(feature_frame(spark, folder), FEATURES, TARGET, numTrees=5, maxDepth=4)


FEATURE_ROWS_SQL = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS feature" for i, c in enumerate(FEATURES))


def significant(column: str):
    """Seven significant digits, for values of any size."""
    return F.format_string("%.6e", F.col(column)).cast("double")


def _with_variance(frame, clusters, shown=None):
    """Cluster members with the variance each has in the data."""
    members = C.cluster_frame(frame, clusters).select("cluster_id", F.explode("features").alias("feature"))
    spread_of = column_profile(frame.select(*FEATURES)).select(F.col("column").alias("feature"), (rounded("variance", 4) if shown is None else shown).alias("variance"))
    return members.join(spread_of, "feature")


VARIANCE_SQL = " UNION ALL ".join(f"SELECT {i} AS cluster_id, '{c}' AS feature, var_samp({c}) AS v FROM f" for i, c in enumerate(FEATURES))


@query(f"WITH {FRAME_SQL} SELECT cast(cluster_id AS INTEGER) AS cluster_id, feature, cast(printf('%.6e', v) AS DOUBLE) AS variance FROM ({VARIANCE_SQL})")
def singleton_clusters(spark, folder):
    """One cluster per feature, with the variance of the feature."""
    frame = feature_frame(spark, folder)
    return _with_variance(frame, C.feature_clusters(frame, FEATURES, "singletons"), significant("variance"))


@query(
    f"""
    WITH {FRAME_SQL}, p AS ({PAIRS_SQL}), n AS ({FEATURE_ROWS_SQL}),
    near AS (SELECT feature_b AS feature, min(n.position) AS position FROM p JOIN n ON n.feature = p.feature_a
             WHERE abs(r) >= 0.9 OR (feature_a = 'day_sin' AND feature_b = 'day_cos') GROUP BY 1),
    home AS (SELECT n.feature, least(n.position, coalesce(near.position, n.position)) AS rep FROM n LEFT JOIN near USING (feature))
    SELECT cast(dense_rank() OVER (ORDER BY rep) - 1 AS INTEGER) AS cluster_id, feature FROM home
    """
)
def correlation_clusters(spark, folder):
    """Median-linkage clusters of correlated features; the SQL relies on clusters of at most two here."""
    frame = feature_frame(spark, folder)
    return C.cluster_frame(frame, C.feature_clusters(frame, FEATURES, "correlation")).select("cluster_id", F.explode("features").alias("feature"))


@query()
def random_clusters(spark, folder):
    """Random groups of three; sine/cosine pairs stay together."""
    frame = feature_frame(spark, folder)
    return _with_variance(frame, C.feature_clusters(frame, FEATURES, "random", group_size=3))


@query()
def importance_clusters(spark, folder):
    """Groups in order of forest importance."""
    frame = feature_frame(spark, folder)
    groups = C.feature_clusters(frame, FEATURES, "feature_importance", TARGET, group_size=3, numTrees=5, maxDepth=4)
    return C.cluster_frame(frame, groups).select("cluster_id", F.explode("features").alias("feature"))


SPLIT_FRAME_SQL = """
s AS (SELECT min(epoch_us(l_shipdate)) AS lo, max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate)) AS total FROM f),
g AS (SELECT f.*, CASE WHEN epoch_us(l_shipdate) - lo <= total * 0.75 - 43200000000.0 THEN 'train'
                       WHEN epoch_us(l_shipdate) - lo >= total * 0.75 + 43200000000.0 THEN 'val' END AS split FROM f, s)
"""
SINGLE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, -sqrt(avg(pow({TARGET} - (SELECT regr_intercept({TARGET}, {c}) FROM g WHERE split = 'train')
        - (SELECT regr_slope({TARGET}, {c}) FROM g WHERE split = 'train') * {c}, 2))) AS score FROM g WHERE split = 'val'"""
    for c in FEATURES
)


@query(f"WITH {FRAME_SQL}, {SPLIT_FRAME_SQL} SELECT feature, round(score, 4) AS score FROM ({SINGLE_SQL})")
def single_feature_errors(spark, folder):
    """Validation error of a linear model on each single feature, all from one pass."""
    scorer = GramScorer(split_frame(spark, folder), FEATURES, TARGET, ["row_id"], replicates=0)
    rows = [(f, scorer.point_score([f])) for f in FEATURES]
    return spark.createDataFrame(rows, "feature string, score double").withColumn("score", rounded("score", 4))


@query(
    f"""
    WITH {FRAME_SQL}, {SPLIT_FRAME_SQL}
    SELECT round(-sqrt(avg(pow({TARGET} - (SELECT regr_intercept({TARGET}, taxed) FROM g WHERE split = 'train')
           - (SELECT regr_slope({TARGET}, taxed) FROM g WHERE split = 'train') * taxed, 2))), 4) AS neg_rmse FROM g WHERE split = 'val'
    """
)
def linear_model_error(spark, folder):
    """A fitted ML pipeline with scaled input and target, scored on the validation part."""
    parts = split_frame(spark, folder)
    model = fit_model(
        parts.filter(F.col("split") == "train"), ["taxed"], TARGET, "linear", {"x_scaler": "standard", "y_transform": "standard"}
    )
    scored = model.predict(parts.filter(F.col("split") == "val"))
    return regression_metrics(scored, TARGET, "y_hat", [], ["neg_rmse"]).withColumn("neg_rmse", rounded("neg_rmse", 4))


@query()
def cluster_selection_trace(spark, folder):
    """Backward cluster-wise selection: which cluster went in which round."""
    scorer = GramScorer(split_frame(spark, folder), FEATURES, TARGET, ["row_id"], replicates=50)
    clusters = C.feature_clusters(feature_frame(spark, folder), FEATURES, "correlation")
    found = ClusterSelector(scorer, clusters, 2).fit()
    return found.metrics_frame(spark)


@query()
def forward_selection_trace(spark, folder):
    """Forward cluster-wise selection without early exit."""
    scorer = GramScorer(split_frame(spark, folder), FEATURES, TARGET, ["row_id"], replicates=50)
    clusters = C.feature_clusters(feature_frame(spark, folder), FEATURES, "correlation")
    found = ClusterSelector(scorer, clusters, 3, direction="forward", fast_mode=False).fit()
    return found.metrics_frame(spark)


@query()
def resumed_selection(spark, folder):
    """A selection continued from its stored log."""
    scorer = GramScorer(split_frame(spark, folder), FEATURES, TARGET, ["row_id"], replicates=50)
    groups = C.singletons(FEATURES)
    full = ClusterSelector(scorer, groups, 2, fast_mode=False).fit()
    again = ClusterSelector(scorer, groups, 2, fast_mode=False).resume(full.metrics_frame(spark), full.clusters, 2).fit()
    rows = [(i, c, again.clusters[c]) for i, c in enumerate(again.taken)]
    return spark.createDataFrame(rows, "iteration int, cluster_id int, features array<string>")


@query(f"WITH {FRAME_SQL}, {SPLIT_FRAME_SQL}, z AS ({SINGLE_SQL}) SELECT feature FROM z ORDER BY score DESC LIMIT 1")
def sequential_selection_first(spark, folder):
    """Greedy forward selection of one feature."""
    scorer = GramScorer(split_frame(spark, folder), FEATURES, TARGET, ["row_id"], replicates=0)
    return spark.createDataFrame([(f,) for f in sequential_selection(scorer, FEATURES, 1)], "feature string")


@query()
def sequential_selection_backward(spark, folder):
    """Greedy backward selection down to three features."""
    scorer = GramScorer(split_frame(spark, folder), FEATURES, TARGET, ["row_id"], replicates=0)
    return spark.createDataFrame([(f,) for f in sequential_selection(scorer, FEATURES, 3, "backward")], "feature string")


@query("SELECT round(l_extendedprice * (1 - l_discount), 4) AS net, l_orderkey FROM lineitem")
def selected_columns(spark, folder):
    """The frame reduced to the selected features and its key."""
    scorer = GramScorer(split_frame(spark, folder), FEATURES, TARGET, ["row_id"], replicates=20)
    found = ClusterSelector(scorer, C.singletons(FEATURES), 1, fixed=[]).fit()
    frame = load(spark, folder, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return frame.select("l_orderkey", *[F.round(f, 4).alias(f) for f in found.get_support()])


@query()
def forest_candidate_scores(spark, folder):
    """Two feature sets scored by a forest on shared bootstrap draws."""
    scorer = ModelScorer(
        split_frame(spark, folder), FEATURES, TARGET, "row_id", family="rf", params={"numTrees": 5, "maxDepth": 4}, replicates=10
    )
    sets = [["net", "taxed"], ["l_quantity", "l_tax"]]
    rows = [("+".join(s), b, float(v)) for s, values in zip(sets, scorer.score_many(sets)) for b, v in enumerate(values)]
    scorer.close()
    return spark.createDataFrame(rows, "candidate string, replicate int, neg_rmse double")


@query()
def tuned_forest(spark, folder):
    """Grid search on the last fifth of the rows in time order."""
    frame = feature_frame(spark, folder).select("row_id", "l_shipdate", TARGET, "net", "taxed")
    _, trials = tune(
        frame, ["net", "taxed"], TARGET, [F.col("l_shipdate"), F.col("row_id")], [F.col("l_shipdate")], "rf",
        {"numTrees": [3, 5], "maxDepth": [2, 4]},
    )
    return trials


@query()
def halving_search_trials(spark, folder):
    """Log of a search over nested samples: which trial reached which rung, with what share of the rows and what error."""
    frame = feature_frame(spark, folder, "l_orderkey").select("row_id", "l_shipdate", TARGET, "net", "taxed")
    _, trials = halving_search(
        frame, ["net", "taxed"], TARGET, [F.col("l_shipdate"), F.col("row_id")], [F.col("l_shipdate")], "row_id", "linear",
        {"regParam": [0.0, 0.1, 1.0, 10.0, 100.0, 1000.0]}, trials=6, least_share=1 / 9,
    )
    return trials.drop("seconds")


@query()
def repeated_test_fits(spark, folder):
    """Metrics of repeated fits on the bootstrapped test part."""
    parts = split_frame(spark, folder)
    return test_fits(
        parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "val"), ["net", "taxed"], TARGET, "row_id", "rf",
        {"numTrees": 3, "maxDepth": 3}, fits=2, replicates=10, metrics=["rmse", "mae"],
    )
