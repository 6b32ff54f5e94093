"""One selection run end to end: split, select on train/validation, evaluate on test, store as run tables."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.text import CLUSTERWISE
from seriesmill.catalog.tags import scenario_features, target_of
from seriesmill.operators.clustering import cluster_frame, feature_clusters
from seriesmill.operators.gram import GramScorer
from seriesmill.operators.models import ModelScorer, test_fits, tune
from seriesmill.operators.scoring import f_scores, forest_importance, mutual_information
from seriesmill.operators.selection import ClusterSelector, sequential_selection
from seriesmill.operators.sets import select_k_best
from seriesmill.operators.split import split_by_time


@dataclass(frozen=True)
class Settings:
    """Defaults follow the published configuration."""

    scenario: str = "digital_twin"
    model: str = "linear"
    method: str = CLUSTERWISE  # clusterwise, SFS, f_value, mutual_info, RF_FI
    n_features: int = 10
    direction: str = "backward"
    clustering: str = "correlation"
    group_size: int | None = None
    test_ratio: float = 0.25
    val_ratio: float = 0.25
    gap_seconds: float = 86_400
    replicates: int = 100
    test_fits: int = 10
    fast_mode: bool = True
    early_stopping: bool = False
    seed: int = 42
    params: Mapping = field(default_factory=dict)
    search_space: Mapping[str, Sequence] | None = None


@dataclass
class Outcome:
    selected: list[str]
    metrics: DataFrame
    clusters: DataFrame | None
    runtime: float


def run(df: DataFrame, tags: Mapping, settings: Settings, ts: str = "Timestamp", row_id: str = "row_id") -> Outcome:
    """Runs jobs.  ``df`` should be a checkpointed clean table with a unique ``row_id``.

    The selection sees the training part only; the test part lies behind a gap.
    """
    s = settings
    target = target_of(tags)
    features = [f for f in scenario_features(tags, s.scenario, s.model) if f in df.columns]
    parts = split_by_time(df.select(row_id, ts, target, *features), ts, (1 - s.test_ratio, s.test_ratio), s.gap_seconds, ("fit", "test"), "part")
    fit_rows, test_rows = parts.filter(F.col("part") == "fit"), parts.filter(F.col("part") == "test")
    inner = split_by_time(fit_rows, ts, (1 - s.val_ratio, s.val_ratio), s.gap_seconds, ("train", "val"))
    started = time.perf_counter()
    log, clusters = None, None
    if s.method in (CLUSTERWISE, "SFS"):
        if s.model == "linear":
            scorer = GramScorer(inner, features, target, [row_id], "split", s.replicates, s.seed)
        else:
            scorer = ModelScorer(inner, features, target, row_id, "split", s.model, s.params, s.replicates, s.seed)
        if s.method == "SFS":
            selected = sequential_selection(scorer, features, s.n_features, s.direction)
        else:
            groups = feature_clusters(fit_rows, features, s.clustering, target, group_size=s.group_size, seed=s.seed)
            selector = ClusterSelector(
                scorer, groups, s.n_features, s.direction, fast_mode=s.fast_mode, early_stopping=s.early_stopping, seed=s.seed
            )
            found = selector.fit()
            if isinstance(scorer, ModelScorer):
                scorer.close()
            selected, log = found.selected, found.metrics_frame(df.sparkSession)
            clusters = cluster_frame(df, found.clusters)
    else:
        rankers = {"f_value": f_scores, "mutual_info": mutual_information, "RF_FI": forest_importance}
        ranked = select_k_best(rankers[s.method](fit_rows, features, target), s.n_features)
        chosen = {r.feature for r in ranked.collect()}
        selected = [f for f in features if f in chosen]
    runtime = time.perf_counter() - started
    params = dict(s.params)
    if s.search_space:
        best, _ = tune(
            fit_rows.select(row_id, ts, target, *selected), selected, target, [F.col(ts), F.col(row_id)], [F.to_date(ts)], s.model, s.search_space
        )
        params.update(best)
    tested = test_fits(fit_rows, test_rows, selected, target, row_id, s.model, params, s.test_fits, s.replicates, s.seed)
    spent = df.sparkSession.createDataFrame([("fs_runtime", 0, 0, runtime)], "key string, step int, idx int, value double")
    metrics = tested.unionByName(spent)
    return Outcome(selected, metrics.unionByName(log) if log is not None else metrics, clusters, runtime)


def run_tables(name: str, outcome: Outcome, domain: str, asset: str, settings: Settings) -> dict[str, DataFrame]:
    """The outcome as rows of ``runs``, ``run_metrics``, ``run_features`` and ``run_clusters``."""
    spark = outcome.metrics.sparkSession
    s = settings
    runs = spark.createDataFrame(
        [(name, "success", domain, asset, s.scenario, s.model, s.method, s.direction, s.clustering, s.group_size, s.n_features, outcome.runtime)],
        "run string, status string, domain string, asset_id string, type string, model string, method string, "
        "direction string, clustering string, group_size int, n_features int, fs_runtime double",
    )
    tables = {
        "runs": runs,
        "run_metrics": outcome.metrics.select(F.lit(name).alias("run"), "key", "step", "idx", "value"),
        "run_features": spark.createDataFrame([(name, outcome.selected)], "run string, features array<string>"),
    }
    if outcome.clusters is not None:
        tables["run_clusters"] = outcome.clusters.select(F.lit(name).alias("run"), "*")
    return tables
