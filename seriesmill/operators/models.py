"""Estimators of Spark ML, scaling around them, tuning and scoring of candidate sets."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.evaluation import METRICS, paired_bootstrap, regression_metrics
from seriesmill.operators.reshape import ScaleModel, fit_scaler
from seriesmill.operators.split import split_head_tail
from seriesmill.session import cut_lineage

# Boosted tree families share Spark's implementation; linear is the fast baseline.
ESTIMATORS = {"rf": RandomForestRegressor, "lgbm": GBTRegressor, "xgboost": GBTRegressor, "linear": LinearRegression}


def x_scaler(kind: str | None):
    if kind in (None, "none"):
        return None
    common = {"inputCol": "__raw", "outputCol": "__features"}
    if kind == "standard":
        return StandardScaler(withMean=True, withStd=True, **common)
    if kind == "robust":
        return RobustScaler(withCentering=True, withScaling=True, **common)
    if kind == "minmax":
        return MinMaxScaler(min=-0.5, max=0.5, **common)
    raise ValueError(f"unknown scaler {kind!r}")


def build_estimator(features: Sequence[str], target: str, family: str, params: Mapping | None = None) -> Pipeline:
    """Assembler, optional scaler (``x_scaler`` in ``params``) and regressor."""
    params = dict(params or {})
    scaler = x_scaler(params.pop("x_scaler", None))
    if family not in ESTIMATORS:
        raise NotImplementedError(f"no estimator family {family!r}")
    if family == "linear":
        params.pop("seed", None)
    stages = [VectorAssembler(inputCols=list(features), outputCol="__raw" if scaler else "__features", handleInvalid="error")]
    if scaler:
        stages.append(scaler)
    stages.append(ESTIMATORS[family](featuresCol="__features", labelCol=target, predictionCol="y_hat", **params))
    return Pipeline(stages=stages)


class FittedModel:
    """A fitted estimator that scales its target back."""

    def __init__(self, inner: PipelineModel, target: str, y_scale: ScaleModel | None):
        self.stages = inner.stages
        self._inner, self._target, self._y_scale = inner, target, y_scale

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``y_hat``; nothing is collected."""
        scored = self._inner.transform(df).drop("__raw", "__features")
        if self._y_scale is None:
            return scored
        back = ScaleModel(("y_hat",), self._y_scale.centre, self._y_scale.width, self._y_scale.offset)
        return back.inverse(scored)


def fit_model(df: DataFrame, features: Sequence[str], target: str, family: str, params: Mapping | None = None) -> FittedModel:
    """Fit one model; ``y_transform`` (standard or minmax) in ``params`` scales the target.  Runs jobs."""
    params = dict(params or {})
    y_kind = params.pop("y_transform", None)
    y_scale = None
    if y_kind:
        y_scale = fit_scaler(df, [target], {"standard": "standard", "minmax": "minmax01"}[y_kind])
        df = y_scale.transform(df)
    return FittedModel(build_estimator(features, target, family, params).fit(df), target, y_scale)


def parameter_grid(space: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def tune(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    order: Sequence[Column],
    chunk: Sequence[Column],
    family: str,
    space: Mapping[str, Sequence],
    holdout: float = 0.2,
    parallelism: int = 4,
    start: Mapping | None = None,
) -> tuple[dict, DataFrame]:
    """Best parameters on the last ``holdout`` share of rows in time order, and the trial table.

    ``start`` (for instance the best of a warm-up) is tried first.  Trials run
    as concurrent Spark jobs over one split that is checkpointed for the search.
    """
    numbered = split_head_tail(df.select(*features, target, *_order_columns(df, features, target)), order, chunk, 1 - holdout)
    # a copy that outlives executors: fits on recomputed rows could differ; every pass reads it, so it holds what fits need
    parts = cut_lineage(numbered.select(*features, target, "split"))
    train, test = parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "test")
    trials = ([dict(start)] if start else []) + [p for p in parameter_grid(space) if not start or p != dict(start)]

    def loss(params: dict) -> float:
        scored = fit_model(train, features, target, family, params).predict(test)
        return scored.agg(F.avg(F.pow(F.col(target) - F.col("y_hat"), F.lit(2.0)))).first()[0]

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        losses = list(pool.map(loss, trials))
    best = int(np.argmin(losses))
    rows = [(i, str(sorted(p.items())), float(m)) for i, (p, m) in enumerate(zip(trials, losses))]
    return trials[best], df.sparkSession.createDataFrame(rows, "trial int, params string, mse double")


def _order_columns(df: DataFrame, features: Sequence[str], target: str) -> list[str]:
    """Columns besides features and target (instants, ids) that an order may refer to."""
    return [c for c in df.columns if c not in features and c != target]


class ModelScorer:
    """Scores a feature set by fitting an ML estimator and bootstrapping its validation errors.

    Predictions are made once per set; replicates reweight them.  ``score_many``
    keeps several fits in flight.
    """

    def __init__(
        self,
        df: DataFrame,
        features: Sequence[str],
        target: str,
        row_id: str,
        part: str = "split",
        family: str = "rf",
        params: Mapping | None = None,
        replicates: int = 100,
        seed: int = 42,
        parallelism: int = 4,
        space: Mapping[str, Sequence] | None = None,
        order: Sequence[Column] = (),
    ):
        self._space, self._order = dict(space or {}), list(order)
        self.features = list(features)
        self.params = {"seed": seed, **(params or {})}
        self._target, self._row_id, self._family = target, row_id, family
        self._replicates, self._seed, self._parallelism = replicates, seed, parallelism
        self._rows = cut_lineage(df.select(row_id, part, target, *self.features))
        self._part = part

    def _scored(self, features: Sequence[str]) -> DataFrame:
        train, val = (self._rows.filter(F.col(self._part) == p) for p in ("train", "val"))
        model = fit_model(train, features, self._target, self._family, self.params)
        return model.predict(val).select(self._row_id, self._target, "y_hat")

    def score(self, features: Sequence[str]) -> np.ndarray:
        table = paired_bootstrap(
            self._scored(features), self._row_id, self._target, "y_hat", self._replicates, self._seed, metrics=["neg_rmse"]
        )
        return np.array([r.neg_rmse for r in table.orderBy("replicate").collect()])

    def score_many(self, sets: Sequence[Sequence[str]]) -> list[np.ndarray]:
        with ThreadPoolExecutor(max_workers=self._parallelism) as pool:
            return list(pool.map(self.score, sets))

    def point_score_many(self, sets: Sequence[Sequence[str]]) -> list[float]:
        with ThreadPoolExecutor(max_workers=self._parallelism) as pool:
            return list(pool.map(self.point_score, sets))

    def retune(self, features: Sequence[str]) -> None:
        """Search the parameters on the training rows for these features; the last best is tried first.  Runs jobs."""
        if not self._space or not features:
            return
        train = self._rows.filter(F.col(self._part) == "train")
        keep = {k: v for k, v in self.params.items() if k not in self._space}
        start = {k: v for k, v in self.params.items() if k in self._space}
        order = self._order or [F.col(self._row_id)]
        best, _ = tune(train, list(features), self._target, order, [F.lit(0)], self._family, self._space, parallelism=self._parallelism, start=start or None)
        self.params = {**keep, **best}

    def point_score(self, features: Sequence[str]) -> float:
        return regression_metrics(self._scored(features), self._target, "y_hat", [], ["neg_rmse"]).first()[0]

    def close(self) -> None:
        """Let go of the rows; their checkpoint goes with its frame."""
        self._rows = None


def test_fits(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    target: str,
    row_id: str,
    family: str,
    params: Mapping | None = None,
    fits: int = 10,
    replicates: int = 100,
    seed: int = 42,
    metrics: Sequence[str] = tuple(METRICS),
) -> DataFrame:
    """``key, step, idx, value`` rows ``testing/<metric>`` of repeated fits on bootstrapped test rows.

    Every fit uses its own seed; all share the test draws.
    """
    train, test = train.select(*features, target), test.select(row_id, target, *features)
    tables, model = [], None
    for fit in range(fits):
        # a linear fit has no seed: one model serves all
        if model is None or family != "linear":
            model = fit_model(train, features, target, family, {**(params or {}), "seed": seed + fit})
        scored = model.predict(test).select(row_id, target, "y_hat")
        table = paired_bootstrap(scored, row_id, target, "y_hat", replicates, seed, metrics=metrics)
        cells = [F.struct(F.lit(f"testing/{m}").alias("key"), F.col(m).alias("value")) for m in metrics]
        tables.append(
            table.select(F.col("replicate").alias("idx"), F.inline(F.array(*cells))).select(
                "key", F.lit(fit).alias("step"), "idx", "value"
            )
        )
    united = tables[0]
    for table in tables[1:]:
        united = united.unionByName(table)
    return united


test_fits.__test__ = False  # not a pytest function
