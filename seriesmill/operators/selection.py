"""Cluster-wise and plain sequential feature selection.

The loop runs on the driver and only ever sees score vectors (one number per
bootstrap replicate) that a scorer computes on Spark.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = "key string, step int, idx int, value double"


class Scorer(Protocol):
    def score(self, features: Sequence[str]) -> np.ndarray: ...

    def point_score(self, features: Sequence[str]) -> float: ...


def aggregate_scores(scores: np.ndarray, mode: str) -> float:
    simple = {"min": np.min, "max": np.max, "avg": np.mean, "median": np.median}
    if mode in simple:
        return float(simple[mode](scores))
    if mode.startswith("p="):
        return float(np.percentile(scores, float(mode[2:])))
    raise ValueError(f"unknown aggregation mode {mode!r}")


@dataclass
class Selection:
    """What was selected, in which order clusters were taken, and why."""

    selected: list[str]
    taken: list[int]
    clusters: dict[int, list[str]]
    log: list[tuple[str, int, int, float]] = field(default_factory=list)

    def get_support(self) -> list[str]:
        return list(self.selected)

    get_feature_names_out = get_support

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in self.selected])

    def metrics_frame(self, spark: SparkSession) -> DataFrame:
        """The log as ``key, step, idx, value``; its size depends on features and replicates only."""
        return spark.createDataFrame(self.log, METRIC_SCHEMA)


def score_sets(scorer: Scorer, sets: Sequence[Sequence[str]], point: bool = False) -> list:
    """Scores of several sets; a scorer that can keep several fits in flight does."""
    many = getattr(scorer, "point_score_many" if point else "score_many", None)
    if many is not None:
        return many(sets)
    one = scorer.point_score if point else scorer.score
    return [one(s) for s in sets]


class ClusterSelector:
    """Removes (backward) or adds (forward) one cluster per round until ``n_features`` are selected.

    In every round the clusters are scored in order of their last score.  The
    first one that fits the wanted size and is not inferior to the previous
    round wins; with ``fast_mode`` it ends the round at once.  If none passes,
    single features of larger clusters are tried, and if none of those passes
    either, the best score wins (or the selection ends, with ``early_stopping``).

    Candidate sets are handed to the scorer several at a time (``in_flight``); in
    fast mode the ones behind the first that passes are thrown away unseen, so the
    log is that of one set after the other.  ``tuning`` asks the scorer to search
    its parameters anew: ``warm_up`` (once, on all features), ``iteration`` (every
    round, on the features left, from the last best) or ``set`` (for every set).
    """

    def __init__(
        self,
        scorer: Scorer,
        clusters: dict[int, list[str]],
        n_features: int,
        direction: str = "backward",
        fixed: Sequence[str] = (),
        fast_mode: bool = True,
        early_stopping: bool = False,
        margin: float = 0.0,
        beta: float = 0.05,
        aggregation: str = "median",
        seed: int = 42,
        in_flight: int = 4,
        tuning: str | None = None,
    ):
        if tuning not in (None, "warm_up", "iteration", "set"):
            raise ValueError("tuning must be warm_up, iteration or set")
        self._in_flight, self._tuning = in_flight, tuning
        if direction not in ("backward", "forward"):
            raise ValueError("direction must be backward or forward")
        members = [f for group in clusters.values() for f in group]
        if set(fixed) & set(members):
            raise ValueError("fixed features and cluster features must be disjoint")
        if n_features > len(members):
            raise ValueError("n_features is larger than the number of features in clusters")
        self._scorer, self._fixed, self._n = scorer, list(fixed), n_features
        self._clusters = {i: list(group) for i, group in clusters.items()}
        self._backward = direction == "backward"
        self._fast, self._early = fast_mode, early_stopping
        self._margin, self._beta, self._mode = margin, beta, aggregation
        self._random = random.Random(seed)
        self._taken: list[int] = []
        self._last: dict[int, float] = {}
        self._scores: dict[tuple[int, object], np.ndarray] = {}
        self._log: list[tuple[str, int, int, float]] = []
        self._counts: dict[str, int] = {}
        self._round = -1

    # state ---------------------------------------------------------------
    def _included(self) -> list[int]:
        if self._backward:
            return [i for i in self._clusters if i not in self._taken]
        return list(self._taken)

    def _features_of(self, ids: Sequence[int]) -> list[str]:
        return [f for i in ids for f in self._clusters[i]]

    def _count(self) -> int:
        return len(self._features_of(self._included()))

    def _queue(self) -> list[int]:
        left = [i for i in self._clusters if i not in self._taken]
        return sorted(left, key=lambda i: -self._last.get(i, math.inf))

    def _fits(self, size: int) -> bool:
        return self._count() - size >= self._n if self._backward else self._count() + size <= self._n

    def _candidate_set(self, cluster: int | None = None, feature: str | None = None) -> list[str]:
        if self._backward:
            chosen = [f for f in self._features_of([i for i in self._included() if i != cluster]) if f != feature]
        else:
            chosen = self._features_of([*self._taken, *([cluster] if cluster is not None else [])])
            chosen += [feature] if feature is not None else []
        return chosen + self._fixed

    # records ---------------------------------------------------------------
    def _note(self, key: str, value: float, step: int | None = None) -> None:
        if step is None:
            step = self._counts.get(key, 0)
            self._counts[key] = step + 1
        self._log.append((key, step, 0, float(value)))

    def _keep(self, name: object, scores: np.ndarray) -> None:
        self._scores[(self._round, name)] = scores
        for idx, value in enumerate(scores):
            self._log.append((f"validation/{self._round}/{name}/neg_rmse", self._round, idx, float(value)))
            self._log.append((f"validation/{self._round}/{name}/rmse", self._round, idx, float(-value)))

    # steps -----------------------------------------------------------------
    def _set_baseline(self) -> None:
        previous = self._scores.get((self._round - 1, self._taken[-1])) if self._taken else None
        if previous is None:
            previous = self._scorer.score(self._features_of(self._queue()) + self._fixed)
        self._keep("baseline", previous)

    def _passes(self, name: object) -> bool:
        scores = self._scores.get((self._round, name))
        if scores is None:
            return False
        difference = scores - self._scores[(self._round, "baseline")]
        return bool(np.quantile(difference, self._beta) >= -self._margin)

    def _scored(self, sets: Sequence[list[str]]) -> Iterator[np.ndarray]:
        """Scores of the sets in order, ``in_flight`` of them asked for at a time."""
        for begin in range(0, len(sets), self._in_flight):
            part = sets[begin : begin + self._in_flight]
            if self._tuning != "set" and hasattr(self._scorer, "score_many"):
                yield from self._scorer.score_many(part)
                continue
            for one in part:
                if self._tuning == "set":
                    self._scorer.retune(one)
                yield self._scorer.score(one)

    def _try_clusters(self) -> int | None:
        asked = [(position, cluster, self._candidate_set(cluster=cluster)) for position, cluster in enumerate(self._queue())]
        asked = [one for one in asked if one[2]]
        for (position, cluster, _), scores in zip(asked, self._scored([one[2] for one in asked])):
            self._keep(cluster, scores)
            self._last[cluster] = aggregate_scores(scores, self._mode)
            if self._fast and self._fits(len(self._clusters[cluster])) and self._passes(cluster):
                self._note("fast_stop_cluster_id", cluster)
                self._note("fast_stop_iteration", self._round)
                self._note("fast_stop_evaluated_clusters", position + 1)
                return cluster
        for cluster in self._queue():
            if self._fits(len(self._clusters[cluster])) and self._passes(cluster):
                return cluster
        return None

    def _try_features(self) -> tuple[dict[str, int], str | None]:
        tested: dict[str, int] = {}
        passed = None
        asked = [(cluster, feature) for cluster in self._queue() if len(self._clusters[cluster]) > 1 for feature in self._clusters[cluster]]
        for (cluster, feature), scores in zip(asked, self._scored([self._candidate_set(feature=feature) for _, feature in asked])):
            tested[feature] = cluster
            self._keep(feature, scores)
            if self._passes(feature):
                passed = feature
                break
        return tested, passed

    def _best(self, names: Sequence[object]) -> object:
        sizes = {n: len(self._clusters[n]) if isinstance(n, int) else 1 for n in names}
        totals = {
            n: aggregate_scores(self._scores[(self._round, n)], self._mode)
            for n in names
            if self._fits(sizes[n]) and (self._round, n) in self._scores
        }
        top = max(totals.values())
        return self._random.choice([n for n, total in totals.items() if total == top])

    def _split_off(self, feature: str, origin: int) -> int:
        new = max(self._clusters) + 1
        self._clusters[origin].remove(feature)
        self._clusters[new] = [feature]
        self._keep(new, self._scores[(self._round, feature)])
        return new

    def _one_round(self) -> int | None:
        self._set_baseline()
        cluster = self._try_clusters()
        if cluster is not None:
            return cluster
        self._note("feature_level_iteration", self._round)
        tested, passed = self._try_features()
        self._note("feature_level_evaluated_features", len(tested))
        if passed is None and self._early:
            return None
        if passed is None:
            self._note("feature_level_none_non-inferior_iteration", self._round)
            winner = self._best([*tested, *self._queue()])
            if isinstance(winner, int):
                return winner
            passed = winner
        return self._split_off(passed, tested[passed])

    def fit(self) -> Selection:
        if self._tuning == "warm_up":
            self._scorer.retune(self._features_of(list(self._clusters)) + self._fixed)
        while self._count() != self._n:
            self._round += 1
            if self._tuning == "iteration":
                self._scorer.retune((self._features_of(self._included()) or self._features_of(self._queue())) + self._fixed)
            cluster = self._one_round()
            if cluster is None:
                break
            self._taken.append(cluster)
            self._note("selected_cluster_id", cluster, step=self._round)
        selected = self._fixed + self._features_of(self._included())
        return Selection(selected, list(self._taken), {i: list(g) for i, g in self._clusters.items()}, list(self._log))

    def resume(self, metrics: DataFrame, final_clusters: dict[int, list[str]], iteration: int) -> "ClusterSelector":
        """Continue at ``iteration`` from a stored log (``key, step, idx, value``).  Runs one job.

        Only records of the rounds before are read, and of the scores only those of
        the metric in use.  Features split off before are split off again; the order
        of the queue starts afresh.  Clusters that hold other features than the
        stored ones are refused.
        """
        if sorted(f for group in final_clusters.values() for f in group) != sorted(f for group in self._clusters.values() for f in group) or any(
            not set(group) <= set(self._clusters[i]) for i, group in final_clusters.items() if i in self._clusters
        ):
            raise ValueError("the clusters have changed since the stored run")
        key = F.col("key")
        scores = key.startswith("validation/") & key.endswith("/neg_rmse") & (F.split(key, "/")[1].cast("int") < iteration)
        taken_before = (key == "selected_cluster_id") & (F.col("step") < iteration)
        rounds_before = key.isin("fast_stop_iteration", "feature_level_iteration", "feature_level_none_non-inferior_iteration") & (F.col("value") < iteration)
        counts = key.isin("fast_stop_cluster_id", "fast_stop_evaluated_clusters", "feature_level_evaluated_features") & (F.col("step") < iteration)
        kept = metrics.filter(scores | taken_before | rounds_before | counts).collect()
        taken = sorted((r.step, int(r.value)) for r in kept if r.key == "selected_cluster_id" and r.step < iteration)
        self._taken = [cluster for _, cluster in taken]
        for cluster in self._taken:
            if cluster not in self._clusters:
                (feature,) = final_clusters[cluster]
                origin = next(i for i, group in self._clusters.items() if feature in group)
                self._clusters[origin].remove(feature)
                self._clusters[cluster] = [feature]
        self._round = iteration - 1
        by_name: dict[tuple[int, object], dict[int, float]] = {}
        rounds = {"fast_stop_iteration": [], "feature_level_iteration": []}
        for r in sorted(kept, key=lambda r: (r.key, r.step, r.idx)):
            if r.key.startswith("validation/"):
                _, step, name, metric = r.key.split("/", 3)
                self._log.append((r.key, r.step, r.idx, r.value))
                self._log.append((f"{r.key.removesuffix(metric)}rmse", r.step, r.idx, -r.value))
                by_name.setdefault((int(step), int(name) if name.isdigit() else name), {})[r.idx] = r.value
            elif r.key == "selected_cluster_id":
                if r.step < iteration:
                    self._note(r.key, r.value, step=r.step)
            elif r.key in ("fast_stop_iteration", "feature_level_iteration", "feature_level_none_non-inferior_iteration"):
                if r.value < iteration:
                    self._note(r.key, r.value)
                    rounds.setdefault(r.key, []).append(r.value)
        # the n-th count belongs to the n-th round of its kind
        paired = {
            "fast_stop_cluster_id": "fast_stop_iteration",
            "fast_stop_evaluated_clusters": "fast_stop_iteration",
            "feature_level_evaluated_features": "feature_level_iteration",
        }
        for key, owner in paired.items():
            for r in sorted((r for r in kept if r.key == key), key=lambda r: r.step)[: len(rounds[owner])]:
                self._note(key, r.value)
        for name, values in by_name.items():
            self._scores[name] = np.array([values[i] for i in sorted(values)])
        return self


def sequential_selection(scorer: Scorer, features: Sequence[str], n_features: int, direction: str = "forward") -> list[str]:
    """Greedy selection by the validation score; the earlier feature wins ties."""
    features = list(features)
    if not 0 < n_features <= len(features):
        raise ValueError("n_features must be between 1 and the number of features")
    picked: list[str] = []
    rounds = n_features if direction == "forward" else len(features) - n_features
    for _ in range(rounds):
        open_features = [f for f in features if f not in picked]
        sets = [[g for g in features if g in picked or g == f] for f in open_features]
        if direction == "backward":
            sets = [[g for g in features if g not in picked and g != f] for f in open_features]
        totals = score_sets(scorer, sets, point=True)
        picked.append(open_features[int(np.argmax(totals))])
    return [f for f in features if (f in picked) == (direction == "forward")]
