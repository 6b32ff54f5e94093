"""Groups of features.  The correlation matrix is computed on Spark; grouping a few hundred names is driver work."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.scoring import correlation_matrix, forest_importance

Clusters = dict[int, list[str]]


def pair_name(feature: str) -> str | None:
    """The other half of a sine/cosine pair."""
    if feature.endswith("_sin"):
        return feature[:-4] + "_cos"
    if feature.endswith("_cos"):
        return feature[:-4] + "_sin"
    return None


def singletons(features: Sequence[str]) -> Clusters:
    return {i: [f] for i, f in enumerate(features)}


def median_linkage_groups(distance: np.ndarray, cut: float) -> list[int]:
    """Group number per item: median linkage, joined while the largest height in a subtree is <= ``cut``.

    The distance of a merged pair (i, j) to k is
    sqrt(d(k,i)^2 / 2 + d(k,j)^2 / 2 - d(i,j)^2 / 4).  Heights may shrink on the
    way up, so the largest height below a node decides.  Every row knows its nearest
    later neighbour, and a heap orders the rows; a row is searched again only when
    its turn comes and its neighbour is not there any more, which makes about n^2
    steps instead of n^3.  Of equally near pairs the first in row order is merged.
    """
    n = len(distance)
    d = np.array(distance, dtype=float)
    d[np.tri(n, dtype=bool)] = np.inf  # a pair stands in the row of its smaller number
    members = [[i] for i in range(n)]
    peak = np.zeros(n)
    label = list(range(n))
    alive = np.ones(n, bool)
    # the nearest later item of every row; a key in the heap may be too low, never too high
    nearest = d.argmin(axis=1) if n else np.empty(0, int)
    least = d[np.arange(n), nearest] if n else np.empty(0)
    heap = [(float(least[i]), i) for i in range(n - 1)]
    heapq.heapify(heap)
    for _ in range(n - 1):
        while True:
            key, i = heap[0]
            if not alive[i] or key != least[i]:
                heapq.heappop(heap)  # an entry that a later one has replaced
                continue
            if alive[nearest[i]] and d[i, nearest[i]] == key:
                break
            # the neighbour has gone or has moved away: look at the row again
            nearest[i] = int(d[i].argmin())
            least[i] = d[i, nearest[i]]
            heapq.heapreplace(heap, (float(least[i]), i))
        j = int(nearest[i])
        height = d[i, j]
        to_i = np.concatenate([d[:i, i], [np.inf], d[i, i + 1 :]])
        to_j = np.concatenate([d[:j, j], [np.inf], d[j, j + 1 :]])
        alive[j] = False
        merged = np.sqrt(np.clip(to_i**2 / 2 + to_j**2 / 2 - height**2 / 4, 0, None))
        merged[~alive] = np.inf
        merged[i] = np.inf
        d[:i, i], d[i, i + 1 :] = merged[:i], merged[i + 1 :]
        d[:j, j], d[j, j + 1 :] = np.inf, np.inf
        # a merged item may be nearer than both of its parts were: earlier rows get it as their neighbour
        closer = np.flatnonzero(alive[:i] & (merged[:i] <= least[:i]))
        closer = closer[(merged[closer] < least[closer]) | (nearest[closer] > i)]
        nearest[closer] = i
        least[closer] = merged[closer]
        nearest[i] = int(d[i].argmin())
        least[i] = d[i, nearest[i]]
        for k in [*closer.tolist(), i]:
            heapq.heappush(heap, (float(least[k]), k))
        peak[i] = max(peak[i], peak[j], height)
        members[i] += members[j]
        if peak[i] <= cut:
            first = min(members[i])
            for member in members[i]:
                label[member] = first
    return label


def correlation_clusters(features: Sequence[str], corr: np.ndarray, threshold: float = 0.9) -> Clusters:
    """Median-linkage clusters of ``1 - |r|`` cut at ``1 - threshold``; sine/cosine pairs have distance 0."""
    features = list(features)
    if np.isnan(corr).any():
        raise ValueError("undefined correlations: drop constant columns first")
    distance = np.clip(1 - np.abs(corr), 0, None)
    for i, name in enumerate(features):
        other = pair_name(name)
        if name.endswith("_sin") and other in features:
            j = features.index(other)
            distance[i, j] = distance[j, i] = 0.0
    labels = median_linkage_groups(distance, 1 - threshold)
    found: dict[int, list[str]] = {}
    for name, label in zip(features, labels):
        found.setdefault(label, []).append(name)
    return dict(enumerate(found.values()))


def packed_clusters(ranked: Sequence[str], group_size: int) -> Clusters:
    """First-fit groups of ``group_size``, filled from the end of the ranking; pairs stay together."""
    if group_size < 1:
        raise ValueError("group_size must be positive")
    left = list(ranked)
    groups: list[list[str]] = []
    while left:
        feature = left.pop()
        other = pair_name(feature)
        bundle = [feature]
        if other in left:
            left.remove(other)
            bundle = [feature, other] if feature.endswith("_sin") else [other, feature]
        home = next((g for g in groups if len(g) + len(bundle) <= group_size), None)
        if home is None:
            groups.append(bundle)
        else:
            home.extend(bundle)
    return dict(enumerate(groups))


def hash_order(df: DataFrame, features: Sequence[str], seed: int) -> list[str]:
    """Names in a reproducible random order (one row per feature)."""
    spark = df.sparkSession
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    return [r.feature for r in names.orderBy(F.xxhash64("feature", F.lit(seed)), "feature").collect()]


def feature_clusters(
    df: DataFrame,
    features: Sequence[str],
    method: str,
    target: str | None = None,
    threshold: float = 0.9,
    group_size: int | None = None,
    seed: int = 42,
    **forest,
) -> Clusters:
    """Clusters by ``singletons``, ``correlation``, ``random`` or ``feature_importance``.  Runs jobs for the last three."""
    features = list(features)
    sized = method in ("random", "feature_importance")
    if sized != (group_size is not None):
        raise ValueError(f"group_size must {'' if sized else 'not '}be given for {method!r}")
    if method == "singletons":
        clusters = singletons(features)
    elif method == "correlation":
        clusters = correlation_clusters(features, correlation_matrix(df, features), threshold)
    elif method == "random":
        clusters = packed_clusters(hash_order(df, features, seed), group_size)
    elif method == "feature_importance":
        if target is None:
            raise ValueError("feature_importance needs a target")
        scores = forest_importance(df, features, target, seed, **forest).collect()
        ranked = sorted(scores, key=lambda r: (-r.score, r.position))
        clusters = packed_clusters([r.feature for r in ranked], group_size)
    else:
        raise ValueError(f"unknown clustering method {method!r}")
    check_coverage(clusters, features)
    return clusters


def check_coverage(clusters: Clusters, features: Sequence[str]) -> None:
    members = [f for group in clusters.values() for f in group]
    missing = set(features) - set(members)
    if missing or len(members) != len(set(members)) or set(members) - set(features):
        raise RuntimeError(f"clusters do not cover the features exactly once; missing: {sorted(missing)}")


def cluster_frame(df: DataFrame, clusters: Clusters) -> DataFrame:
    """``cluster_id, features`` as a table."""
    return df.sparkSession.createDataFrame(list(clusters.items()), "cluster_id int, features array<string>")
