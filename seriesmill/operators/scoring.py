"""Feature scores: F-value, mutual information, forest importance, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.physics import float_divide
from seriesmill.operators.quantiles import bin_of, present

LARGEST = 1.7976931348623157e308


def pearson(x: Column, y: Column) -> Column:
    """Aggregate correlation; NULL for a constant column instead of a division error."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _pearson_of(x: Column, y: Column) -> Column:
    """Correlation over the rows in which both are present."""
    both = x.isNotNull() & y.isNotNull()
    return pearson(F.when(both, x), F.when(both, y))


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All pairs ``feature_a, feature_b, r`` (a before b), each over its complete rows; one pass.

    The pairs of a row exist inside a task only: the aggregate has one group per
    pair and folds them before its shuffle.  An aggregate per pair over the rows as
    they are takes longer to compile than to run from a few dozen pairs on.
    """
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    place = {c: F.col(f"c{i}") for i, c in enumerate(features)}
    numbers = df.select(*[present(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(features)])
    cells = F.array(*[F.struct(F.lit(k).alias("pair"), place[a].alias("x"), place[b].alias("y")) for k, (a, b) in enumerate(pairs)])
    complete = numbers.select(F.inline(cells)).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    found = complete.groupBy("pair").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    first, second = (F.array(*[F.lit(p[k]) for p in pairs]) for k in (0, 1))
    at = F.col("pair") + 1
    return found.select(F.element_at(first, at).alias("feature_a"), F.element_at(second, at).alias("feature_b"), "r")


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Pearson matrix on the driver (features x features).  Runs two passes; undefined cells are NaN.

    Each cell is taken over the rows in which both of its features are present:
    the sums carry, next to a feature (0 where it is missing), whether it is there,
    and its square.
    """
    from seriesmill.operators.gram import gram_sums

    size = len(features)
    numbers = df.select(*[present(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(features)])
    means = numbers.agg(*[F.avg(c).alias(c) for c in numbers.columns]).first()
    shifted = [(F.col(c) - F.lit(float(m or 0.0))) for c, m in zip(numbers.columns, means)]
    zero = F.lit(0.0)
    wide = numbers.select(
        *[F.coalesce(x, zero).alias(f"x{i}") for i, x in enumerate(shifted)],
        *[F.when(x.isNull(), 0.0).otherwise(1.0).alias(f"there{i}") for i, x in enumerate(shifted)],
        *[F.coalesce(x * x, zero).alias(f"square{i}") for i, x in enumerate(shifted)],
    )
    sums = gram_sums(wide, wide.columns, centre=[0.0] * (3 * size))
    if not sums:
        return np.full((size, size), np.nan)
    g = sums[0].gram[1:, 1:]
    x, there, square = slice(0, size), slice(size, 2 * size), slice(2 * size, 3 * size)
    with np.errstate(divide="ignore", invalid="ignore"):
        n = g[there, there]
        mean = g[x, there] / n
        variance = g[square, there] / n - mean * mean
        r = (g[x, x] / n - mean * mean.T) / np.sqrt(np.clip(variance, 0, None) * np.clip(variance, 0, None).T)
    r[~np.isfinite(r)] = np.nan
    spread = np.diag(variance)
    np.fill_diagonal(r, np.where(spread > 0, 1.0, np.nan))
    return np.clip(r, -1, 1)


def f_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``feature, position, score``: F-value of the univariate regression on each feature, one pass.

    A constant feature scores 0, a perfect one the largest double.
    """
    numbers = df.select(*[present(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate([*features, target])])
    y = F.col(f"c{len(features)}")
    measures = []
    for i in range(len(features)):
        x = F.col(f"c{i}")
        measures.append(F.struct(_pearson_of(x, y).alias("r"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n")).alias(f"m{i}"))
    cells = [F.struct(F.lit(f).alias("feature"), F.lit(i).alias("position"), F.col(f"m{i}.r").alias("r"), F.col(f"m{i}.n").alias("n")) for i, f in enumerate(features)]
    found = numbers.agg(*measures).select(F.inline(F.array(*cells)))
    # rounding may carry a perfect correlation beyond one
    square = F.when(F.col("r").isNotNull(), F.least(F.col("r") * F.col("r"), F.lit(1.0)))
    f_value = float_divide(square, F.lit(1.0) - square) * (F.col("n") - 2)
    return found.select("feature", "position", F.least(F.coalesce(f_value, F.lit(0.0)), F.lit(LARGEST)).alias("score"))


def _width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    return F.when(high == low, F.lit(0)).otherwise(F.least(F.floor((value - low) * bins / (high - low)), F.lit(bins - 1)))


def mutual_information(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    bins: int = 16,
    binning: str = "quantile",
    estimator: str = "histogram",
    row_id: str | None = None,
    neighbours: int = 3,
) -> DataFrame:
    """``feature, position, score``: mutual information in nats, each feature over the rows in which it and the target are present.

    NULL and NaN are missing, and so are infinite values where bins have equal
    widths.  A feature without such a row scores 0.

    ``histogram``: a binned contingency table; compare ranks, not values.  One scan
    for the bin edges (ranges or mergeable sketches, of the complete rows of every
    feature) and one for the counts, which shrink to features x bins^2 map-side.
    ``neighbours``: the estimator of
    :func:`~seriesmill.operators.neighbours.neighbour_information`, which needs
    ``row_id`` and moves rows.
    """
    if estimator == "neighbours":
        from seriesmill.operators.neighbours import neighbour_information

        if row_id is None:
            raise ValueError("the neighbour estimator breaks ties by row_id")
        return neighbour_information(df, features, target, row_id, neighbours)
    if estimator != "histogram":
        raise ValueError(f"unknown estimator {estimator!r}")
    columns = [*features, target]
    usable = [present(F.col(f"`{c}`")) for c in columns]
    if binning == "width":
        usable = [F.when(F.abs(value) <= LARGEST, value) for value in usable]
    numbers = df.select(*[value.alias(f"c{i}") for i, value in enumerate(usable)])
    y = F.col(f"c{len(features)}")
    cells = [F.struct(F.lit(i).alias("position"), F.col(f"c{i}").alias("x"), y.alias("y")) for i in range(len(features))]
    # a row per feature exists inside a task only; the edges of all features are one small map
    complete = numbers.select(F.inline(F.array(*cells))).filter("x IS NOT NULL AND y IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    if binning == "width":
        edge = lambda v: F.struct(F.min(v).alias("low"), F.max(v).alias("high"))
        place = lambda v, e: _width_bin(v, e.getField("low"), e.getField("high"), bins)
    elif binning == "quantile":
        levels = int(math.log2(bins))
        if 1 << levels != bins:
            raise ValueError("quantile bins must be a power of two")
        cuts = [(i + 1) / bins for i in range(bins - 1)]
        edge = lambda v: F.percentile_approx(v, cuts, 10000)
        place = lambda v, e: bin_of(v, e, levels)
    else:
        raise ValueError(f"unknown binning {binning!r}")
    edges = complete.groupBy("position").agg(F.struct(edge(x).alias("x"), edge(y).alias("y")).alias("e"))
    known = edges.agg(F.map_from_entries(F.collect_list(F.struct("position", "e")))).scalar()
    placed = complete.withColumn("e", F.try_element_at(known, F.col("position")))
    long = placed.select("position", place(x, F.col("e.x")).cast("long").alias("bx"), place(y, F.col("e.y")).cast("long").alias("by"))
    joint = long.groupBy("position", "bx", "by").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # at most features x bins^2 rows from here on
    sums = {name: F.sum("n").over(Window.partitionBy("position", *more)) for name, more in (("nx", ["bx"]), ("ny", ["by"]), ("nt", []))}
    score = F.sum(F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny"))))
    scores = joint.withColumns(sums).groupBy("position").agg(score.alias("score"))
    named = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, position int")
    return named.join(scores, "position", "left").select("feature", "position", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score"))


def forest_importance(df: DataFrame, features: Sequence[str], target: str, seed: int = 42, **params) -> DataFrame:
    """``feature, position, score`` from a random forest.  Fits a model."""
    from seriesmill.operators.models import fit_model

    model = fit_model(df.select(*features, target), features, target, "rf", {"seed": seed, **params})
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, i, float(v)) for i, (name, v) in enumerate(zip(features, values))]
    return df.sparkSession.createDataFrame(rows, "feature string, position int, score double")
