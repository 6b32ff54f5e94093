"""Regression metrics, paired bootstrap, intervals and the non-inferiority test."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.draws import POISSON_STEPS, hash_share, poisson_steps, poisson_weight
from seriesmill.functions.special import t_quantile
from seriesmill.operators.ordered import row_index
from seriesmill.operators.quantiles import present, quantiles
from seriesmill.session import as_list, cut_lineage, join_null_safe

EPS = 2.220446049250313e-16
#: Rows that one task numbers for draws with replacement.
CHUNK_ROWS = 100_000
#: Standard deviations by which draws with replacement start below the number of rows.
FILL_MARGIN = 6.0

# Metric names with the base metric and its sign.
METRICS = {
    "neg_rmse": ("rmse", -1),
    "neg_mse": ("mse", -1),
    "mse": ("mse", 1),
    "r2": ("r2", 1),
    "mae": ("mae", 1),
    "rmse": ("rmse", 1),
    "mdae": ("mdae", 1),
    "me": ("me", 1),
    "mde": ("mde", 1),
    "ame": ("ame", 1),
    "amde": ("amde", 1),
}
MEDIAN_METRICS = ("mde", "amde", "mdae")


def _sum_metrics(weight: Column) -> dict[str, Column]:
    """Base metrics that need only weighted sums over columns ``__e`` (error) and ``__y`` (centred target)."""
    n = F.sum(F.when(F.col("__e").isNotNull(), weight))
    squares = F.sum(weight * F.col("__e") * F.col("__e"))
    mean_error = F.try_divide(F.sum(weight * F.col("__e")), n)
    total = F.sum(weight * F.col("__y"))
    deviations = F.sum(weight * F.col("__y") * F.col("__y")) - F.try_divide(total * total, n)
    return {
        "mse": F.try_divide(squares, n),
        "rmse": F.sqrt(F.try_divide(squares, n)),
        "mae": F.try_divide(F.sum(weight * F.abs("__e")), n),
        "me": mean_error,
        "ame": F.abs(mean_error),
        "r2": F.greatest(F.lit(0.0), F.lit(1.0) - squares / (F.greatest(deviations, F.lit(0.0)) + EPS)),
    }


def _signed(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[(F.col(f"__m_{METRICS[m][0]}") * METRICS[m][1]).alias(m) for m in metrics])


def _errors(df: DataFrame, keys: Sequence[str], y: str, y_hat: str) -> DataFrame:
    """Keys, error and target centred on the overall mean (keeps the sums of squares accurate)."""
    centre = df.agg(F.avg(present(F.col(y)))).scalar()
    error = present(F.col(y)) - present(F.col(y_hat))
    # a row without target or prediction counts in no metric
    return df.select(*keys, error.alias("__e"), F.when(error.isNotNull(), present(F.col(y)) - centre).alias("__y"))


def _metric_table(
    rows: DataFrame,
    keys: list[str],
    metrics: Sequence[str],
    levels: int | None,
    draw: Callable[[DataFrame, bool], DataFrame] | None = None,
) -> DataFrame:
    """Metrics per key; ``draw(rows, keep_zero)`` adds ``replicate`` (one of the keys) and ``weight``."""
    bases = list(dict.fromkeys(METRICS[m][0] for m in metrics))
    weight = F.col("weight").cast("double") if draw else F.lit(1.0)
    sums = _sum_metrics(weight)
    options: dict = {"levels": levels}
    if draw:
        options.update(weight="weight", expand=lambda frame: draw(frame, False), expanded=["replicate"])
    parts = []
    if any(b in sums for b in bases):
        drawn = draw(rows, True) if draw else rows
        parts.append(drawn.groupBy(*keys).agg(*[sums[b].alias(f"__m_{b}") for b in bases if b in sums]))
    sides = [F.struct(F.lit(True).alias("__signed"), F.col("__e").alias("__x"))] if {"mde", "amde"} & set(bases) else []
    sides += [F.struct(F.lit(False).alias("__signed"), F.abs("__e").alias("__x"))] if "mdae" in bases else []
    if sides:
        # both medians in one chain: a row per kind of error
        kinds = rows.select("*", F.inline(F.array(*sides)))
        middle = quantiles(kinds, "__x", [0.5], [*keys, "__signed"], names=["__q"], **options)
        signed, unsigned = F.max(F.when(F.col("__signed"), F.col("__q"))), F.max(F.when(~F.col("__signed"), F.col("__q")))
        parts.append(middle.groupBy(*keys).agg(signed.alias("__m_mde"), F.abs(signed).alias("__m_amde"), unsigned.alias("__m_mdae")))
    if not keys:  # one row each: give them a key to meet on
        parts = [part.withColumn("__one", F.lit(1)) for part in parts]
    table = parts[0]
    for part in parts[1:]:
        table = join_null_safe(table, part, keys or ["__one"], "left")
    return _signed(table, keys, metrics)


def regression_metrics(
    df: DataFrame, y: str, y_hat: str, group: Sequence[str] | str, metrics: Sequence[str] = tuple(METRICS), levels: int | None = None
) -> DataFrame:
    """One column per metric and one row per group; the error is ``y - y_hat``.

    Means are one aggregation.  Medians are exact and use the binned quantiles,
    so no group is held by one task.
    """
    group = as_list(group)
    return _metric_table(_errors(df, group, y, y_hat), group, metrics, levels)


def draw_weights(
    df: DataFrame,
    row_id: str,
    replicates: int,
    seed: int,
    method: str = "md5",
    mode: str = "poisson",
    keep_zero: bool = False,
    population: DataFrame | None = None,
) -> DataFrame:
    """Rows with their multiplicity ``weight`` in each replicate; rows not drawn are left out.

    ``keep_zero`` keeps the rows that ``poisson`` did not draw: cheaper when only
    weighted sums follow, because a filter would hash every row a second time.

    ``poisson``: an independent Poisson(1) hash draw per (row, replicate), so
    the drawn total varies around n and nothing is shuffled.
    ``multinomial``: exactly n draws with replacement per replicate, see
    :func:`_fill_up`; no row per draw.  Equal row ids (the same row under several
    candidates) get equal draws in both modes.  ``population`` is the table to draw
    from when ``df`` is only a part of it.
    """
    if mode not in ("poisson", "multinomial"):
        raise ValueError(f"unknown mode {mode!r}")
    steps, seeds, extra = POISSON_STEPS, F.lit(seed), F.lit(0)
    rows = df
    if mode == "multinomial":
        ids = cut_lineage((df if population is None else population).select(row_id).distinct())
        steps, by_replicate, more = _fill_up(ids, row_id, replicates, seed, method)
        seeds = F.element_at(F.array(*[F.lit(s) for s in by_replicate]), F.col("replicate") + 1)
        rows = df.join(more, row_id, "left")
        extra = F.coalesce(F.try_element_at(F.col("__more"), F.col("replicate")), F.lit(0))
    exploded = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # the share is a column of its own, so the hash is taken once and not once per step of the weight
    shared = exploded.withColumn("__share", hash_share(F.col(row_id), F.col("replicate"), seeds, method=method))
    weighted = shared.withColumn("weight", poisson_weight(F.col("__share"), steps) + extra).select(*df.columns, "replicate", "weight")
    return weighted if keep_zero else weighted.filter(F.col("weight") > 0)


def _fill_up(ids: DataFrame, row_id: str, replicates: int, seed: int, method: str, margin: float = FILL_MARGIN) -> tuple[tuple[float, ...], list[int], DataFrame]:
    """What makes independent Poisson draws of ``ids`` exactly as many draws as ids, spread as by drawing with replacement.

    Given their total, Poisson draws are spread like as many draws with
    replacement.  Their mean is therefore taken ``margin`` standard deviations below
    1, and what a replicate still lacks is drawn by position: a few sqrt(n) draws
    instead of n.  A replicate that drew more than n, which is next to impossible,
    is drawn again with another seed; that leaves the distribution as it is.

    Returns the cumulative probabilities, the seed of each replicate and a table
    (``row_id``, ``__more``: replicate to further draws).  Runs jobs; the driver
    gets one total per replicate.
    """
    n = ids.count()
    mean = max(0.0, 1.0 - margin / math.sqrt(n)) if n else 0.0
    steps = poisson_steps(mean)
    seeds, lacking, open_replicates = [seed] * replicates, [0] * replicates, list(range(replicates)) if n else []
    while open_replicates:
        own = F.element_at(F.array(*[F.lit(s) for s in seeds]), F.col("replicate") + 1)
        drawn = ids.repartition(_tasks(ids), row_id).withColumn("replicate", F.explode(F.array(*[F.lit(b) for b in open_replicates])))
        drawn = drawn.withColumn("__share", hash_share(F.col(row_id), F.col("replicate"), own, method=method))
        totals = drawn.groupBy("replicate").agg(F.sum(poisson_weight(F.col("__share"), steps)).alias("drawn")).collect()
        for row in totals:
            lacking[row["replicate"]] = n - row["drawn"]
        open_replicates = [b for b in open_replicates if lacking[b] < 0]
        for b in open_replicates:
            seeds[b] += 1_000_003
    # one job has counted the ids, so that a task numbers about CHUNK_ROWS of them
    drawer = F.floor(hash_share(F.col(row_id), "order", method=method) * (1 + n // CHUNK_ROWS))
    places = row_index(ids.withColumn("__chunk", drawer), [F.col("__chunk"), F.col(row_id)], [F.col("__chunk")], name="__place")
    wanted = ids.sparkSession.createDataFrame(list(enumerate(lacking)), "replicate int, lacking long").filter("lacking > 0")
    draws = wanted.select("replicate", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lacking"))).alias("j"))
    draws = draws.select("replicate", F.floor(hash_share(F.col("j"), F.col("replicate"), seed, "more", method=method) * n).cast("long").alias("__place"))
    counted = draws.groupBy("__place", "replicate").agg(F.count(F.lit(1)).cast("int").alias("k"))
    by_place = counted.groupBy("__place").agg(F.map_from_entries(F.collect_list(F.struct("replicate", "k"))).alias("__more"))
    return steps, seeds, places.join(by_place, "__place").select(row_id, "__more")


def _tasks(df: DataFrame) -> int:
    """Tasks that rows are dealt to before they are multiplied inside them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def paired_bootstrap(
    scored: DataFrame,
    row_id: str,
    y: str,
    y_hat: str,
    replicates: int = 100,
    seed: int = 42,
    candidate: Sequence[str] | str = (),
    metrics: Sequence[str] = ("neg_rmse",),
    method: str = "xxhash64",
    mode: str = "poisson",
    levels: int | None = None,
) -> DataFrame:
    """Metrics of every (candidate, replicate); all candidates share the draws of a row id.

    Predictions are made once and reweighted.  Rows are dealt out by their id
    first, since a large file that cannot be split is one task; the (row,
    replicate) pairs exist only inside a task and collapse to one partial row per
    (candidate, replicate) before the next shuffle.
    """
    keys = [*as_list(candidate), "replicate"]
    errors = _errors(scored, [row_id, *as_list(candidate)], y, y_hat)
    errors = errors.repartition(_tasks(scored), row_id)

    def draw(rows: DataFrame, keep_zero: bool) -> DataFrame:
        return draw_weights(rows, row_id, replicates, seed, method, mode, keep_zero, population=scored)

    return _metric_table(errors, keys, metrics, levels, draw)


def percentile_interval(df: DataFrame, value: str, group: Sequence[str] | str = (), p: float = 0.95) -> DataFrame:
    """Median and the central ``p`` interval over replicates."""
    tail = (1 - p) / 2
    spots = F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail))
    found = df.groupBy(*as_list(group)).agg(F.percentile(value, spots).alias("__q"))
    return found.select(*as_list(group), F.col("__q")[1].alias("median"), F.col("__q")[0].alias("ci_low"), F.col("__q")[2].alias("ci_high"))


def mean_interval(df: DataFrame, value: str, quantile: float | None = None, group: Sequence[str] | str = (), p: float = 0.95) -> DataFrame:
    """Mean and its central ``p`` interval by Student's t with n - 1 degrees of freedom per group.

    ``quantile`` replaces the t value.  A group with a single value has a mean and
    a NULL interval.
    """
    group = as_list(group)
    found = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.count(value).alias("__n"), F.stddev_samp(value).alias("__s"))
    factor = F.lit(quantile) if quantile is not None else t_quantile((1 + p) / 2, F.col("__n") - 1)
    half = F.col("__s") / F.sqrt("__n") * factor
    return found.select(*group, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def non_inferiority(
    scores: DataFrame, candidate: str, baseline, value: str, beta: float = 0.05, margin: float = 0.0
) -> DataFrame:
    """Paired test per candidate: the ``beta`` quantile of (candidate - baseline) must reach ``-margin``.

    One row per (candidate, replicate) goes in; higher values are better.
    """
    base = scores.filter(F.col(candidate) == F.lit(baseline)).select("replicate", F.col(value).alias("__base"))
    difference = scores.filter(F.col(candidate) != F.lit(baseline)).join(base, "replicate")
    return (
        difference.groupBy(candidate)
        .agg(F.percentile(F.col(value) - F.col("__base"), F.lit(beta)).alias("lower_bound"))
        .withColumn("non_inferior", F.col("lower_bound") >= -margin)
    )


def skipping_metrics(df: DataFrame, y: str, y_hat: str, group: Sequence[str] | str = ()) -> DataFrame:
    """MAPE (percent of the signed target), RMSE and MAE over rows with a prediction.

    MAPE also skips rows whose target or prediction is zero.
    """
    present = F.col(y_hat).isNotNull() & ~F.isnan(F.col(y_hat).cast("double"))
    error = F.abs(F.col(y) - F.col(y_hat)).cast("double")
    usable = present & (F.col(y) != 0) & (F.col(y_hat) != 0)
    return df.groupBy(*as_list(group)).agg(
        (F.avg(F.when(usable, F.try_divide(error, F.col(y).cast("double")))) * 100).alias("mape"),
        F.sqrt(F.avg(F.when(present, error * error))).alias("rmse"),
        F.avg(F.when(present, error)).alias("mae"),
    )
