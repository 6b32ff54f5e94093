"""Analytics over stored runs.

Tables: ``runs`` (run, status, settings ...), ``run_metrics`` (run, key, step,
idx, value) and ``run_features`` (run, features).  Per run and key there are
fits x replicates values, a number fixed by settings, so arrays per run stay
small; the number of runs is what grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.text import key_part, median_and_interval, parse_name, under_prefix, value_and_error
from seriesmill.operators.aggregates import best_row, quantile_of
from seriesmill.operators.joins import compare_runs
from seriesmill.operators.ordered import first_in_group
from seriesmill.operators.quantiles import quantiles
from seriesmill.operators.sets import jaccard, objective_key
from seriesmill.session import as_list, join_null_safe

TEST_SERIES = ("amde", "ame", "mae", "mdae", "mde", "me", "n_trials", "neg_rmse", "r2", "rmse")


def metric_arrays(metrics: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One row per run; each key becomes an array in (step, idx) order, NULL when absent.

    For list-valued result cells: fits x replicates values per run and key.
    Statistics of such values come from the long table (``metric_statistics``).
    """
    names = names or keys
    return metrics.filter(F.col("key").isin(list(keys))).groupBy("run").agg(*_cells(keys, names))


def _cells(keys: Sequence[str], names: Sequence[str]) -> list[Column]:
    cells = []
    for key, name in zip(keys, names):
        values = F.collect_list(F.when(F.col("key") == key, F.struct("step", "idx", "value")))
        ordered = F.transform(F.sort_array(values), lambda v: v["value"])
        cells.append(F.when(F.size(values) > 0, ordered).alias(name))
    return cells


def metric_values(metrics: DataFrame, runs: DataFrame, metric: str) -> DataFrame:
    """One row per stored test value: the columns of its run and ``<metric>``."""
    own = metrics.filter(F.col("key") == f"testing/{metric}").select("run", F.col("value").alias(metric))
    return own.join(runs, "run")


def metric_statistics(metrics: DataFrame, names: Sequence[str], aggregation: str) -> DataFrame:
    """One row per run and one column per test metric, aggregated (``min max avg median p=<percent>``)."""
    wanted = metrics.filter(F.col("key").isin([f"testing/{m}" for m in names]))
    return wanted.groupBy("run").agg(*_statistics(names, aggregation))


def _statistics(names: Sequence[str], aggregation: str) -> list[Column]:
    """One aggregate per test metric; values per run and key are fits x replicates, a number set by settings."""
    simple = {"min": F.min, "max": F.max, "avg": F.avg}
    how = simple.get(aggregation) or (lambda c, p=quantile_of(aggregation): F.percentile(c, F.lit(p)))
    return [how(F.when(F.col("key") == f"testing/{m}", F.col("value"))).alias(m) for m in names]


def build_results(
    runs: DataFrame, metrics: DataFrame, features: DataFrame, series: Sequence[str] = TEST_SERIES, aggregation: str = "none"
) -> DataFrame:
    """One row per successful run: settings, test metrics, selected features and loop counters.

    ``aggregation`` ``none`` keeps every metric as an array, any other mode gives one number.
    """
    # metrics and loop records are summed up in one pass
    series = list(series)
    measures = _cells([f"testing/{m}" for m in series], series) if aggregation == "none" else _statistics(series, aggregation)
    summed = _with_models(metrics, measures)
    return (
        runs.filter(F.col("status") == "success")
        .join(features.withColumnRenamed("features", "selected_features"), "run", "left")
        .join(summed, "run", "left")
    )


def loop_counters(metrics: DataFrame) -> DataFrame:
    """Per run: fast stops, iterations, feature-level rounds, fallbacks, features tried, safe removals, fitted models.

    Fitted models: the first baseline plus every candidate except the copied baselines.
    """
    return _with_models(metrics, [])


def _with_models(metrics: DataFrame, measures: Sequence[Column]) -> DataFrame:
    def times(key: str) -> Column:
        return F.count(F.when(F.col("key") == key, 1))

    is_score = under_prefix(F.col("key"), "validation")
    iteration, candidate = key_part(F.col("key"), 1), key_part(F.col("key"), 2)
    # candidates per run are bounded by clusters x iterations
    tried = F.collect_set(F.when(is_score & (candidate != "baseline"), F.struct(iteration, candidate)))
    scored = F.max(is_score)
    counted = metrics.groupBy("run").agg(
        *measures,
        times("fast_stop_iteration").alias("fast_stops"),
        times("selected_cluster_id").alias("total_iterations"),
        times("feature_level_iteration").alias("feature_level_entries"),
        times("feature_level_none_non-inferior_iteration").alias("fallbacks"),
        F.coalesce(F.sum(F.when(F.col("key") == "feature_level_evaluated_features", F.col("value"))), F.lit(0.0))
        .cast("long")
        .alias("feature_level_total_evaluated"),
        F.when(scored, F.size(tried).cast("long") + 1).alias("fitted_models"),
    )
    return counted.withColumn("safe_removals", F.col("feature_level_entries") - F.col("fallbacks"))


def decisions(metrics: DataFrame) -> DataFrame:
    """Why each round took its cluster: ``run, iteration, cluster_id, reason``."""
    taken = metrics.filter(F.col("key") == "selected_cluster_id").select(
        "run", F.col("step").alias("iteration"), F.col("value").cast("int").alias("cluster_id")
    )
    kinds = ("fast_stop_iteration", "feature_level_none_non-inferior_iteration", "feature_level_iteration")
    flags = (
        metrics.filter(F.col("key").isin(list(kinds)))
        .groupBy("run", F.col("value").cast("int").alias("iteration"))
        .agg(*[F.max((F.col("key") == kind).cast("int")).alias(f"f{i}") for i, kind in enumerate(kinds)])
    )
    reason = (
        F.when(F.col("f0") == 1, PASSED)
        .when(F.col("f1") == 1, NOT_PASSED)
        .when(F.col("f2") == 1, PASSED)
        .otherwise("")
    )
    return taken.join(flags, ["run", "iteration"], "left").select("run", "iteration", "cluster_id", reason.alias("reason"))


def candidate_differences(metrics: DataFrame) -> DataFrame:
    """Per (run, iteration, candidate): median RMSE and median, P05 and P95 of the paired score difference."""
    key = F.col("key")
    scores = (
        metrics.filter(under_prefix(key, "validation") & (key_part(key, -1) == "neg_rmse"))
        .select(
            "run",
            key_part(key, 1).cast("int").alias("iteration"),
            key_part(key, 2).alias("candidate"),
            "idx",
            F.col("value").alias("neg_rmse"),
        )
    )
    base = scores.filter(F.col("candidate") == "baseline").select("run", "iteration", "idx", F.col("neg_rmse").alias("base"))
    paired = scores.join(base, ["run", "iteration", "idx"])
    spots = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    found = paired.groupBy("run", "iteration", "candidate").agg(
        F.percentile(-F.col("neg_rmse"), F.lit(0.5)).alias("rmse"),
        F.percentile(F.col("neg_rmse") - F.col("base"), spots).alias("q"),
    )
    return found.select(
        "run",
        "iteration",
        "candidate",
        "rmse",
        F.col("q")[1].alias("diff_median"),
        F.col("q")[0].alias("diff_p05"),
        F.col("q")[2].alias("diff_p95"),
    )


# Lines and reasons of an explanation.
CANDIDATE_LINE = "Cluster ID: %s | RMSE: %s | Difference Median (P05-P95) = %.3f (%.3f - %.3f)"
ITERATION_LINE = "Iteration %d | Cluster (id=%d): [%s]"
PASSED = "Passed non-inferiority test -> stopped early."
NOT_PASSED = "Best median score. Didn't pass non-inferiority test."


def explanations(metrics: DataFrame, clusters: DataFrame, digits: int | None = None) -> DataFrame:
    """``run, explanation``: the decisions of a run as text.  ``clusters`` holds run, cluster_id, features.

    The RMSE stands with all its digits, or with ``digits`` behind the point.
    """
    line = F.format_string(
        CANDIDATE_LINE,
        "candidate",
        F.col("rmse").cast("string") if digits is None else F.format_string(f"%.{digits}f", "rmse"),
        "diff_median",
        "diff_p05",
        "diff_p95",
    )
    lines = candidate_differences(metrics).groupBy("run", "iteration").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("candidate", line.alias("line")))), lambda v: v["line"]), "\n").alias("lines")
    )
    head = F.format_string(ITERATION_LINE, "iteration", "cluster_id", F.concat_ws(", ", "features"))
    reason = F.when(F.col("reason") != "", F.concat(F.lit("\nReason: "), F.col("reason"))).otherwise("")
    blocks = (
        decisions(metrics)
        .join(clusters, ["run", "cluster_id"])
        .join(lines, ["run", "iteration"])
        .select("run", "iteration", F.concat(head, reason, F.lit("\n"), F.col("lines")).alias("block"))
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("iteration", "block"))), lambda v: v["block"])
    return blocks.groupBy("run").agg(F.array_join(ordered, "\n\n").alias("explanation"))


def best_explanation(metrics: DataFrame, texts: DataFrame, metric: str = "rmse") -> DataFrame:
    """The explanation of the run with the lowest mean metric among runs that have one."""
    means = metrics.filter(F.col("key") == f"testing/{metric}").groupBy("run").agg(F.avg("value").alias("mean_metric"))
    return means.join(texts, "run").orderBy("mean_metric", "run").limit(1).select("run", "mean_metric", "explanation")


def method_pairs(runs: DataFrame, method: str, selected: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Jaccard similarity of every method pair inside a group: ``group..., method_a, method_b, score``.

    The first run (by ``order``) stands for a method in its group.  A group then
    holds one row per method, so the pairs number at most methods^2.
    """
    group = as_list(group)
    first = first_in_group(runs.select(*group, method, *order, selected), [*group, method], list(order))
    bundle = first.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(method).alias("m"), F.col(selected).alias("s")))).alias("b"))
    pairs = F.flatten(
        F.transform(
            "b",
            lambda x, i: F.transform(
                F.slice(F.col("b"), i + 2, F.size("b")),
                lambda y: F.struct(x["m"].alias("method_a"), y["m"].alias("method_b"), jaccard(x["s"], y["s"]).alias("score")),
            ),
        )
    )
    return bundle.select(*group, F.inline(pairs))


def agreement(pairs: DataFrame, how: str = "mean") -> DataFrame:
    """Aggregated similarity per unordered method pair, both directions and the diagonal."""
    how_to = {
        "mean": F.avg("score"),
        "median": F.percentile("score", F.lit(0.5)),
        "min": F.min("score"),
        "max": F.max("score"),
    }
    if how not in how_to:
        raise ValueError("how must be mean, median, min or max")
    one = pairs.groupBy("method_a", "method_b").agg(how_to[how].alias("agreement"))
    other = one.select(F.col("method_b").alias("method_a"), F.col("method_a").alias("method_b"), "agreement")
    methods = one.select(F.explode(F.array("method_a", "method_b")).alias("method_a")).distinct()
    diagonal = methods.select("method_a", F.col("method_a").alias("method_b"), F.lit(1.0).alias("agreement"))
    return one.unionByName(other).unionByName(diagonal)


def agreement_matrix(pairs: DataFrame, methods: Sequence[str], how: str = "mean") -> DataFrame:
    """The same as a matrix with one row and column per method; pairs never seen are NULL, the diagonal 1."""
    spark = pairs.sparkSession
    rows = spark.createDataFrame([(m,) for m in methods], "method_a string")
    wide = agreement(pairs, how).groupBy("method_a").pivot("method_b", list(methods)).agg(F.first("agreement"))
    filled = rows.join(wide, "method_a", "left")
    return filled.select(
        F.col("method_a").alias("method"),
        *[F.when(F.col("method_a") == m, F.lit(1.0)).otherwise(F.col(f"`{m}`")).alias(m) for m in methods],
    )


def relative_gain(
    runs: DataFrame, clustering: str, ours: Sequence[str], baseline: str, on: Sequence[str], runtime: str = "fs_runtime", how: str = "right", order: str | None = None
) -> DataFrame:
    """Runtime gain over the baseline in percent for every run with its baseline.

    A setting has one baseline: of several, the first by ``order`` (the fastest, unless given).  ``right``
    keeps baselines that no run is held against, ``left`` runs without baseline;
    their gain is NULL.
    """
    own = runs.filter(F.col(clustering).isin(list(ours))).select(*on, runtime)
    base = runs.filter(F.col(clustering) == baseline).select(*on, F.col(order or runtime).alias("__order"), runtime)
    base = first_in_group(base, list(on), ["__order"]).drop("__order")
    joined = compare_runs(own, base, on, how)
    before, after = F.col(f"{runtime}_baseline"), F.col(f"{runtime}_ours")
    return joined.withColumn("gain", F.try_divide((before - after) * 100, before))


def gain_summary(gains: DataFrame, group: Sequence[str] | str = (), p: float = 0.95, precision: int = 1) -> DataFrame:
    """Median, interval, mean and the formatted text of the gain."""
    group = as_list(group)
    tail = (1 - p) / 2
    found = quantiles(gains, "gain", [tail, 0.5, 1 - tail], group, names=["ci_low", "median", "ci_high"])
    text = median_and_interval(F.col("median"), F.col("ci_low"), F.col("ci_high"), p, precision)
    if not group:
        return found.withColumn("mean_gain", gains.agg(F.avg("gain")).scalar()).withColumn("text", text)
    means = gains.groupBy(*group).agg(F.avg("gain").alias("mean_gain"))
    return join_null_safe(found, means, group).withColumn("text", text)


def best_features(
    runs: DataFrame,
    metrics: DataFrame,
    features: DataFrame,
    scenario: str,
    names: Sequence[str],
    labels: Sequence[str] = (),
    precision: int = 6,
    score: str = "rmse",
) -> DataFrame:
    """Long table ``scenario, item, value`` of the run with the lowest mean score per scenario.

    Items are the sorted features (``feature 0`` ..), the label columns and each
    metric as mean and standard deviation.
    """
    keys = {f"testing/{m}": m for m in names}
    measures = []
    for k, m in keys.items():
        own = F.when(F.col("key") == k, F.col("value"))
        measures += [F.avg(own).alias(f"{m}_mean"), F.stddev_pop(own).alias(f"{m}_std")]
    stats = metrics.filter(F.col("key").isin(list(keys))).groupBy("run").agg(*measures)
    wide = runs.select("run", scenario, *labels).join(stats, "run").join(features.select("run", "features"), "run")
    best = best_row(wide, scenario, f"{score}_mean", ["run"])
    listed = F.transform(
        F.sort_array("features"),
        lambda name, i: F.struct(F.concat(F.lit("feature "), i.cast("string")).alias("item"), name.alias("value")),
    )
    rest = [F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in labels]
    rest += [
        F.struct(F.lit(m).alias("item"), value_and_error(F.col(f"{m}_mean"), F.col(f"{m}_std"), precision).alias("value"))
        for m in names
    ]
    return best.select(scenario, F.inline(F.concat(listed, F.array(*rest))))


def best_features_table(long: DataFrame, scenario: str, scenarios: Sequence[str]) -> DataFrame:
    """One row per item, one column per scenario."""
    return long.groupBy("item").pivot(scenario, list(scenarios)).agg(F.first("value"))


def summary_table(metrics: DataFrame, kinds: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """``run, <agg>/<kind>/<key>...`` from ``metrics/{mean,std}/{train,val,test}/`` and the parts of the run name.

    Runs one small job to list the distinct keys that become columns.
    """
    key = F.col("key")
    wanted = metrics.filter((key_part(key, 0) == "metrics") & key_part(key, 1).isin("mean", "std") & key_part(key, 2).isin(list(kinds)))
    short = wanted.withColumn("key", F.regexp_replace("key", "^metrics/", ""))
    keys = sorted(r.key for r in short.select("key").distinct().collect())
    wide = short.groupBy("run").pivot("key", keys).agg(F.max("value"))
    return wide.withColumn("name_parts", parse_name(F.col("run")))


def best_run(metrics: DataFrame, key: str, target: str | float) -> DataFrame:
    """The run that is best under an objective; arrays count with their best value, ties by name."""
    own = metrics.filter((F.col("key") == key) & F.col("value").isNotNull() & ~F.isnan("value"))
    per_run = own.groupBy("run").agg(F.min(F.struct(objective_key(F.col("value"), target).alias("k"), "value")).alias("b"))
    return per_run.select("run", F.col("b.value").alias("value"), F.col("b.k").alias("k")).orderBy("k", "run").limit(1).drop("k")


def append_metrics(stored: DataFrame, new: DataFrame, on_conflict: str = "extend") -> DataFrame:
    """Stored and new records together.

    New records carry run, key and idx.  ``extend`` gives them the next steps of
    their key, ``overwrite`` replaces the key, ``error`` fails when a key exists.
    """
    keys = ["run", "key"]
    if on_conflict == "overwrite":
        return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
    last = stored.groupBy(*keys).agg(F.max("step").alias("__last"))
    joined = new.join(last, keys, "left")
    if on_conflict == "error":
        clash = F.raise_error(F.concat(F.lit("key already exists: "), F.col("key")))
        checked = joined.withColumn("step", F.when(F.col("__last").isNotNull(), clash.cast("int")).otherwise(F.col("step")))
    elif on_conflict == "extend":
        checked = joined.withColumn("step", F.coalesce(F.col("__last") + 1 + F.col("step"), F.col("step")).cast("int"))
    else:
        raise ValueError(f"unknown conflict rule {on_conflict!r}")
    return stored.unionByName(checked.drop("__last"))


def next_steps(new: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number records of one key 0, 1, .. per run in ``order``."""
    numbered = F.row_number().over(Window.partitionBy("run", "key").orderBy(*order)) - 1
    return new.withColumn("step", numbered)


def has_key(metrics: DataFrame, key: str, strict: bool = True) -> bool:
    """Whether a key exists, or (not strict) any key below it.  Runs one job that stops at the first hit."""
    match = F.col("key") == key
    if not strict:
        match = match | under_prefix(F.col("key"), key)
    return not metrics.filter(match).isEmpty()


def runs_with_key(metrics: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Per run: whether the key exists."""
    match = F.col("key") == key
    if not strict:
        match = match | under_prefix(F.col("key"), key)
    return metrics.groupBy("run").agg(F.max(match).alias("has_key"))


def records_below(metrics: DataFrame, prefix: str) -> DataFrame:
    """All records below a key prefix, with the prefix cut off."""
    return metrics.filter(under_prefix(F.col("key"), prefix)).withColumn("key", F.expr(f"substring(key, {len(prefix) + 2})"))


def copy_records(metrics: DataFrame, source: str, target: str) -> DataFrame:
    """Add a copy of everything below ``source`` under ``target``."""
    copies = records_below(metrics, source).withColumn("key", F.concat(F.lit(target + "/"), F.col("key")))
    return metrics.unionByName(copies.select(*metrics.columns))


def attach_attributes(runs: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Columns for parts of a ``k=v_k2=v2`` run name."""
    parts = parse_name(F.col(name))
    return runs.withColumns({k: F.try_element_at(parts, F.lit(k)) for k in keys})


def median_by(values: DataFrame, metric: str, group: Sequence[str]) -> DataFrame:
    """Median of all test values per group of runs."""
    return quantiles(values, metric, [0.5], group, names=[metric])
