"""Regular time grids, remaining life, labels and scaling."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.draws import hash_share
from seriesmill.functions.physics import float_divide
from seriesmill.functions.timefeat import whole_days
from seriesmill.operators.quantiles import quantiles
from seriesmill.session import as_list, require_columns


#: Steps of a time grid that one row unfolds into.
GRID_BLOCK = 4096


def fill_gaps(df: DataFrame, ts: str, group: str, step: str = "1 DAY") -> DataFrame:
    """A row for every ``step`` between the first and last instant of each group.

    Other columns of added rows are NULL; rows off the grid are dropped.  The
    grid is made from one (first, last) pair per group and joined on
    (group, instant), which spreads a hot group over all tasks.  Repeated
    instants in a group raise an error, found by the count that sizes the grid.
    """
    per_instant = df.groupBy(group, ts).agg(F.count(F.lit(1)).alias("__n"))
    ends = per_instant.groupBy(group).agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"), F.max("__n").alias("__most"))
    start = F.when(
        F.col("__most") > 1, F.raise_error(F.concat(F.lit("repeated instant in group "), F.col(group).cast("string")))
    ).otherwise(F.col("__first"))
    ends = ends.withColumn("__first", start)
    if re.search("month|quarter|year", step, re.IGNORECASE):
        # calendar steps differ in length and are few
        grid = ends.select(group, F.explode(F.sequence("__first", "__last", F.expr(f"INTERVAL {step}"))).alias(ts))
    else:
        # blocks of steps first, then the steps of a block: no row ever holds a group's whole calendar
        epoch = "timestamp'1970-01-01 00:00:00'"
        width = F.expr(f"unix_micros({epoch} + INTERVAL {step})")
        first, last = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("__first", "__last"))
        counted = ends.select(group, first.alias("__start"), F.floor((last - first) / width).alias("__steps"))
        blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__steps") / GRID_BLOCK))))
        low, high = F.col("__block") * GRID_BLOCK, F.least((F.col("__block") + 1) * GRID_BLOCK - 1, F.col("__steps"))
        places = blocks.withColumn("__place", F.explode(F.sequence(low, high)))
        instant = F.timestamp_micros(F.col("__start") + F.col("__place") * width)
        grid = places.select(group, instant.cast(df.schema[ts].dataType).alias(ts))
    return grid.join(df, [group, ts], "left").select(*df.columns)


def add_rul(
    df: DataFrame,
    asset: str = "serial_number",
    date: str = "date",
    failure: str = "failure",
    max_rul: float | None = None,
    cap: float | None = None,
    healthy_sample: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Days until an asset's last record, plus one, as ``rul``; +inf for assets that never failed.

    ``max_rul`` drops rows above it and ``cap`` cuts values, both only for
    failing assets.  ``healthy_sample`` keeps a share (< 1) or a number (> 1) of
    never-failing assets, chosen by a seeded hash of the id, or none (0).
    """
    if healthy_sample is not None and healthy_sample < 0:
        raise ValueError("healthy_sample must be >= 0")
    assets = df.groupBy(asset).agg(
        F.max(date).alias("__last"), F.max(F.coalesce(F.col(failure), F.lit(False))).alias("__failed")
    )
    share = hash_share(F.col(asset), seed)
    if healthy_sample == 0:
        assets = assets.filter(F.col("__failed"))
    elif healthy_sample is not None and healthy_sample < 1:
        assets = assets.filter(F.col("__failed") | (share < healthy_sample))
    elif healthy_sample is not None and healthy_sample > 1:
        some = assets.filter(~F.col("__failed")).orderBy(share, asset).limit(int(healthy_sample))
        assets = assets.filter(F.col("__failed")).unionByName(some)
    days = whole_days(F.col(date), F.col("__last")).cast("double") + 1
    rul = F.when(F.col("__failed"), days).otherwise(F.lit(float("inf")))
    joined = df.join(assets, asset).withColumn("rul", rul)
    if max_rul is not None:
        joined = joined.filter((F.col("rul") <= max_rul) | ~F.col("__failed"))
    if cap is not None:
        joined = joined.withColumn("rul", F.when(F.col("__failed"), F.least("rul", F.lit(float(cap)))).otherwise(F.col("rul")))
    return joined.drop("__last", "__failed").select(*df.columns, "rul")


def add_binary_labels(df: DataFrame, threshold: float = 7, keep_rul: bool = False) -> DataFrame:
    """``label`` is 1.0 when ``rul <= threshold``."""
    labelled = df.withColumn("label", F.when(F.col("rul") <= threshold, 1.0).otherwise(0.0))
    return labelled if keep_rul else labelled.drop("rul")


def add_quantile_labels(df: DataFrame, column: str, classes: int, name: str = "label", levels: int | None = None) -> DataFrame:
    """Equal-frequency class 0 .. classes-1; intervals are closed on the right, the first on both sides.

    Equal neighbouring edges raise an error.
    """
    probs = [i / classes for i in range(classes + 1)]
    edge_row = quantiles(df, column, probs, levels=levels)
    edges = edge_row.select(F.array(*edge_row.columns)).scalar()
    joined = df.withColumn("__edges", edges)
    value = F.col(column).cast("double")
    label = sum(((value > F.col("__edges")[i]).cast("int") for i in range(1, classes)), F.lit(0))
    unique = F.size(F.array_distinct("__edges")) == classes + 1
    checked = F.when(~unique, F.raise_error(F.lit("quantile edges are not unique"))).otherwise(label)
    return joined.withColumn(name, F.when(value.isNotNull() & ~F.isnan(value), checked)).drop("__edges")


def label_rows(df: DataFrame, classes: int, threshold: float = 7, column: str = "rul") -> DataFrame:
    """Binary labels by threshold for two classes, quantile classes otherwise."""
    if classes == 2:
        return add_binary_labels(df.withColumnRenamed(column, "rul"), threshold, keep_rul=True).withColumnRenamed("rul", column)
    return add_quantile_labels(df, column, classes)


def normalise(df: DataFrame, columns: Sequence[str], mode: str = "minmax") -> DataFrame:
    """z-score (``std``, sample deviation) or min-max of the columns, in place."""
    if mode not in ("std", "minmax"):
        raise ValueError(f"unknown mode {mode!r}")
    columns = as_list(columns)
    require_columns(df, columns)
    fields = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`").cast("double")
        shift, top = (F.avg(c), F.stddev_samp(c)) if mode == "std" else (F.min(c), F.max(c) - F.min(c))
        fields += [shift.alias(f"shift{i}"), top.alias(f"width{i}")]
    placed = df.withColumn("__fit", df.agg(F.struct(*fields)).scalar())
    scaled = {
        name: float_divide(F.col(f"`{name}`") - F.col(f"__fit.shift{i}"), F.col(f"__fit.width{i}"))
        for i, name in enumerate(columns)
    }
    return placed.withColumns(scaled).drop("__fit")


@dataclass(frozen=True)
class ScaleModel:
    """Fitted centre and width per column."""

    columns: tuple[str, ...]
    centre: tuple[float, ...]
    width: tuple[float, ...]
    offset: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(f"`{c}`") - m) / w + self.offset for c, m, w in zip(self.columns, self.centre, self.width)}
        )

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(f"`{c}`") - self.offset) * w + m for c, m, w in zip(self.columns, self.centre, self.width)}
        )


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "standard", levels: int | None = None) -> ScaleModel:
    """Fit once, transform any frame later.  Runs one job; two numbers per column reach the driver.

    ``standard`` (population deviation), ``robust`` (median, quartile range),
    ``minmax`` (to -0.5 .. 0.5) or ``minmax01``.  A width of zero becomes one.
    """
    columns = as_list(columns)
    if kind == "robust":
        spots = [quantiles(df, c, [0.25, 0.5, 0.75], levels=levels).first() for c in columns]
        pairs = [(s.q1, s.q2 - s.q0) for s in spots]
    else:
        measures: list[Column] = []
        for c in columns:
            col = F.col(f"`{c}`").cast("double")
            measures += [F.avg(col), F.stddev_pop(col)] if kind == "standard" else [F.min(col), F.max(col)]
        row = df.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures)]).first()
        found = [(row[2 * i], row[2 * i + 1]) for i in range(len(columns))]
        if kind == "standard":
            pairs = found
        elif kind in ("minmax", "minmax01"):
            pairs = [(low, high - low) for low, high in found]
        else:
            raise ValueError(f"unknown scaler {kind!r}")
    return ScaleModel(
        tuple(columns), tuple(float(m) for m, _ in pairs), tuple(float(w) or 1.0 for _, w in pairs), -0.5 if kind == "minmax" else 0.0
    )
