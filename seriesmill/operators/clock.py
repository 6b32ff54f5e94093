"""Repair of instants that occur twice because the clock went back one hour."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = pd.Timedelta(hours=1, minutes=10)
HOUR = pd.Timedelta(hours=1)


def _closer_copy(copies: np.ndarray, neighbour: np.ndarray) -> int:
    """Which of two copies resembles the neighbour: vote per signal, a tie goes to the first."""
    votes = np.abs(copies - neighbour).argmin(axis=0)
    return int(np.round(votes.mean()))


def _repair(rows: pd.DataFrame, ts: str, signals: list[str]) -> pd.DataFrame:
    """Walk inward from both ends of the repeated hour of one asset and year."""
    rows = rows.sort_values([ts, *signals], kind="stable").reset_index(drop=True)
    values = rows[signals].to_numpy(dtype=float)
    counts = rows[ts].value_counts()
    repeated = sorted(counts.index[counts > 1])
    if not repeated:
        return rows
    if counts.max() > 2 or len(repeated) % 2:
        raise ValueError("an instant occurs more than twice, or an odd number of instants is repeated")

    def single(instant) -> np.ndarray:
        found = np.flatnonzero((rows[ts] == instant).to_numpy())
        if len(found) != 1:
            raise ValueError(f"expected one row at {instant}")
        return values[found[0]]

    before, after = single(repeated[0] - REACH), single(repeated[-1] + REACH)
    moved = []
    for first, last in zip(repeated[: len(repeated) // 2], reversed(repeated)):
        places = np.flatnonzero((rows[ts] == first).to_numpy())
        chosen = _closer_copy(values[places], before)
        moved.append(places[chosen])
        before = values[places[chosen]]
        places = np.flatnonzero((rows[ts] == last).to_numpy())
        chosen = _closer_copy(values[places], after)
        moved.append(places[1 - chosen])
        after = values[places[chosen]]
    rows.loc[moved, ts] = rows.loc[moved, ts] - HOUR
    return rows


def repair_repeated_hour(df: DataFrame, asset: str, ts: str, signals: Sequence[str]) -> DataFrame:
    """Move one copy of every repeated instant back by an hour.

    Only repeated instants and the two rows 1 h 10 min outside them go to
    Python, grouped by asset and year: at most one repeated hour each.  All
    other rows, and assets without repeats, pass through untouched.
    """
    signals = list(signals)
    repeated = df.groupBy(asset, ts).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    repeated = repeated.select(asset, ts, F.year(ts).alias("__year"))
    reach = F.expr("INTERVAL '01:10' HOUR TO MINUTE")
    edges = repeated.groupBy(asset, "__year").agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"))
    wanted = repeated.unionByName(
        edges.select(asset, "__year", F.explode(F.array(F.col("__first") - reach, F.col("__last") + reach)).alias(ts))
    )
    marked = df.join(wanted, [asset, ts], "left")
    untouched = marked.filter(F.col("__year").isNull()).select(*df.columns)
    touched = marked.filter(F.col("__year").isNotNull()).select(*df.columns, "__year")
    # a fixed number of parts: adaptive execution would merge these few rows into one Python task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    touched = touched.repartition(parts, asset, "__year")

    def repair(rows: pd.DataFrame) -> pd.DataFrame:
        return _repair(rows.drop(columns="__year"), ts, signals)

    repaired = touched.groupBy(asset, "__year").applyInPandas(repair, df.schema)
    return untouched.unionByName(repaired)
