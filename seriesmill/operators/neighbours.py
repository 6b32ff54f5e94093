"""Mutual information from nearest neighbours, without forming all pairs of rows.

Every feature and the target are replaced by their ranks, which leaves mutual
information as it is.  Ranks are unique, so a strip of ``w`` ranks holds exactly
``w`` rows whatever the data look like, and the neighbours of a row on one axis
are counted by arithmetic.  Only the joint search needs rows to meet: rows within
a strip and its two borders first, then, for the few rows whose neighbours lie
further away than a strip is wide, rows of nearby cells of a grid that widens.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.draws import hash_share
from seriesmill.functions.special import digamma
from seriesmill.operators.ordered import row_index
from seriesmill.operators.quantiles import bin_of, present
from seriesmill.session import cut_lineage

#: Rows that a task ranks at once, about.
RANK_ROWS = 100_000
#: A grid cell is this many times as wide in the next round.
WIDEN = 4


def _slots(value: Column, share: Column, edges: Column, levels: int) -> list[Column]:
    """Ranges of (value, share) of about equal numbers of rows, in their order.

    A value frequent enough to be an edge itself is the last of its range; its rows
    are dealt by their share.
    """
    if not levels:
        return [F.lit(0), F.lit(-1)]
    place = bin_of(value, edges, levels)
    top = F.try_element_at(edges, place + 1)
    return [place, F.when(value.eqNullSafe(top), F.floor(share * (1 << levels)).cast("int")).otherwise(F.lit(-1))]


def joint_ranks(df: DataFrame, features: Sequence[str], target: str, row_id: str, method: str = "xxhash64", rank_rows: int = RANK_ROWS) -> DataFrame:
    """``position, u, v``: 0-based ranks of each feature and of the target over the rows in which both are present.

    NULL and NaN are missing.  Equal values are ranked by a hash of ``row_id`` that
    differs from axis to axis, so that ties carry no information; rows that share
    the identifier and the hash follow the identifier.  Runs one job (the edges of
    the ranges that tasks sort).
    """
    number = len(features)
    wide = df.select(F.col(f"`{row_id}`").alias("id"), *[present(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate([*features, target])])
    rows = wide.count()
    levels = max(0, (-(-rows // rank_rows) - 1).bit_length())
    if levels:
        cuts = [(i + 1) / (1 << levels) for i in range((1 << levels) - 1)]
        edges = F.struct(*[F.percentile_approx(f"c{i}", cuts, 16 << levels).alias(f"e{i}") for i in range(number + 1)])
        wide = wide.withColumn("__e", wide.agg(edges).scalar())
    y = F.col(f"c{number}")

    def cell(i: int) -> Column:
        edge = [F.col(f"__e.e{k}") if levels else F.lit(None) for k in (i, number)]
        return F.struct(F.lit(i).alias("position"), F.col(f"c{i}").alias("x"), y.alias("y"), edge[0].alias("ex"), edge[1].alias("ey"))

    long = wide.select("id", F.inline(F.array(*[cell(i) for i in range(number)]))).filter("x IS NOT NULL AND y IS NOT NULL")
    for axis in ("x", "y"):
        long = long.withColumn(f"t{axis}", hash_share(F.col("id"), F.col("position"), axis, method=method))
        first, second = _slots(F.col(axis), F.col(f"t{axis}"), F.col(f"e{axis}"), levels)
        long = long.withColumns({f"b{axis}": first, f"s{axis}": second}).drop(f"e{axis}")
    for axis, name in (("x", "u"), ("y", "v")):
        long = row_index(long, [F.col(axis), F.col(f"t{axis}"), F.col("id")], [F.col(f"b{axis}"), F.col(f"s{axis}")], ["position"], name)
        long = long.drop(axis, f"t{axis}", f"b{axis}", f"s{axis}")
    return long.select("position", "u", "v")


def nearest_in_strip(u: np.ndarray, v: np.ndarray, wanted: np.ndarray, neighbours: int, reach: int) -> np.ndarray:
    """Distance (larger of the two axes) to the ``neighbours``-th nearest point of every wanted one.

    Walks up and down in order of ``v`` until that axis alone is further away than
    the neighbours found; beyond ``reach`` the walk ends and -1 stands for "further".
    """
    order = np.argsort(v, kind="stable")
    u, v = u[order], v[order]
    asked = np.flatnonzero(wanted[order])
    best = np.full((len(asked), neighbours), np.iinfo(np.int64).max)
    for side in (1, -1):
        active = np.arange(len(asked))
        step = 0
        while len(active):
            step += side
            other = asked[active] + step
            inside = (other >= 0) & (other < len(v))
            active, other = active[inside], other[inside]
            own = asked[active]
            gap = np.abs(v[other] - v[own])
            near = (gap <= reach) & (gap < best[active, -1])
            active, other, own, gap = active[near], other[near], own[near], gap[near]
            distance = np.maximum(gap, np.abs(u[other] - u[own]))
            better = distance < best[active, -1]
            changed = active[better]
            best[changed, -1] = distance[better]
            best[changed] = np.sort(best[changed], axis=1)
    out = np.full(len(v), -1, np.int64)
    out[asked] = np.where(best[:, -1] <= reach, best[:, -1], -1)
    back = np.empty_like(out)
    back[order] = out
    return back


def neighbour_distances(ranks: DataFrame, sizes: DataFrame, neighbours: int = 3, width: float = 2.0) -> DataFrame:
    """``position, u, v, n, e``: distance ``e`` of every row to its ``neighbours``-th nearest, the larger of the two rank differences.

    ``sizes`` has ``position, n``.  Strips are ``width * sqrt(n * neighbours)`` ranks
    wide.  With fewer other rows than ``neighbours`` the furthest counts.  Runs jobs:
    one per round, and a round happens only where rows are left over.
    """
    shape = "position int, u long, v long, n long, side long, e long"
    sized = ranks.join(F.broadcast(sizes.select("position", "n", F.greatest(F.lit(8), F.ceil(F.lit(width) * F.sqrt(F.col("n") * neighbours))).cast("long").alias("side"))), "position")
    home = F.floor(F.col("u") / F.col("side"))
    spread = sized.withColumns({"home": home, "strip": F.explode(F.array(home - 1, home, home + 1))}).filter("strip >= 0 AND strip * side < n")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        u, v = part["u"].to_numpy(), part["v"].to_numpy()
        n, side = int(part["n"].iloc[0]), int(part["side"].iloc[0])
        wanted = (part["home"] == part["strip"]).to_numpy()
        own = part[wanted]
        # a point outside strip and borders is further away than a border is wide
        found = nearest_in_strip(u, v, wanted, min(neighbours, n - 1), side + 1 if n > side else n) if n > 1 else np.zeros(len(u), np.int64)
        return pd.DataFrame({"position": own["position"], "u": own["u"], "v": own["v"], "n": own["n"], "side": own["side"], "e": found[wanted]})

    found = cut_lineage(spread.groupBy("position", "strip").applyInPandas(search, shape))
    done, open_rows = found.filter("e >= 0"), found.filter("e < 0").drop("e")
    factor = WIDEN
    while open_rows.take(1):
        reach = F.col("side") * factor
        near = [F.array(*[F.floor(F.col(c) / reach) + k for k in (-1, 0, 1)]) for c in ("u", "v")]
        asked = open_rows.withColumn("cu", F.explode(near[0])).withColumn("cv", F.explode(near[1]))
        points = sized.select(F.col("position"), F.col("u").alias("pu"), F.col("v").alias("pv"), F.floor(F.col("u") / reach).alias("cu"), F.floor(F.col("v") / reach).alias("cv"))
        pairs = asked.join(points, ["position", "cu", "cv"]).filter("u <> pu").withColumn("e", F.greatest(F.abs(F.col("u") - F.col("pu")), F.abs(F.col("v") - F.col("pv"))))
        ranked = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("position", "u").orderBy("e"))).filter(F.col("nth") <= neighbours)
        kth = ranked.groupBy("position", "u").agg(F.max("e").alias("e"), F.max("nth").alias("got"))
        wanted = F.least(F.lit(neighbours), F.col("n") - 1)
        known = open_rows.join(kth, ["position", "u"], "left")
        sure = (F.col("got") == wanted) & ((F.col("e") <= reach + 1) | (reach >= F.col("n")))
        known = cut_lineage(known.withColumn("sure", F.coalesce(sure, F.lit(False))))
        done = done.unionByName(known.filter("sure").select(*done.columns))
        open_rows = known.filter("NOT sure").drop("e", "got", "sure")
        factor *= WIDEN
    return done.select("position", "u", "v", "n", "e")


def neighbour_information(
    df: DataFrame, features: Sequence[str], target: str, row_id: str, neighbours: int = 3, method: str = "xxhash64", rank_rows: int = RANK_ROWS
) -> DataFrame:
    """``feature, position, score``: mutual information in nats by the neighbour estimator on ranks.

    The mean over rows of ``digamma(n) + digamma(k) - digamma(nu + 1) - digamma(nv + 1)``,
    where ``nu`` and ``nv`` count the other rows nearer than the k-th joint neighbour
    on either axis; never below 0.  Each feature is scored over the rows in which it
    and the target are present; with fewer than two of them it scores 0.  Runs jobs.
    """
    ranks = cut_lineage(joint_ranks(df, features, target, row_id, method, rank_rows))
    sizes = ranks.groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    rows = neighbour_distances(ranks, sizes, neighbours)

    def nearer(place: str) -> Column:
        reach = F.col("e") - 1
        return F.least(F.col(place), reach) + F.least(F.col("n") - 1 - F.col(place), reach)

    mean = F.avg(digamma(nearer("u") + 1) + digamma(nearer("v") + 1))
    scores = rows.filter("n > 1").groupBy("position", "n").agg(mean.alias("m"))
    scores = scores.select("position", (digamma(F.col("n")) + digamma(F.least(F.lit(neighbours), F.col("n") - 1)) - F.col("m")).alias("score"))
    named = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, position int")
    return named.join(scores, "position", "left").select("feature", "position", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score"))
