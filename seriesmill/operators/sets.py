"""Set operations, sorting and top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.ordered import row_index
from seriesmill.session import as_list


def stack(*frames: DataFrame, fill_missing: bool = False) -> DataFrame:
    """Rows of all frames, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill_missing), frames)


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).subtract(right.select(key))


def jaccard(first: Column, second: Column) -> Column:
    """Shared items over all items; two empty sets are equal (1)."""
    union = F.size(F.array_union(first, second))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(first, second)) / F.greatest(union, F.lit(1)))


def distinct_pairs(df: DataFrame, owner: str, item: str) -> DataFrame:
    return df.select(owner, item).distinct()


def sort_rows(df: DataFrame, by: Sequence[str] | str, ascending: bool = True) -> DataFrame:
    """Global sort.  A position column, where needed, comes from ``row_index``."""
    columns = [F.col(f"`{c}`") for c in as_list(by)]
    return df.orderBy(*[c.asc_nulls_last() if ascending else c.desc_nulls_last() for c in columns])


def top_values(counts: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values; equal counts by name.  The limit is the report."""
    return counts.orderBy(F.desc("count"), F.col(column)).limit(k)


def select_k_best(scores: DataFrame, k: int, score: str = "score", position: str = "position") -> DataFrame:
    """The k features with the highest score; undefined scores rank last, later columns win ties."""
    value = F.when(F.isnan(score), None).otherwise(F.col(score))
    return scores.orderBy(value.desc_nulls_last(), F.desc(position)).limit(k)


def is_better(candidate: Column, best: Column, target: str | float) -> Column:
    """Whether a value beats another one under ``max``, ``min`` or closeness to a number."""
    if isinstance(target, str):
        better = candidate > best if target == "max" else candidate < best
    else:
        better = F.abs(candidate - target) < F.abs(best - target)
    return F.when(candidate.isNull(), False).when(best.isNull(), True).otherwise(better)


def objective_key(value: Column, target: str | float) -> Column:
    """A sort key that is smallest for the best value."""
    if target == "max":
        return -value
    if target == "min":
        return value
    return F.abs(value - F.lit(float(target)))


def list_runs(runs: DataFrame, order: str, start: int = 0, end: int | None = None, limit: int | None = None) -> DataFrame:
    """The slice ``start:end`` of the ordered run list, at most ``limit`` rows."""
    listed = runs.orderBy(order).offset(start)
    count = min([n for n in (None if end is None else max(end - start, 0), limit) if n is not None], default=None)
    return listed if count is None else listed.limit(count)


def filter_runs(runs: DataFrame, include: str | None = None, exclude: str | None = None, name: str = "name", **equal) -> DataFrame:
    """Runs whose columns equal the given values and whose name passes the two patterns."""
    for column, value in equal.items():
        runs = runs.filter(F.col(column).eqNullSafe(F.lit(value)))
    if include:
        runs = runs.filter(F.col(name).rlike(include))
    if exclude:
        runs = runs.filter(~F.col(name).rlike(exclude))
    return runs


def shuffled_ids(ids: DataFrame, column: str, seed: int) -> DataFrame:
    """A reproducible random order of ids, the order of a hash that any SQL engine can compute."""
    return ids.orderBy(_draw(column, seed), column)


def _draw(column: str, seed: int):
    return F.md5(F.concat_ws("|", F.col(column).cast("string"), F.lit(str(seed))))


def shuffled_positions(ids: DataFrame, column: str, seed: int, name: str = "position") -> DataFrame:
    """The same order as a column: the 0-based place of each id, numbered in 4096 ranges of the hash."""
    draw = _draw(column, seed)
    return row_index(ids, [draw, F.col(column)], [F.substring(draw, 1, 3)], name=name)
