"""One pass over the rows, then any number of linear models on the driver.

The augmented Gram matrix G = sum of w * z * z' with z = [1, x, y] is all a least
squares fit and its squared error need.  One pass yields G of the training rows
and, for every bootstrap replicate, G of the validation rows.  A candidate
feature set is then a little algebra on (features + 2)^2 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.draws import POISSON_STEPS
from seriesmill.session import cut_lineage

BLOCK_CELLS = 2_000_000  # numbers per in-task work array
#: Columns of a tile's side.
TILE_COLUMNS = 128
#: Numbers of the replicates' matrices that a scorer holds on the driver (400 MB); more stay on the cluster.
RESIDENT_NUMBERS = 50_000_000


@dataclass(frozen=True)
class GramSum:
    part: str
    replicate: int
    gram: np.ndarray


def _uniform(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Counter-based uniforms in [0, 1): one per (row id, replicate), independent of partitioning."""
    with np.errstate(over="ignore"):
        steps = (np.arange(replicates, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20) + np.uint64(1)) * np.uint64(
            0x9E3779B97F4A7C15
        )
        x = ids.astype(np.uint64)[:, None] + steps[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def replicate_weights(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) multiplicities, shape (rows, replicates)."""
    return np.searchsorted(np.array(POISSON_STEPS), _uniform(ids, replicates, seed), side="right").astype(np.float64)


def gram_tiles(
    df: DataFrame,
    columns: Sequence[str],
    part: str | None = None,
    row_id: Sequence[str] = (),
    replicates: int = 0,
    replicated_part: str | None = None,
    seed: int = 42,
    centre: Sequence[float] | None = None,
    missing: str = "error",
    tile: int = TILE_COLUMNS,
) -> DataFrame:
    """Gram matrices of ``[1, columns - centre]`` in tiles: ``part, replicate, first, second, g``.

    Columns (the constant one leads) are cut into blocks of ``tile``; a tile holds
    the products of block ``first`` with block ``second`` (not before it), row by
    row.  ``replicate`` -1 is unweighted.  A tile reads its two blocks only, and a
    task adds up one tile of its rows: ``(1 + replicates) * tile^2`` numbers at most,
    however many columns there are.  Every column is read once per block.

    A row with a missing value in any column fails the job, or is left out with
    ``missing="drop"``, which has every tile look at all columns.  Runs a job for the
    means unless ``centre`` is given; lazy otherwise.
    """
    columns = list(columns)
    if centre is None:
        means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        centre = [float(m or 0.0) for m in means]
    identity: Column = F.xxhash64(*[F.col(c) for c in row_id]) if row_id else F.lit(0).cast("long")
    values = [F.lit(1.0)] + [F.col(f"`{c}`").cast("double") for c in columns]
    shift = np.array([0.0, *centre], dtype=float)

    def holes(places: Sequence[int]) -> Column:
        """Whether one of the columns is missing: a product with it would spoil every sum."""
        found = F.lit(False)
        for i in places:
            found = found | values[i].isNull() | F.isnan(values[i])
        return found

    if missing == "drop":
        # all tiles must be over the same rows
        df = df.filter(~holes(range(len(values))))
    part_column = F.col(part).cast("string") if part else F.lit("all")
    blocks = [range(a, min(a + tile, len(values))) for a in range(0, len(values), tile)]

    def block_pair(first: int, second: int) -> DataFrame:
        left, right = blocks[first], blocks[second]
        chosen = [*left, *([] if first == second else right)]
        numbers = {f"x{i}": values[i] for i in chosen}
        if missing != "drop":
            stop = F.raise_error(F.lit("a row has a missing value: drop incomplete rows first"))
            numbers[f"x{chosen[0]}"] = F.when(holes(chosen), stop).otherwise(values[chosen[0]])
        rows = df.select(part_column.alias("part"), identity.alias("id"), *[v.alias(name) for name, v in numbers.items()]).filter(F.col("part").isNotNull())
        wide, own_shift = len(left), shift[chosen]
        # a block with itself: one half of the cells
        x, y = np.triu_indices(wide) if first == second else (g.reshape(-1) for g in np.indices((wide, len(right))))
        cells = len(x)

        def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals: dict[str, np.ndarray] = {}
            step = max(1, BLOCK_CELLS // cells)
            for batch in batches:
                for name, own in batch.groupby("part"):
                    weighted = replicates if name == replicated_part else 0
                    if name not in totals:
                        totals[name] = np.zeros((1 + weighted, cells))
                    z = own.iloc[:, 2:].to_numpy(dtype=float) - own_shift
                    a, b = z[:, :wide], z[:, -len(right) :]
                    if weighted == 0:
                        totals[name][0] += (a.T @ b)[x, y]
                        continue
                    ids = own["id"].to_numpy(dtype=np.int64).view(np.uint64)
                    for start in range(0, len(own), step):
                        products = a[start : start + step, x] * b[start : start + step, y]
                        totals[name][0] += products.sum(axis=0)
                        totals[name][1:] += replicate_weights(ids[start : start + step], weighted, seed).T @ products
            for name, sums in totals.items():
                for replicate, line in enumerate(sums, -1):
                    whole = np.zeros((wide, len(right)))
                    whole[x, y] = line
                    if first == second:
                        whole[y, x] = line
                    yield pd.DataFrame({"part": [name], "replicate": [replicate], "first": [first], "second": [second], "g": [whole.reshape(-1)]})

        return rows.mapInPandas(add_up, "part string, replicate int, first int, second int, g array<double>")

    partial = None
    for i in range(len(blocks)):
        for j in range(i, len(blocks)):
            partial = block_pair(i, j) if partial is None else partial.unionByName(block_pair(i, j))
    summed = vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")
    return partial.groupBy("part", "replicate", "first", "second").agg(summed)


def _place_tile(gram: np.ndarray, first: int, second: int, g: Sequence[float], tile: int) -> None:
    """Write a tile and its mirror image into the whole matrix."""
    a, b = (slice(k * tile, min((k + 1) * tile, len(gram))) for k in (first, second))
    block = np.asarray(g).reshape(a.stop - a.start, b.stop - b.start)
    gram[a, b] = block
    gram[b, a] = block.T


def gram_sums(
    df: DataFrame,
    columns: Sequence[str],
    part: str | None = None,
    row_id: Sequence[str] = (),
    replicates: int = 0,
    replicated_part: str | None = None,
    seed: int = 42,
    centre: Sequence[float] | None = None,
    missing: str = "error",
    tile: int = TILE_COLUMNS,
) -> list[GramSum]:
    """The matrices of :func:`gram_tiles`, whole, on the driver: (1 + replicates) of them per part."""
    size = len(columns) + 1
    found: dict[tuple[str, int], np.ndarray] = {}
    tiles = gram_tiles(df, columns, part, row_id, replicates, replicated_part, seed, centre, missing, tile)
    for row in tiles.collect():
        gram = found.setdefault((row["part"], row["replicate"]), np.zeros((size, size)))
        _place_tile(gram, row["first"], row["second"], row["g"], tile)
    return [GramSum(name, replicate, gram) for (name, replicate), gram in sorted(found.items())]


class GramScorer:
    """Scores any feature subset for a linear model with intercept; built from one pass over the rows.

    Rows carry ``part`` in {train, val}.  ``score`` returns the negative RMSE of
    every replicate, ``point_score`` the one on the validation rows as they are.
    """

    def __init__(
        self,
        df: DataFrame,
        features: Sequence[str],
        target: str,
        row_id: Sequence[str],
        part: str = "split",
        replicates: int = 100,
        seed: int = 42,
        tile: int = TILE_COLUMNS,
        resident: int = RESIDENT_NUMBERS,
    ):
        self.features = list(features)
        self._place = {name: i + 1 for i, name in enumerate(self.features)}
        self._tile, self._count = tile, replicates
        size = len(self.features) + 2
        tiles = gram_tiles(df, [*self.features, target], part, row_id, replicates, "val", seed, tile=tile)
        self._tiles = self._replicates = None
        whole = {name: np.zeros((size, size)) for name in ("train", "val")}
        seen = set()
        if replicates * size * size > resident:
            # the replicates' matrices stay on the cluster and are read tile by tile
            tiles = cut_lineage(tiles)
            self._tiles = tiles.filter("part = 'val' AND replicate >= 0")
            tiles = tiles.filter("replicate < 0")
        elif replicates:
            self._replicates = np.zeros((replicates, size, size))
        for row in tiles.collect():
            name, replicate = row["part"], row["replicate"]
            if name in whole:
                seen.add(name)
                _place_tile(whole[name] if replicate < 0 else self._replicates[replicate], row["first"], row["second"], row["g"], tile)
        if seen != {"train", "val"}:
            raise ValueError("both train and val rows are needed")
        self._train, self._val = whole["train"], whole["val"]

    def _contrast(self, features: Sequence[str]) -> np.ndarray:
        """Coefficients c of the residual c'z = y - prediction."""
        places = [0, *[self._place[f] for f in features]]
        left = self._train[np.ix_(places, places)]
        right = self._train[places, -1]
        scale = np.sqrt(np.clip(np.diag(left), 1e-300, None))
        beta = np.linalg.lstsq(left / np.outer(scale, scale), right / scale, rcond=1e-12)[0] / scale
        contrast = np.zeros(len(self._train))
        contrast[places] = -beta
        contrast[-1] = 1.0
        return contrast

    def score(self, features: Sequence[str]) -> np.ndarray:
        if self._tiles is not None:
            return self.score_many([features])[0]
        c = self._contrast(features)
        errors = np.einsum("i,bij,j->b", c, self._replicates, c)
        return -np.sqrt(np.clip(errors, 0, None) / self._replicates[:, 0, 0])

    def score_many(self, sets: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """Scores of several sets; one job for all of them where the matrices stay on the cluster."""
        if self._tiles is None or not len(sets):
            return [self.score(s) for s in sets]
        tile = self._tile
        # one more "contrast" reads the weight of the replicate, the first cell
        contrasts = np.stack([*[self._contrast(s) for s in sets], np.eye(1, len(self._train))[0]])

        def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for first, second, g in zip(batch["first"], batch["second"], batch["g"]):
                    a, b = (contrasts[:, k * tile : (k + 1) * tile] for k in (first, second))
                    product = np.einsum("ci,ij,cj->c", a, np.asarray(g).reshape(a.shape[1], b.shape[1]), b, optimize=True)
                    out.append(product * (1 if first == second else 2))
                yield pd.DataFrame({"replicate": batch["replicate"], "e": out})

        parts = self._tiles.mapInPandas(errors, "replicate int, e array<double>").groupBy("replicate").agg(vector_to_array(Summarizer.sum(array_to_vector("e"))).alias("e"))
        table = np.zeros((self._count, len(contrasts)))
        for row in parts.collect():
            table[row["replicate"]] = row["e"]
        return list(-np.sqrt(np.clip(table[:, :-1], 0, None) / table[:, -1:]).T)

    def point_score(self, features: Sequence[str]) -> float:
        c = self._contrast(features)
        return float(-np.sqrt(max(c @ self._val @ c, 0.0) / self._val[0, 0]))
