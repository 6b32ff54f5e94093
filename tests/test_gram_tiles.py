import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.operators.gram import GramScorer, gram_sums, gram_tiles, replicate_weights
from seriesmill.operators.scoring import correlation_matrix


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({f"x{i}": rng.normal(size=300) + i for i in range(9)})
    frame["y"] = frame.x0 - 2 * frame.x3 + rng.normal(size=300)
    frame["row_id"] = range(300)
    frame["split"] = np.where(frame.index < 200, "train", "val")
    return frame


@pytest.mark.parametrize("tile", [1, 3, 4, 128])
def test_tiles_equal_the_whole_matrices(spark, table, tile):
    columns = [*[f"x{i}" for i in range(9)], "y"]
    found = {(s.part, s.replicate): s.gram for s in gram_sums(spark.createDataFrame(table).repartition(3), columns, "split", ["row_id"], 4, "val", centre=[1.0] * 10, tile=tile)}
    assert len(found) == 6
    val = table[table.split == "val"]
    ids = np.array([r[0] for r in spark.createDataFrame(val).orderBy("row_id").select(F.xxhash64("row_id")).collect()], np.int64).view(np.uint64)
    weights = replicate_weights(ids, 4, 42)
    for (part, replicate), gram in found.items():
        own = table[table.split == part]
        z = np.column_stack([np.ones(len(own)), own[columns].to_numpy() - 1.0])
        w = np.ones(len(own)) if replicate < 0 else weights[:, replicate]
        assert np.allclose(gram, (z * w[:, None]).T @ z, rtol=1e-12, atol=1e-9)


def test_a_tile_reads_its_own_columns(spark, table, tmp_path):
    path = str(tmp_path / "wide")
    spark.createDataFrame(table).write.parquet(path)
    plan = gram_tiles(spark.read.parquet(path), [f"x{i}" for i in range(9)], centre=[0.0] * 9, tile=5)._jdf.queryExecution().executedPlan().toString()
    schemas = sorted(re.findall("ReadSchema: struct<([^>]*)>", plan), key=len)
    # blocks 1 x0-x3 and x4-x8: a scan for each of the three pairs
    assert [re.findall(r"(x\d):", s) for s in schemas] == [[f"x{i}" for i in range(4)], [f"x{i}" for i in range(4, 9)], [f"x{i}" for i in range(9)]]


def test_scores_read_by_tile_equal_those_on_the_driver(spark, table):
    frame = spark.createDataFrame(table)
    features = [f"x{i}" for i in range(9)]
    near = GramScorer(frame, features, "y", ["row_id"], replicates=7)
    far = GramScorer(frame, features, "y", ["row_id"], replicates=7, tile=4, resident=10)
    sets = [["x0"], ["x0", "x3"], features]
    for a, b in zip(near.score_many(sets), far.score_many(sets)):
        assert np.allclose(a, b, rtol=1e-10)
    assert np.allclose(near.score(["x3"]), far.score(["x3"])) and near.point_score(sets[1]) == pytest.approx(far.point_score(sets[1]))
    with pytest.raises(ValueError):
        GramScorer(frame.filter("split = 'train'"), features, "y", ["row_id"], replicates=2)


def test_missing_values_fail_or_go_in_every_tile(spark, table):
    holes = table.assign(x8=np.where(table.index % 5 == 0, np.nan, table.x8))
    frame = spark.createDataFrame(holes)
    columns = [f"x{i}" for i in range(9)]
    kept = gram_sums(frame, columns, centre=[0.0] * 9, missing="drop", tile=4)[0].gram
    z = np.column_stack([np.ones(240), holes[columns].dropna().to_numpy()])
    assert np.allclose(kept, z.T @ z)
    with pytest.raises(Exception, match="missing value"):
        gram_sums(frame, columns, centre=[0.0] * 9, tile=4)


def test_wide_correlations(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(60, 150))
    frame = spark.createDataFrame(pd.DataFrame(values, columns=[f"c{i}" for i in range(150)])).coalesce(1)
    assert np.allclose(correlation_matrix(frame, frame.columns), np.corrcoef(values.T), atol=1e-10)
