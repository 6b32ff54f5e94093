from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seriesmill.session import checkpoint_folder
from seriesmill.sources import metric_store as M

NEW = "run string, key string, step int, idx long, value double"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "metrics")


def rows(spark, path):
    return sorted((r.run, r.key, r.step, r.idx, r.value) for r in M.read_metrics(spark, path).collect())


def frame(spark, *records):
    return spark.createDataFrame(list(records), NEW)


def files(path, tmp_path):
    return {p: p.stat().st_mtime_ns for p in (tmp_path / "metrics").rglob("*.parquet")}


FIRST = [("7", "testing/rmse", 0, 0, 1.0), ("7", "testing/rmse", 1, 0, 2.0), ("b=1", "testing/rmse", 0, 0, 3.0), ("7", "a b/c:d", 0, 1, None)]


def test_nothing_stored_yet(spark, path):
    assert rows(spark, path) == [] and M.read_metrics(spark, path).columns == ["run", "key", "step", "idx", "value", "batch"]
    assert M.write_metrics(frame(spark), path, "x") == 0 and rows(spark, path) == []


def test_extend_continues_the_steps_of_a_key(spark, path):
    assert M.write_metrics(frame(spark, *FIRST), path, "one") == 3
    assert set(rows(spark, path)) == set(FIRST)
    M.write_metrics(frame(spark, ("7", "testing/rmse", 0, 0, 9.0), ("7", "new", 4, 0, 8.0)), path, "two")
    found = rows(spark, path)
    assert ("7", "testing/rmse", 2, 0, 9.0) in found and ("7", "new", 4, 0, 8.0) in found and len(found) == 6
    # names that look like numbers or hold signs come back as they were
    assert {r[0] for r in found} == {"7", "b=1"} and ("7", "a b/c:d", 0, 1, None) in found


@pytest.mark.parametrize("rule", M.RULES)
def test_a_second_identical_write_changes_nothing(spark, path, rule):
    M.write_metrics(frame(spark, ("r", "old", 0, 0, 1.0)), path, "zero")
    more = frame(spark, ("r", "k", 0, 0, 1.0), ("r", "k", 1, 0, 2.0))
    M.write_metrics(more, path, "one", rule)
    before = rows(spark, path)
    M.write_metrics(more.repartition(4), path, "one", rule)
    assert rows(spark, path) == before and len(before) == 3
    # a batch of its own is not a repetition
    if rule == "extend":
        M.write_metrics(more, path, "two", rule)
        assert [r[2] for r in rows(spark, path) if r[1] == "k"] == [0, 1, 2, 3]


def test_overwrite_replaces_its_keys_only(spark, path, tmp_path):
    M.write_metrics(frame(spark, *FIRST), path, "one")
    before = files(path, tmp_path)
    assert M.write_metrics(frame(spark, ("7", "testing/rmse", 5, 0, 0.5)), path, "two", "overwrite") == 1
    found = rows(spark, path)
    assert [r for r in found if r[:2] == ("7", "testing/rmse")] == [("7", "testing/rmse", 5, 0, 0.5)] and len(found) == 3
    after = files(path, tmp_path)
    # files of the other run are the same files
    assert [p.parent.name for p in before if after.get(p) == before[p]] == ["run=b%3D1"]


def test_error_fails_before_anything_is_written(spark, path, tmp_path):
    M.write_metrics(frame(spark, *FIRST), path, "one")
    before, stored = files(path, tmp_path), rows(spark, path)
    with pytest.raises(M.KeyExists, match="7: testing/rmse"):
        M.write_metrics(frame(spark, ("7", "testing/rmse", 0, 0, 1.0), ("7", "fresh", 0, 0, 1.0)), path, "two", "error")
    assert files(path, tmp_path) == before and rows(spark, path) == stored
    assert M.write_metrics(frame(spark, ("7", "fresh", 0, 0, 1.0)), path, "two", "error") == 1


def test_records_need_names_and_known_rules(spark, path):
    for bad in ((None, "k", 0, 0, 1.0), ("r", "", 0, 0, 1.0)):
        with pytest.raises(ValueError):
            M.write_metrics(frame(spark, bad), path, "x")
    with pytest.raises(ValueError):
        M.write_metrics(frame(spark), path, "x", "odd")


def test_a_long_key_and_extra_columns(spark, path):
    many = spark.range(20_000).select(F.lit("r").alias("run"), F.lit("k").alias("key"), F.col("id").cast("int").alias("step"), F.col("id").alias("idx"), F.lit(1.0).alias("value"), F.lit("x").alias("batch"), F.lit(2).alias("last"))
    M.write_metrics(many, path, "one")
    stored = M.read_metrics(spark, path)
    assert stored.count() == 20_000 and stored.filter("batch = 'one'").count() == 20_000


def test_many_runs_share_a_bounded_number_of_folders(spark, path, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "FOLDERS", 4)
    every = [(f"r{k}", "k", 0, 0, float(k)) for k in range(40)]
    M.write_metrics(frame(spark, *every), path, "one")
    assert len(list((tmp_path / "metrics").glob("run=*"))) <= 4 and rows(spark, path) == sorted(every)
    # the batch once more, with a part of its runs: the other runs of these folders stay
    for _ in range(2):
        M.write_metrics(frame(spark, ("r3", "k", 0, 0, -1.0), ("new", "k", 0, 0, -2.0)), path, "one")
    assert rows(spark, path) == sorted([r for r in every if r[0] != "r3"] + [("r3", "k", 0, 0, -1.0), ("new", "k", 0, 0, -2.0)])
    assert len(list((tmp_path / "metrics").glob("run=*"))) <= 4


def test_folders_of_one_run_without_names_inside(spark, path, monkeypatch):
    monkeypatch.setattr(M, "FOLDERS", 1)
    old = spark.createDataFrame([("a", "k", 0, 0, 1.0, "x"), ("b", "k", 0, 0, 2.0, "x")], NEW + ", batch string")
    old.write.partitionBy("run").parquet(path)
    M.write_metrics(frame(spark, ("b", "k", 0, 0, 3.0), ("c", "k", 0, 0, 4.0)), path, "y")
    assert rows(spark, path) == [("a", "k", 0, 0, 1.0), ("b", "k", 0, 0, 2.0), ("b", "k", 1, 0, 3.0), ("c", "k", 0, 0, 4.0)]


def test_a_write_leaves_no_copies_of_its_records_on_the_disk(spark, path, tmp_path):
    def kept():
        shuffled = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        files = [Path(shuffled.apply(k).getPath()) for k in range(shuffled.size())]
        return {f for f in [*files, *Path(checkpoint_folder(spark).removeprefix("file:")).rglob("*")] if f.is_file()}

    def many(step):
        return spark.range(30_000).select(F.concat(F.lit("r"), F.col("id") % 50).alias("run"), F.lit("k").alias("key"), F.lit(step).alias("step"), F.col("id").alias("idx"), F.rand(1).alias("value"))

    before = kept()
    for batch, rule in (("one", "error"), ("two", "extend"), ("two", "extend"), ("three", "overwrite")):
        M.write_metrics(many(0), path, batch, rule)
    left = kept() - before
    # the store itself has 0.3 MB; what stays are the names of its folders
    assert M.read_metrics(spark, path).count() == 30_000
    assert sum(f.stat().st_size for f in left if f.exists() and f.suffix != ".crc") < 100_000
    assert not [f for f in left if f.name.startswith("shuffle_") and f.exists()]
    assert {f.name[:4] for f in (tmp_path / "metrics").iterdir()} == {"run="}


@pytest.mark.parametrize("rule", M.RULES)
def test_rounds_give_the_same_store(spark, tmp_path, monkeypatch, rule):
    monkeypatch.setattr(M, "FOLDERS", 16)
    monkeypatch.setattr(M, "ROUNDS", 3)
    old = [(f"r{k % 30}", f"k{k % 2}", k, 0, float(k)) for k in range(90)]
    new = [(f"r{k}", "k0" if rule != "error" else "k9", 0, 1, -float(k)) for k in range(0, 60, 2)]
    found = []
    for rows_a_round in (1 << 22, 1):
        monkeypatch.setattr(M, "ROUND_ROWS", rows_a_round)
        path = str(tmp_path / f"store{rows_a_round}")
        M.write_metrics(frame(spark, *old), path, "one")
        for _ in range(2):
            assert M.write_metrics(frame(spark, *new), path, "two", rule) == 30
        M.write_metrics(frame(spark, ("r1", "k0", 0, 2, 0.5)), path, "one")
        found.append(sorted(map(tuple, M.read_metrics(spark, path).collect())))
    assert found[0] == found[1] and len([r for r in found[0] if r[5] == "two"]) == 30


def test_a_failed_round_leaves_the_store_as_it_was(spark, path, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "ROUND_ROWS", 1)
    monkeypatch.setattr(M, "ROUNDS", 3)
    every = [(f"r{k}", "k", 0, 0, float(k)) for k in range(40)]
    M.write_metrics(frame(spark, *every), path, "one")
    before, calls, real = files(path, tmp_path), [], M._rewritten

    def breaks(*args):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(M, "_rewritten", breaks)
    cleanup = spark.conf.get(M._CLEANUP)
    with pytest.raises(RuntimeError, match="lost"):
        M.write_metrics(frame(spark, *every), path, "two")
    assert files(path, tmp_path) == before and rows(spark, path) == sorted(every) and spark.conf.get(M._CLEANUP) == cleanup
    assert len(calls) == 3 and not list((tmp_path / "metrics").glob(".new-*"))
    # what a lost driver leaves is not read, and the write may be repeated
    frame(spark, ("r1", "k", 9, 9, 9.0)).write.partitionBy("run").parquet(f"{path}/.new-left")
    monkeypatch.setattr(M, "_rewritten", real)
    M.write_metrics(frame(spark, *every), path, "two")
    assert rows(spark, path) == sorted(every + [(r[0], "k", 1, 0, r[4]) for r in every])


def test_a_folder_that_cannot_be_swapped_in_comes_back(spark, path, tmp_path, monkeypatch):
    M.write_metrics(frame(spark, *FIRST), path, "one")
    staged = tmp_path / "metrics" / ".new-x"
    frame(spark, ("7", "k", 0, 0, 1.0)).write.partitionBy("run").parquet(str(staged))
    real = M._files

    class Broken:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def rename(self, old, new):
            fresh = ".old" not in old.toString() + new.toString()
            return False if fresh else self.system.rename(old, new)

    monkeypatch.setattr(M, "_files", lambda spark, path: (real(spark, path)[0], Broken(real(spark, path)[1])))
    with pytest.raises(OSError, match="could not move"):
        M._swap_in(spark, str(staged), path)
    assert rows(spark, path) == sorted(FIRST, key=lambda r: r[:4])
