"""Stored metric records: Parquet in a bounded number of folders, changed key by key."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.session import checkpoint_folder, cut_lineage

KEYS = ["run", "key"]
RECORDS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("idx", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("batch", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("run", T.StringType()),
    ]
)
#: Runs are dealt to this many folders by a hash of their name; a folder bears the name of the first run in it.
FOLDERS = 256
#: A write of more than ``ROUND_ROWS`` records, stored ones of its folders included, goes through its folders in rounds, ``ROUNDS`` at most.
ROUNDS = 8
ROUND_ROWS = 1 << 22
#: Shuffle files go when their query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RULES = ("extend", "overwrite", "error")


class KeyExists(ValueError):
    """A key that must be new is stored already."""


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All stored records: ``run, key, step, idx, value, batch``; none where nothing has been stored yet."""
    return _stored(spark, path).select(*KEYS, "step", "idx", "value", "batch")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All stored records with the ``folder`` that they lie in."""
    try:
        found = spark.read.schema(RECORDS).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], RECORDS)
    # a folder without names holds one run
    return found.withColumnRenamed("run", "folder").withColumn("run", F.coalesce("name", "folder")).drop("name")


def _slot(run: str) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(FOLDERS))


def _placed(records: DataFrame, stored: DataFrame) -> DataFrame:
    """``records`` with their ``slot`` and ``folder``: the folder of the run's name if there is one, else that of its slot, which the first run names."""
    folders = cut_lineage(stored.select("folder").distinct())
    slots = folders.groupBy(_slot("folder").alias("slot")).agg(F.min("folder").alias("old"))
    first = records.groupBy(_slot("run").alias("slot")).agg(F.min("run").alias("first"))
    shared = cut_lineage(first.join(slots, "slot", "left").select("slot", F.coalesce("old", "first").alias("shared")))
    own = folders.select(F.col("folder").alias("run"), F.col("folder").alias("own"))
    # both have a row per folder at most, which the driver lists anyway: the records stay where they are
    placed = records.withColumn("slot", _slot("run")).join(F.broadcast(shared), "slot").join(F.broadcast(own), "run", "left")
    return placed.withColumn("folder", F.coalesce("own", "shared")).drop("own", "shared")


def _files(spark: SparkSession, path: str):
    """The path and its file system, as Spark's own writers use them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


@contextmanager
def _scratch(spark: SparkSession, *paths: str) -> Iterator[None]:
    """Folders that are gone at the end, as are the shuffle files of every query inside."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
        for path in paths:
            where, system = _files(spark, path)
            system.delete(where, True)


def _swap_in(spark: SparkSession, staged: str, path: str) -> None:
    """Every folder below ``staged`` takes the place of the one of its name below ``path``, which comes back if that fails."""
    source, system = _files(spark, staged)
    store, at = _files(spark, path)[0], spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def move(old, new) -> None:
        if not system.rename(old, new):
            raise OSError(f"could not move {old} to {new}")

    system.mkdirs(at(source, ".old"))
    for name in [found.getPath().getName() for found in system.listStatus(source)]:
        if not name.startswith("run="):
            continue
        # as children of a path, not as text: the name is escaped already
        fresh, target, old = at(source, name), at(store, name), at(at(source, ".old"), name)
        if system.exists(target):
            move(target, old)
        try:
            move(fresh, target)
        except Exception:
            if system.exists(old):
                system.rename(old, target)
            raise
    spark.catalog.refreshByPath(path)


def _unchanged(stored: DataFrame, records: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """Stored records of other batches, and those of this batch whose runs are not in ``records``."""
    others = stored.filter(F.col("batch") != batch)
    same = stored.filter((F.col("batch") == batch) | F.col("batch").isNull())
    return others, same.join(records.select("run").distinct(), "run", "left_anti")


def _rewritten(stored: DataFrame, added: DataFrame, batch: str, on_conflict: str) -> DataFrame:
    """What the folders of ``stored`` hold once the placed records ``added`` are in them."""
    others, same = _unchanged(stored, added, batch)
    if on_conflict == "extend":
        last = others.groupBy(*KEYS).agg(F.max("step").alias("last"))
        added = added.join(last, KEYS, "left").withColumn("step", (F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("step")).cast("int")).drop("last")
    elif on_conflict == "overwrite":
        others = others.join(added.select(*KEYS).distinct(), KEYS, "left_anti")
    names = [*RECORDS.names[:-2], F.col("run").alias("name"), F.col("folder").alias("run")]
    return others.select(*names).unionByName(same.select(*names)).unionByName(added.withColumn("batch", F.lit(batch)).select(*names))


def write_metrics(new: DataFrame, path: str, batch: str, on_conflict: str = "extend") -> int:
    """Store ``new`` (``run, key, step, idx, value``) under ``path``; returns how many keys it has.

    ``extend`` puts the records after the stored steps of their key, ``overwrite``
    replaces the keys, ``error`` raises :class:`KeyExists` before anything is written
    when a key is stored already.  ``batch`` names the write: records that an
    earlier attempt of the same batch has stored are replaced, so that a write may
    be repeated after a failure and a second identical write changes nothing.

    Only the folders of the runs in ``new`` are read and replaced; the other keys and
    runs in them are written again as they are.  There are ``FOLDERS`` folders at most,
    so that a store of very many runs is not one file a run.  The new folders are made
    beside the old ones, in rounds of whole folders, and all are swapped in at the end,
    so that readers never meet a part of a key and a failure before that leaves the
    store as it was.  Besides the old and the new folders the disk holds one compressed copy
    of ``new`` and what one round shuffles.  Without records nothing is written.  One
    writer of a store at a time.  Runs jobs.
    """
    if on_conflict not in RULES:
        raise ValueError(f"unknown conflict rule {on_conflict!r}")
    spark = new.sparkSession
    records = new.select(*[F.col(c).cast("string").alias(c) for c in KEYS], F.col("step").cast("int").alias("step"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    copy, staged = f"{checkpoint_folder(spark)}/new-{uuid.uuid4().hex}", f"{path}/.new-{uuid.uuid4().hex}"
    with _scratch(spark, copy, staged):
        # one evaluation of the new records for all that follows, in a tenth of a checkpoint's bytes
        records.write.option("compression", "zstd").parquet(copy)
        records = spark.read.schema(records.schema).parquet(copy)
        nameless = records.filter("run IS NULL OR key IS NULL OR run = '' OR key = ''")
        if nameless.take(1):
            raise ValueError("every record needs a run and a key")
        touched = records.select(*KEYS).distinct()
        count = touched.count()
        if not count:
            return 0
        every = _stored(spark, path)
        placed = _placed(records, every)
        # the folder of a run has the run's slot, whoever named it
        folders = placed.select("folder", "slot").distinct().collect()
        stored = every.filter(F.col("folder").isin([row.folder for row in folders]))
        if on_conflict == "error":
            kept = _unchanged(stored, records, batch)[0].select(*KEYS).distinct()
            clashes = kept.join(touched, KEYS, "left_semi").orderBy(*KEYS).take(5)
            if clashes:
                raise KeyExists("already stored: " + ", ".join(f"{c.run}: {c.key}" for c in clashes))
        rounds = max(1, min(ROUNDS, math.ceil((stored.count() + records.count()) / ROUND_ROWS)))
        for k in range(rounds):
            part = sorted(row.folder for row in folders if row.slot % rounds == k)
            if not part:
                continue
            added = placed.filter(F.col("slot") % rounds == k)
            whole = _rewritten(every.filter(F.col("folder").isin(part)), added, batch, on_conflict)
            # a folder's records go to one file, those of a very long run to several; in order they take less room
            dealt = whole.hint("rebalance", F.col("run")).sortWithinPartitions("run", "name", "key", "step", "idx")
            dealt.write.mode("append").option("compression", "zstd").partitionBy("run").parquet(staged)
        _swap_in(spark, staged, path)
    return count
