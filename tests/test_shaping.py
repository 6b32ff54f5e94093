import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seriesmill.functions.timefeat import add_cyclical_encodings, days_to_event, shift_summer_time, whole_days
from seriesmill.operators import reshape as R
from seriesmill.operators.clock import repair_repeated_hour
from seriesmill.operators.split import describe_splits, split_by_time, split_head_tail

INF = float("inf")


def days(spark, n=11):
    return spark.range(n).select(F.col("id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"))


def splits(df):
    return [r.split for r in df.orderBy("id").collect()]


def test_split_edges(spark):
    # span of 10 days, cut at day 5, gap of two days: days 5 +- 1 belong to the parts, day 5 to none
    assert splits(split_by_time(days(spark), "ts", (0.5, 0.5), 2 * 86_400)) == ["train"] * 5 + [None] + ["test"] * 5
    # without a gap the boundary row goes to the earlier part
    assert splits(split_by_time(days(spark), "ts", (0.5, 0.5))) == ["train"] * 6 + ["test"] * 5
    three = splits(split_by_time(days(spark), "ts", (0.4, 0.3, 0.3)))
    assert three == ["train"] * 5 + ["val"] * 3 + ["test"] * 3
    with pytest.raises(ValueError):
        split_by_time(days(spark), "ts", (0.5, 0.6))


def test_describe(spark):
    found = {r.split: r.n_rows for r in describe_splits(split_by_time(days(spark), "ts", (0.5, 0.5)), "ts").collect()}
    assert found == {"train": 6, "test": 5}


def test_head_tail(spark):
    got = split_head_tail(days(spark), [F.col("ts")], [F.to_date("ts")], 0.8).orderBy("ts").collect()
    assert [r.split for r in got] == ["train"] * 8 + ["test"] * 3  # int(8.8) = 8


def test_fill_gaps(spark):
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-01-03", 3.0), ("b", "2024-01-05", 9.0), ("c", "2024-01-01", 0.0), ("c", "2024-01-12", 1.0)]
    df = spark.createDataFrame(rows, "g string, d string, v double").withColumn("d", F.to_date("d"))
    got = R.fill_gaps(df, "d", "g")
    assert {r.g: r.n for r in got.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 3, "b": 1, "c": 12}
    assert got.filter("g = 'a' AND v IS NULL").count() == 1
    with pytest.raises(PySparkException, match="repeated instant"):
        R.fill_gaps(df.union(df), "d", "g").collect()


@pytest.fixture
def disks(spark):
    rows = [("f", "2024-01-01", False), ("f", "2024-01-04", True), ("h", "2024-01-01", False), ("h", "2024-01-02", False)]
    return spark.createDataFrame(rows, "serial_number string, date string, failure boolean").withColumn("date", F.to_timestamp("date"))


def test_rul(disks):
    got = sorted((r.serial_number, r.rul) for r in R.add_rul(disks).collect())
    assert got == [("f", 1.0), ("f", 4.0), ("h", INF), ("h", INF)]
    assert sorted(r.rul for r in R.add_rul(disks, max_rul=3).collect()) == [1.0, INF, INF]
    assert sorted(r.rul for r in R.add_rul(disks, cap=2).collect()) == [1.0, 2.0, INF, INF]
    assert R.add_rul(disks, healthy_sample=0).count() == 2
    assert R.add_rul(disks, healthy_sample=5).count() == 4
    with pytest.raises(ValueError):
        R.add_rul(disks, healthy_sample=-1)
    labels = R.add_binary_labels(R.add_rul(disks), 1)
    assert "rul" not in labels.columns and sorted(r.label for r in labels.collect()) == [0.0, 0.0, 0.0, 1.0]


def test_quantile_labels_match_pandas(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=501)
    df = spark.createDataFrame(pd.DataFrame({"i": range(501), "v": values}))
    got = R.label_rows(df, 5, column="v").orderBy("i").toPandas()
    assert (got.label.to_numpy() == pd.qcut(values, 5, labels=False)).all()
    ties = spark.createDataFrame([(1.0,)] * 8 + [(2.0,)], "v double")
    with pytest.raises(PySparkException, match="not unique"):
        R.add_quantile_labels(ties, "v", 4).collect()


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    standard = R.fit_scaler(df, ["a", "b"])
    got = standard.transform(df).toPandas()
    np.testing.assert_allclose(got.a, (np.array([1, 2, 6]) - 3) / np.std([1, 2, 6]))
    assert (got.b == 0).all()  # a constant column keeps width one
    np.testing.assert_allclose(standard.inverse(standard.transform(df)).toPandas().a, [1, 2, 6])
    np.testing.assert_allclose(R.fit_scaler(df, "a", "minmax").transform(df).toPandas().a, [-0.5, -0.3, 0.5])
    np.testing.assert_allclose(R.fit_scaler(df, "a", "robust").transform(df).toPandas().a, [-0.4, 0, 1.6])
    normal = R.normalise(df, ["b"], "minmax").toPandas()
    assert normal.b.isna().all()  # 0/0


def test_time_functions(spark):
    df = spark.createDataFrame([(0.0,), (180.0,), (360.0,)], "w double")
    got = add_cyclical_encodings(df, ["w"], {"w": (0, 360)}).toPandas()
    np.testing.assert_allclose(got.w_sin, 0, atol=1e-12)
    np.testing.assert_allclose(got.w_cos, [1, -1, 1])
    with pytest.raises(KeyError):
        add_cyclical_encodings(df, ["w"], {})
    rows = [("2016-03-27 02:59:59", None), ("2016-03-27 03:00:00", "2016-03-27 02:30:00"), ("2016-10-30 02:00:00", "2016-11-02 01:59:59")]
    stamps = spark.createDataFrame(rows, "a string, b string").select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    left = stamps.select(days_to_event(F.col("a"), F.col("b")).alias("d"), whole_days(F.col("a"), F.col("b")).alias("w")).collect()
    assert [r.d for r in left] == [INF, -1.0, 2.0]
    shifted = shift_summer_time(stamps, "a", [("2016-03-27 03:00:00", "2016-10-30 02:00:00")]).select(F.date_format("a", "HH:mm:ss")).collect()
    assert [r[0] for r in shifted] == ["02:59:59", "02:00:00", "02:00:00"]


def clock_frame(spark, late=range(6, 12), assets=("t1",)):
    rows = []
    for k, asset in enumerate(assets):
        for slot in range(0, 31):
            at = pd.Timestamp("2016-10-30") + pd.Timedelta(minutes=10 * slot + (60 if slot in late else 0))
            rows.append((asset, at.to_pydatetime(), float(slot + k), float(100 - 2 * slot)))
    return spark.createDataFrame(rows, "asset string, ts timestamp, a double, b double")


def test_repeated_hour_is_repaired(spark):
    broken = clock_frame(spark, assets=("t1", "t2")).union(clock_frame(spark, late=(), assets=("fine",)))
    got = repair_repeated_hour(broken, "asset", "ts", ["a", "b"]).orderBy("asset", "ts").toPandas()
    assert len(got) == 93 and not got.duplicated(["asset", "ts"]).any()
    assert (got[got.asset == "t1"].a.diff().dropna() == 1).all()
    with pytest.raises(PySparkException, match="odd number"):
        repair_repeated_hour(clock_frame(spark, late=range(6, 11)), "asset", "ts", ["a", "b"]).collect()
