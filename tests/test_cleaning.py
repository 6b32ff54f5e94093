import pytest
from pyspark.sql import functions as F

from seriesmill.catalog import solar, wind
from seriesmill.catalog.drives import preset_columns
from seriesmill.catalog.tags import catalog_frame, scenario_features, select_by_tags, tag_filter, target_of
from seriesmill.operators import columns as C
from seriesmill.operators import rows as R
from seriesmill.plans.chain import Chain
from seriesmill.sources.quality import quality_report, rename_checked, validated

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def messy(spark):
    rows = [(1, 1.0, NAN, 5.0, "a"), (2, 2.0, 1.0, 5.0, "a"), (3, INF, None, 5.0, None), (3, INF, None, 5.0, None)]
    return spark.createDataFrame(rows, "id int, x double, y double, c double, s string")


def test_sparse_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(float(i), float(i) if i < 3 else None, float(i) if i < 2 else None) for i in range(4)], "a double, b double, c double")
    assert C.drop_sparse_columns(df, 0.75).columns == ["a", "b"]  # int(0.75 * 4) = 3
    assert C.drop_sparse_columns(df, 0.74).columns == ["a", "b", "c"]  # int(2.96) = 2


def test_missing_and_infinite_rows(messy):
    assert [r.id for r in R.drop_missing_rows(messy).collect()] == [2]
    assert R.drop_missing_rows(messy.select("id", "x")).count() == 4
    assert sorted(r.id for r in R.drop_infinite_rows(messy.select("id", "x"), "x").collect()) == [1, 2]
    assert R.drop_infinite_rows(messy, "c").count() == 1  # any missing column counts
    assert R.drop_duplicate_rows(messy).count() == 3


def test_variance_rules(spark, messy):
    assert "c" not in C.drop_flat_columns(messy, 0.0, ["c", "y"]).columns
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert C.drop_flat_columns(one).columns == ["a", "b"]  # variance of one row is undefined
    two = spark.createDataFrame([(0.0, 0.0), (2.0, 2.1)], "a double, b double")
    assert C.drop_flat_columns(two, 2.0).columns == ["b"]  # exactly at the threshold goes
    assert C.drop_constant_averages(messy.withColumnsRenamed({"c": "c_Avg", "x": "x_Std"})).columns == ["id", "x_Std", "y", "s"]


def test_column_choice(spark, messy):
    assert C.keep_columns(messy, ["y", "id", "zz"]).columns == ["id", "y"]
    with pytest.raises(ValueError):
        C.drop_columns(messy, ["zz"])
    with pytest.raises(ValueError):
        C.rename_columns(messy, {"x": "y"})
    with pytest.raises(ValueError):
        rename_checked(messy, {"id": "id"})
    stats = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, "p")], "`A_Avg` double, `A_Std` double, `A_Max` double, `F_Avg` double, `F` string")
    assert C.keep_averages(stats, {"std": ["A"]}).columns == ["A", "A_Std", "F_Avg", "F"]
    assert C.keep_averages(stats, compat=True).columns == ["A", "A_Std", "A_Max", "F_Avg", "F"]


def test_types(spark):
    df = spark.createDataFrame([("2024-01-02", "true", 7, "x", "1.5")], "date string, failure string, serial_number int, model string, smart_1_raw string")
    typed = C.set_column_types(df)
    assert dict(typed.dtypes) == {"date": "timestamp", "failure": "boolean", "serial_number": "string", "model": "string", "smart_1_raw": "double"}
    assert dict(C.downcast_floats(typed).dtypes)["smart_1_raw"] == "float"
    assert C.health_columns(typed) == ["smart_1_raw"]


def test_presets():
    assert preset_columns("backblaze") == ["smart_187_raw", "smart_188_raw", "smart_197_raw", "smart_198_raw", "smart_5_raw"]
    assert len(preset_columns(["all"])) == 510
    assert len(preset_columns("paper")) == 34
    assert preset_columns(["x", "x"]) == ["x"]


def test_tags(spark):
    tags = {"a": frozenset({"p", "q"}), "b": frozenset({"q"}), "c": frozenset(), "t": frozenset({"target"})}
    assert select_by_tags(tags, include_all=["q"]) == ["a", "b"]
    assert select_by_tags(tags, include_any=["p", "target"], exclude=["q"]) == ["t"]
    assert target_of(tags) == "t"
    with pytest.raises(ValueError):
        target_of({"a": frozenset()})
    table = catalog_frame(spark, tags, {"a": (0, 1)})
    kept = table.filter(tag_filter(F.col("tags"), include_all=["q"], exclude=["p"]))
    assert [r.feature for r in kept.collect()] == ["b"]


def test_catalogs():
    assert target_of(wind.feature_tags()) == "Grid Produced Power"
    assert target_of(solar.feature_tags()) == "Power"
    names = wind.rename_map()
    assert names["Var_Windspeed2"] == "Wind Speed 2_Var" and names["Gen_RPM_Std"] == "Generator RPM_Std"
    assert set(wind.CYCLIC_RANGES) <= {k for k, v in wind.feature_tags().items() if "circular" in v}
    assert set(solar.CYCLIC_RANGES) == {k for k, v in solar.feature_tags().items() if "circular" in v}
    raw = scenario_features(wind.feature_tags(), "digital_twin", "rf")
    encoded = scenario_features(wind.feature_tags(), "forecast_available", "mlp")
    assert "DayOfYear" in raw and "DayOfYear_sin" not in raw and "Generator RPM" in raw
    assert "DayOfYear_sin" in encoded and "DayOfYear" not in encoded and "Generator RPM" not in encoded
    assert "Total Active Power" not in raw


def test_quality_report(spark, messy):
    found = {r.check: (r.level, r.n) for r in quality_report(messy, {"id": 0, "x": 0, "y": 0, "c": 0}, ["id"]).collect()}
    assert found == {
        "columns without tags": ("error", 1),
        "missing values": ("warning", 5),
        "text columns": ("warning", 1),
        "columns without label": ("warning", 4),
    }
    with pytest.raises(ValueError, match="empty table"):
        validated(messy.limit(0), dict.fromkeys(messy.columns, 0))
    with pytest.raises(ValueError, match="without tags"):
        validated(messy, {})


def test_asset_filters(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("c", None)], "serial_number string, failure boolean")
    assert R.keep_failing_assets(df).count() == 2
    assert [r[0] for r in R.failing_assets(df).collect()] == ["a"]
    assert sorted(r[0] for r in R.healthy_assets(df).collect()) == ["b", "c"]
    assert R.filter_assets(df, "b").count() == 1
    assert R.filter_assets(df, [f"x{i}" for i in range(2000)] + ["c"]).count() == 1
    with pytest.raises(ValueError):
        R.require_rows(df, df.filter("serial_number = 'zz'"))


def test_chain(spark):
    a, b = spark.range(5), spark.range(7)
    chain = Chain().apply(lambda d: d.filter("id > 1")).apply_to_each(lambda d: d.limit(1), lambda d: d)
    left, right = chain(a, b)
    assert (left.count(), right.count()) == (1, 5)
    steps = chain(a, b, intermediate=True)
    assert len(steps) == 2 and steps[0][0].count() == 3
    with pytest.raises(ValueError):
        chain(a)
