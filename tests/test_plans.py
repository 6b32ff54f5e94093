import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.catalog import solar as solar_catalog
from seriesmill.catalog import wind as wind_catalog
from seriesmill.functions import solar as S
from seriesmill.functions.timefeat import add_cyclical_encodings, minute_of_day
from seriesmill.plans import experiment
from seriesmill.plans import solar as solar_plan
from seriesmill.plans import wind as wind_plan
from seriesmill.session import cut_lineage
from seriesmill.sources import scans, sinks
from seriesmill.sources.quality import quality_report
from seriesmill.streaming import apply_row_steps, read_landing, write_landing


@pytest.fixture(scope="module")
def turbine_tables(spark):
    rng = np.random.default_rng(2)
    at = pd.date_range("2016-05-01", periods=300, freq="10min")
    scada = []
    for turbine in ("T1", "T2"):
        own = pd.DataFrame({"Turbine_ID": turbine, "Timestamp": at})
        for column in ("Gen_RPM", "Amb_WindSpeed", "Grd_Prod_Pwr"):
            base = rng.gamma(4, 2, 300)
            own[f"{column}_Avg"], own[f"{column}_Std"] = base, base * 0.1
        own["Amb_WindDir_Abs_Avg"] = rng.uniform(0, 360, 300)
        own["Amb_WindDir_Relative_Avg"] = rng.uniform(-180, 180, 300)
        own["Nac_Direction_Avg"] = rng.uniform(0, 360, 300)
        own["Gen_Bear_Temp_Avg"] = 5.0  # constant
        own["Hyd_Oil_Temp_Avg"] = np.where(np.arange(300) < 100, np.nan, 1.0)  # sparse
        own["Prod_LatestAvg_TotActPwr"] = base
        scada.append(own)
    scada = pd.concat(scada)
    scada = pd.concat([scada, scada.head(0)])
    mast = pd.DataFrame({"Timestamp": at, "Avg_Windspeed1": rng.gamma(4, 2, 300), "Avg_Windspeed2": rng.gamma(4, 2, 300), "Var_Windspeed1": 0.5, "Var_Windspeed2": 0.4, "Avg_Winddirection2": 1.0})
    mast.loc[0, "Avg_Windspeed2"] = 0.0
    failures = pd.DataFrame({"Turbine_ID": ["T1", "T1"], "Timestamp": [pd.Timestamp("2016-05-02 12:00"), pd.Timestamp("2017-06-01")], "Component": ["GEAR", "GENERATOR"], "Remarks": ["x", "y"]})
    return spark.createDataFrame(scada), spark.createDataFrame(mast), spark.createDataFrame(failures)


def test_wind_plan(spark, turbine_tables, tmp_path):
    scada, mast, failures = turbine_tables
    scans.land_by_year(scada, str(tmp_path / "scada"))
    mast.write.parquet(str(tmp_path / "mast"))
    failures.write.parquet(str(tmp_path / "failures"))
    scada = scans.scan_scada(spark, str(tmp_path / "scada")).filter("year = 2016").drop("year")
    mast = scans.scan_mast(spark, str(tmp_path / "mast"))
    assert "Avg_Winddirection2" not in mast.columns
    joined = wind_plan.assemble(scada, mast, scans.scan_failures(spark, str(tmp_path / "failures")), ["T1", "T2"])
    assert joined.count() == 600
    t1 = joined.filter("`Turbine ID` = 'T1'")
    assert t1.agg(F.max("Failure Timestamp")).first()[0] == dt.datetime(2016, 5, 2, 11, 0)  # summer time removed
    assert t1.filter("RUL = double('inf')").count() > 0 and t1.filter("`Impending Failure`").count() > 0
    assert joined.filter("`Turbine ID` = 'T2' AND RUL < 1e9").count() == 0
    assert "Turbulence Intensity 2" in joined.columns and "Generator RPM_Std" not in joined.columns

    # rows without a later failure have no component, so the published order drops the sparse columns first
    clean = wind_plan.clean(joined)
    assert "Generator Bearing Temperature" not in clean.columns and "Hydraulic Oil Temperature" not in clean.columns
    assert "Total Active Power" not in clean.columns and "Component" not in clean.columns
    assert {"Wind Shear", "Absolute Wind Direction_sin", "MinuteOfDay_cos"} <= set(clean.columns)
    assert clean.filter(F.abs(F.col("Turbulence Intensity 2")) == float("inf")).count() == 0
    report = quality_report(clean, wind_catalog.feature_tags()).filter("level = 'error'")
    assert report.count() == 0

    stable = cut_lineage(clean.withColumn("row_id", F.xxhash64("Turbine ID", "Timestamp")))
    for settings in (
        experiment.Settings(n_features=3, replicates=10, test_fits=1, gap_seconds=3600),
        experiment.Settings(method="f_value", n_features=2, replicates=5, test_fits=1, gap_seconds=3600),
    ):
        outcome = experiment.run(stable, wind_catalog.feature_tags(), settings)
        assert len(outcome.selected) == settings.n_features
        stored = experiment.run_tables("one", outcome, "wind", "T1", settings)
        assert stored["run_metrics"].filter("key = 'testing/rmse'").count() == settings.replicates
        assert ("run_clusters" in stored) == (settings.method == "clusterwise")


def test_solar_plan(spark, tmp_path):
    rng = np.random.default_rng(4)
    at = pd.date_range("2018-07-01", periods=200, freq="15min").strftime("%Y-%m-%d %H:%M:%S")
    names = [f.name for f in scans.station_schema() if f.name not in ("date_time",)]
    folder = tmp_path / "stations"
    folder.mkdir()
    for station in ("station00", "station01"):
        own = pd.DataFrame({"date_time": at, **{n: rng.uniform(1, 300, 200) for n in names}})
        own["nwp_pressure"] = own["lmd_pressure"] = 100000.0 + rng.normal(size=200)
        own["nwp_temperature"] = own["lmd_temperature"] = 20 + rng.normal(size=200)
        own.to_csv(folder / f"{station}.csv", index=False)
    meta = pd.DataFrame({"Station_ID": ["station00", "station01"], "Capacity": [6600, 20000], "PV_Technology": "Poly-Si", "Panel_Size": "1x1", "Module": "m", "Inverters": "i", "Layout": "l", "Panel_Number": [10, 20], "Array_Tilt": "South 33", "Pyranometer": "p", "Longitude": [114.1, 117.4], "Latitude": [38.0, 38.2], "Altitude": [70.0, 5.0]})
    meta.to_csv(tmp_path / "metadata.csv", index=False)
    stations = scans.scan_station(spark, str(folder))
    assert dict(stations.dtypes)["date_time"] == "timestamp"
    assert {r.station: r.n_rows for r in scans.station_inventory(stations).collect()} == {"station00": 200, "station01": 200, "total": 400}
    local = scans.scan_station(spark, str(folder), zone="UTC+8")
    assert local.agg(F.min("date_time")).first()[0] == dt.datetime(2018, 7, 1, 8, 0)
    with pytest.raises(ValueError):
        scans.scan_station(spark, str(folder), zone="CET")
    joined = solar_plan.assemble(stations, scans.scan_station_metadata(spark, str(tmp_path / "metadata.csv")))
    assert joined.select("Latitude").distinct().count() == 2
    day = joined.filter("is_daytime")
    assert 0 < day.count() < 400
    assert day.agg(F.min("NWP Elevation")).first()[0] > -1.5
    clean = solar_plan.clean(joined)
    assert {"Longitude_sin", "NWP Azimuth_cos"} <= set(clean.columns)
    assert quality_report(clean, solar_catalog.feature_tags()).filter("level = 'error'").count() == 0


def test_sun_position_against_published_example(spark):
    # worked example of the NREL solar position report: 2003-10-17 12:30:30 at UTC-7, zenith 50.11162, azimuth 194.34024
    row = spark.sql("SELECT timestamp'2003-10-17 19:30:30' ts, 39.742476D lat, -105.1786D lon, 82000D p, 11D t")
    got = S.add_solar_position(row, "ts", "lat", "lon", "p", "t").first()
    assert got.apparent_zenith == pytest.approx(50.11162, abs=0.02)
    assert got.azimuth == pytest.approx(194.34024, abs=0.03)
    assert got.equation_of_time == pytest.approx(14.64, abs=0.1)


def test_sun_times_and_sky(spark):
    # equator at equinox: about twelve hours of day, noon near 12:07 UTC minus nothing at longitude 0
    row = spark.sql("SELECT date'2024-03-20' d, 0D lat, 0D lon, 0D alt")
    got = S.add_sun_minutes(row, F.col("d"), "lat", "lon", "alt").first()
    assert got.sunset - got.sunrise == pytest.approx(726.7, abs=1.0)
    assert got.noon == pytest.approx(727.4, abs=1.0)
    assert got.dawn < got.sunrise < got.noon < got.sunset < got.dusk
    polar = spark.sql("SELECT date'2024-06-21' d, 80D lat, 0D lon, 0D alt")
    assert S.add_sun_minutes(polar, F.col("d"), "lat", "lon", "alt").first().sunrise is None
    sky = spark.sql("SELECT 0D z, 1D am, 3D tl, 0D alt, 1366D e")
    one = S.add_clear_sky(sky, "z", "am", "tl", "alt", F.col("e")).first()
    assert 900 < one.ghi < 1100 and one.dhi == pytest.approx(one.ghi - one.dni) and one.dni > 700
    night = spark.sql("SELECT 95D z, cast(null AS double) am, 3D tl, 0D alt, 1366D e")
    dark = S.add_clear_sky(night, "z", "am", "tl", "alt", F.col("e")).first()
    assert (dark.ghi, dark.dni, dark.dhi) == (0, 0, 0)
    assert spark.range(1).select(S.relative_airmass(F.lit(0.0)).alias("a")).first().a == pytest.approx(1.0, abs=1e-3)


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([(0, "a", 1), (1, "b", None)], "position int, name string, k int")
    sinks.export_runs(runs, str(tmp_path / "t"), "txt")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["0000 a", "0001 b"]
    sinks.export_runs(runs, str(tmp_path / "c"), "csv")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect())[-1] == "k,name,position"
    sinks.export_runs(runs, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError):
        sinks.export_runs(runs, str(tmp_path / "x"), "yaml")
    sinks.save_results(runs, str(tmp_path / "p"), ["name"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_literature_scan(spark, tmp_path):
    (tmp_path / "l.csv").write_text('Used Features,Authors\n"PV Power, Solar Irrad.",Chen\n,Shi\n')
    got = scans.scan_literature(spark, str(tmp_path / "l.csv"), {"Used Features": "None"}).collect()
    assert [r[0] for r in got] == ["PV Power, Solar Irrad.", "None"]


def test_stream_of_row_steps(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "ts", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_landing(spark, str(tmp_path / "in"), events.schema, 1)
    steps = apply_row_steps(
        stream, lambda d: d.withColumn("m", minute_of_day(F.col("ts"))), lambda d: add_cyclical_encodings(d, ["m"], {"m": (0, 1439)})
    )
    write_landing(steps, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == events.count() and "m_sin" in out.columns
    with pytest.raises(ValueError):
        apply_row_steps(events)
