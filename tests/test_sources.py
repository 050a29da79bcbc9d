import json

import pytest
from pyspark.sql import functions as F

from levelcast.functions import constants as C
from levelcast.sources import sinks, tables, text
from levelcast.streaming import windows


def write(path, content):
    path.write_text(content)
    return str(path)


def test_altimetry(spark, tmp_path):
    row = "0 1 {y} 3 4 10.0 6 7 12.0 0.5 10 11.0"
    p = write(tmp_path / "a.txt", "HDR x\nHeader_End\n" + "\n".join(row.format(y=y) for y in (1993.01, 1993.04)) + "\nbad line\n")
    got = text.altimetry_level(spark, p).orderBy("decimal_year").collect()
    assert len(got) == 2 and got[0].gmsl == pytest.approx(0.012) and got[0].gmsl_sigma == pytest.approx(0.0005)


def test_budget_and_satellite(spark, tmp_path):
    head = "year," + ",".join(f"{n},{n}_l,{n}_u" for n in text.BUDGET)
    p = write(tmp_path / "b.csv", head + "\n1900," + ",".join(["10,5,15"] * 11) + "\n")
    r = text.budget_reconstruction(spark, p).first()
    assert r.gmsl == pytest.approx(0.01) and r.tws_sigma == pytest.approx(0.01 / 3.29, rel=1e-6)
    p = write(tmp_path / "s.csv", "notes\ndata\nunits\n1993.0,1.5,0.1,-999,2\n")
    r = text.satellite_budget(spark, p, ["gmsl", "steric"]).first()
    assert r.gmsl == pytest.approx(0.0015) and r.steric is None


def test_temperatures(spark, tmp_path):
    p = write(tmp_path / "m.txt", "% comment\n 1850 1 -0.5 0.196\n 1850 2 NaN NaN\n")
    got = text.monthly_temperature(spark, p).orderBy("time").collect()
    assert got[0].temperature == -0.5 and got[0].temperature_sigma == pytest.approx(0.1) and got[1].temperature is None
    p = write(tmp_path / "w.csv", "title\nYear,Jan\n1880," + ",".join(["0.1"] * 11 + ["***"]) + "\n")
    got = text.wide_temperature(spark, p).orderBy("time").collect()
    assert len(got) == 12 and got[0].temperature == 0.1 and got[11].temperature is None
    p = write(tmp_path / "a.csv", "# c\nYear,T\n1880,0.2\n")
    assert text.annual_temperature(spark, p).first().temperature == 0.2


def test_ice(spark, tmp_path):
    p = write(tmp_path / "i.csv", "Year,Mass balance,u,Cumulative,cu\n1992.0,-362.5,36.25,-725,10\n")
    r = text.ice_mass(spark, p).first()
    assert r.mass_balance_rate == pytest.approx(0.001) and r.cumulative_mass_balance > 0 and r.mass_balance_rate_sigma > 0
    assert text.ice_mass(spark, p, flip=False).first().mass_balance_rate == pytest.approx(-0.3625)
    p = write(tmp_path / "d.csv", "y,mb,e,smb,e,d,e\n1985,-10,1,300,5,310,6\n1986,-20,1,300,5,320,6\n")
    got = text.ice_discharge(spark, p).orderBy("decimal_year").collect()
    assert got[1].cumulative_mb == pytest.approx(30 * C.GT_TO_M) and got[0].discharge_rate > 0 > got[0].smb_rate
    assert text.ice_discharge(spark, p, 1986).count() == 1


def test_fixed_width_and_indices(spark, tmp_path):
    p = write(tmp_path / "h_0-700.dat", "".join(f"{v:8.3f}" for v in (1.0, -999.999, 2.0, 3.0, 4.0)))
    got = text.thermosteric_quarterly(spark, p).orderBy("time").collect()
    assert [r.tsl_mm for r in got] == [10.0, 20.0, 30.0, 40.0] and got[0].depth == "0-700" and got[-1].time.year == 1956
    p = write(tmp_path / "mei.txt", "1979 2020\n1979 " + " ".join(["0.5"] * 11 + ["-999.00"]) + "\n")
    got = text.bimonthly_index(spark, p).orderBy("time").collect()
    assert len(got) == 12 and got[11].value is None and got[0].time.day == 15
    p = write(tmp_path / "t.txt", "1958.1 0.93\n1958.2 1.0\n")
    assert text.transmission(spark, p).filter("saod = 0").count() == 1


def test_scenarios_and_catalogue(spark, tmp_path):
    write(tmp_path / "tas_global_SSP1_2_6.csv", "Year,5%,Mean,95%\n2020,1.0,1.2,1.4\n")
    r = text.scenario_temperature(spark, str(tmp_path / "tas_global_*.csv")).first()
    assert r.scenario == "ssp126" and r.temperature_sigma == pytest.approx(0.4 / 3.29)
    found = tables.catalogue(spark, str(tmp_path), r"/(tas)_global_(\w+)\.csv$", ["kind", "name"])
    assert found.first().name == "SSP1_2_6"
    expected = spark.createDataFrame([("tas_global_SSP1_2_6.csv",), ("gone.csv",)], "name string")
    assert [r.name for r in tables.missing_files(found, expected).collect()] == ["gone.csv"]


def test_box_wraps(spark):
    df = spark.createDataFrame([(0.0, 350.0), (0.0, -5.0), (0.0, 100.0), (50.0, 0.0)], "lat double, lon double")
    assert df.filter(tables.box((-10, 10), (340, 20))).count() == 2


def test_ocean_mean_ignores_missing(spark):
    df = spark.createDataFrame([(2000.0, 0.0, 0.0, 10.0, 2.0), (2000.0, 0.0, 0.0, 20.0, None), (2000.0, 60.0, 0.0, 10.0, 5.0)], "decimal_year double, lat double, lon double, depth double, temperature double")
    r = tables.ocean_temperature(df, (-90, 90), (0, 359), (0, 100), offset=0.0).first()
    assert r.mean == pytest.approx((2 + 0.5 * 5) / 1.5)


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda c, s, v: spark.createDataFrame([(c, s, i, 2020.0, v) for i in range(3)], "component string, scenario string, sample_id int, year double, value double")
    sinks.save_projection(make("a", "x", 1.0).unionByName(make("b", "x", 2.0)), path)
    sinks.save_projection(make("a", "x", 5.0), path)
    got = sinks.load_projections(spark, path)
    assert got.filter("component = 'a'").agg(F.avg("value")).first()[0] == 5.0 and got.filter("component = 'b'").count() == 3
    scenarios = spark.createDataFrame([("x",), ("y",)], "scenario string")
    assert sinks.inventory(sinks.load_projections(spark, path, scenarios, ("b",))).count() == 3
    sinks.save_metadata(spark, "a", {"r2": 0.9, "bad": float("nan")}, str(tmp_path / "meta"))
    assert spark.read.parquet(str(tmp_path / "meta")).count() == 1
    sinks.export_json({"x": {"y": [1.0, float("inf")]}}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"x": {"y": [1.0, None]}}
    sinks.export_csv(got.select("value"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).filter("value = '5.000000'").count() == 3


def test_streaming_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling_mean(stream, "ts", "value", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.tumbling_mean(events, "ts", "value", ["event_type"])
    assert spark.table("tumbling").count() == batch.count()
