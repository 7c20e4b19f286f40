"""Column expressions on hand-made values."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from acreflow.functions import columns as C
from acreflow.operators import composite
from acreflow.sources import tables


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_names(spark):
    df = spark.createDataFrame([("gaines county",), ("Gaines County ",), (" Deaf Smith",), ("County",), (None,)], "x string")
    assert [r[0] for r in values(df, C.norm_county(F.col("x")))] == ["GAINES", "GAINES COUNTY", "DEAF SMITH", "COUNTY", None]
    df = spark.createDataFrame([(" El Paso #2 ",), ("a--b",), ("",)], "x string")
    assert [r[0] for r in values(df, C.sanitize_id(F.col("x")))] == ["EL_PASO_2", "A_B", ""]


def test_formats(spark):
    df = spark.createDataFrame([(12345.67,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert values(df, C.fmt_ha(F.col("x")), C.fmt_pct(F.col("x"))) == [("12,345.7", "12345.7%")] + [("NA", "NA")] * 3


def test_clamp_keeps_missing_missing(spark):
    df = spark.createDataFrame([(5.0,), (-1.0,), (0.5,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in values(df, C.clamp(F.col("x"), 0, 1))] == [1.0, 0.0, 0.5, None, None]


def test_power_weights(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-1.0, 0.5), (4.0, 0.5), (None, 1.0), (0.0, -1.0)], "w double, b double")
    assert [r[0] for r in values(df, C.power_weight(F.col("w"), F.col("b")))] == [1.0, 0.0, 2.0, 0.0, 0.0]


def test_quality_bits_and_modes(spark):
    df = spark.createDataFrame([(0,), (8,), (16,), (64,), (128,), (1024,), (2048,)], "qa int")
    assert [r[0] for r in values(df, C.landsat_clear(F.col("qa")))] == [True, False, False, True, False, True, True]
    assert [r[0] for r in values(df, C.sentinel2_clear(F.col("qa")))] == [True] * 5 + [False] * 2
    df = spark.createDataFrame([(1999,), (2000,), (2008,), (2023,)], "y int")
    assert [r[0] for r in values(df, C.sensing_mode(F.col("y")))] == ["NDVI_ONLY_2008mask", "ET_NDVI_2008mask", "FULL", "FULL"]
    assert [r[0] for r in values(df, composite.modis_collection(F.col("y")))] == ["MOD13Q1"] * 3 + ["MYD13Q1"]
    assert composite.sensor_name("Sentinel-2") == "SENTINEL2"
    with pytest.raises(ValueError):
        composite.sensor_name("VIIRS")


def test_minmax_of_one_value_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 5.0), ("b", 5.0)], "k string, x double")
    got = sorted(values(df, "k", C.minmax_over(F.col("x"), Window.partitionBy("k"))), key=str)
    assert [x for k, x in got if k == "b"] == [None, None] and sorted(x for k, x in got if k == "a") == pytest.approx([0.01, 0.505, 1.0])


def test_projections_round_trip(spark):
    df = spark.createDataFrame([(-101.5, 33.2), (-96.0, 23.0), (-80.0, 45.0)], "lon double, lat double")
    for to, back in ((C.albers, C.from_albers), (C.mercator, C.from_mercator)):
        x, y = to(F.col("lon"), F.col("lat"))
        lon, lat = back(F.col("x"), F.col("y"))
        for a, b, c, d in values(df.withColumns({"x": x, "y": y}), "lon", "lat", lon, lat):
            assert math.isclose(a, c, abs_tol=1e-9) and math.isclose(b, d, abs_tol=1e-9)


def test_largest_harvest_takes_the_first_of_equals(spark):
    rows = [("A", 2020, 5.0, 1, "x"), ("A", 2020, 9.0, 3, "y"), ("A", 2020, 9.0, 2, "z"), ("A", 2020, None, 0, "n"), ("B", 2020, None, 1, "only"), ("C", 2020, float("nan"), 1, "nan"), ("C", 2020, 1.0, 2, "one")]
    df = spark.createDataFrame(rows, "county string, year int, area_harvested_ha double, n int, tag string")
    got = {r.county: r.tag for r in tables.largest_harvest(df, tie="n").collect()}
    assert got == {"A": "z", "B": "only", "C": "one"}


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [("COTTON", "GAINES", 2021, r, c, r + c / 10) for r in range(3) for c in range(2)]
    df = spark.createDataFrame(rows, "crop string, county string, year int, row int, col int, value double")
    tables.write_cache(df, path, "weight")
    tables.write_cache(df.withColumn("year", F.lit(2022)), path, "weight")
    back = tables.read_cache(spark, path, "weight")
    assert back.count() == 12 and dict(back.dtypes)["value"] == "double"
    targets = spark.createDataFrame([("GAINES", 2021), ("GAINES", 2020)], "county string, year int")
    assert [tuple(r) for r in tables.not_cached(targets, back).collect()] == [("GAINES", 2020)]
    with pytest.raises(ValueError):
        tables.write_cache(df, path, "other")
    with pytest.raises(ValueError):
        tables.cache_key("other", F.lit(""), F.lit(""), F.lit(1))


def test_statistics_from_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("county,year,area_planted_ha,area_harvested_ha,yield_kg_ha\nGaines County,2021,10,9.5,700\nx,2020,,,\n")
    rows = [tuple(r) for r in tables.read_stats(spark, str(tmp_path / "s.csv")).collect()]
    assert rows == [("GAINES", 2021, 10.0, 9.5, 700.0), ("X", 2020, None, None, None)]


def test_geopackage_layer(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "c.gpkg") as db:
        db.execute("CREATE TABLE counties (COUNTY TEXT, geom BLOB)")
        db.execute("INSERT INTO counties VALUES ('Gaines County', x'4750')")
    rows = tables.county_layer(tables.read_geopackage(spark, str(tmp_path / "c.gpkg"), "counties", ["COUNTY"])).collect()
    assert [(r.COUNTY, r.county_name, bytes(r.geom)) for r in rows] == [("Gaines County", "GAINES", b"GP")]


def test_albers_of_published_points(spark):
    """The worked example of the projection manual (Clarke's ellipsoid of 1866): 35 N, 75 W."""
    df = spark.createDataFrame([(-75.0, 35.0)], "lon double, lat double")
    clarke = C.Albers(axis=6378206.4, e2=0.00676866)
    x, y = clarke.forward(F.col("lon"), F.col("lat"))
    lon, lat = clarke.inverse(F.col("x"), F.col("y"))
    got = df.withColumns({"x": x, "y": y}).select("x", "y", lon, lat).first()
    assert abs(got[0] - 1_885_472.7) < 0.2 and abs(got[1] - 1_535_925.0) < 0.2
    assert abs(got[2] + 75) < 1e-10 and abs(got[3] - 35) < 1e-10
    n, c, rho0, _ = clarke.constants()
    assert abs(n - 0.6029035) < 1e-6 and abs(c - 1.3491594) < 1e-6 and abs(rho0 * 6378206.4 - 9_929_079.6) < 0.2
