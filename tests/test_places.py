"""Coordinates: projections, layers and grids of other systems, georeferenced results; cells without numbers."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreflow.functions import columns as C
from acreflow.operators import geo, weights
from acreflow.plans import batch

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("crs", [4326, 4269, 3857, 5070])
def test_projections_are_inverse_in_both_forms(spark, crs):
    lon, lat = np.array([-120.0, -96.0, -67.5]), np.array([24.5, 37.5, 49.0])
    x, y = C.project(lon, lat, 4326, crs, np)
    assert np.allclose(C.project(x, y, crs, 4326, np), (lon, lat), atol=1e-9)
    df = spark.createDataFrame(list(zip(lon.tolist(), lat.tolist(), strict=True)), "lon double, lat double")
    px, py = C.project(F.col("lon"), F.col("lat"), 4326, crs)
    qx, qy = C.project_by(px, py, F.lit(crs), 4326)
    rows = df.select(px.alias("x"), py.alias("y"), qx.alias("lon"), qy.alias("lat")).collect()
    assert np.allclose([(r.x, r.y) for r in rows], np.stack([x, y], -1)) and np.allclose([(r.lon, r.lat) for r in rows], np.stack([lon, lat], -1))


def test_unknown_systems(spark):
    with pytest.raises(ValueError, match="32614"):
        C.project(np.zeros(1), np.zeros(1), 32614, 4326, np)
    assert spark.range(1).select(C.project_by(F.lit(1.0), F.lit(1.0), F.lit(32614), 4326)[0].alias("x")).first().x is None


def ring(*points):
    return np.array([*points, points[0]], float)


def test_polygons_round_trip_as_wkb():
    one = [[ring((0, 0), (9, 0), (9, 9)), ring((5, 1), (6, 1), (6, 2))]]
    two = [*one, [ring((20, 20), (21, 20), (21, 21))]]
    for polygons in (one, two, []):
        back = geo.polygons_of(geo.wkb_of(polygons))
        assert len(back) == len(polygons) and all(np.array_equal(a, b) for p, q in zip(back, polygons, strict=True) for a, b in zip(p, q, strict=True))


def test_densified_sides():
    out = geo.densified(ring((0, 0), (10, 0), (10, 1)), 3.0)
    assert (np.hypot(*np.diff(out, axis=0).T) <= 3.0 + 1e-12).all() and {(0, 0), (10, 0), (10, 1), (2.5, 0)} <= {tuple(p) for p in out.tolist()}
    assert (out[0] == out[-1]).all()


def test_a_layer_in_degrees_has_the_cells_of_one_in_metres(spark):
    """Large counties: straight sides in metres bend in degrees by hundreds of metres."""
    polygons = [[ring((-400_500, 800_250), (-301_000, 803_700), (-352_200, 905_900)), ring((-352_000, 820_000), (-349_000, 820_500), (-351_000, 825_000))]]
    metric = spark.createDataFrame([("a", bytearray(geo.wkb_of(polygons))), ("b", None)], "k string, geom binary")
    degrees = geo.projected_layer(metric, 5070, 4326, longest=500.0)
    grid = (-402_000.0, 907_000.0, 300.0, 360, 340)
    want = {(r.row, r.col) for r in geo.polygon_cells(metric, ["k"], *grid).collect()}
    back = geo.projected_layer(degrees, 4326, 5070)
    assert {(r.row, r.col) for r in geo.polygon_cells(back, ["k"], *grid).collect()} == want and len(want) > 5000
    coarse = geo.projected_layer(geo.projected_layer(metric, 5070, 4326), 4326, 5070, longest=0.01)
    assert {(r.row, r.col) for r in geo.polygon_cells(coarse, ["k"], *grid).collect()} != want  # sides that weren't cut
    assert degrees.where("k = 'b'").first().geom is None and degrees.columns == ["k", "geom"]


def test_counties_by_name_on_their_own_grids(spark):
    box = lambda x, y, s: bytearray(geo.wkb_of([[ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))]]))
    layer = spark.createDataFrame([("  gaines county", box(0.2, 0.2, 3.6)), ("Gaines", box(6.0, 6.0, 2.0)), ("Lynn County", box(0.0, 0.0, 2.0)), ("Empty County", None), (None, box(0.0, 0.0, 5.0))], "COUNTY string, geom binary")
    targets = spark.createDataFrame([(1, "Gaines County", 4326, 0.0, 9.0, 1.0, 9, 9), (2, "LYNN", 4326, -1.0, 2.0, 0.5, 6, 6), (3, "Empty", 4326, 0.0, 9.0, 1.0, 9, 9), (4, "Nowhere", 4326, 0.0, 9.0, 1.0, 9, 9), (5, None, 4326, 0.0, 9.0, 1.0, 9, 9)], "id int, county string, crs int, x_min double, y_max double, res double, n_rows int, n_cols int")
    got = {}
    for r in geo.county_cells(layer, targets, ["id"], touches=False).collect():
        got.setdefault(r.id, set()).add((r.row, r.col))
    assert got == {1: {(8 - y, x) for x in range(4) for y in range(4)} | {(8 - y, x) for x in (6, 7) for y in (6, 7)}, 2: {(r, c) for r in range(4) for c in range(2, 6)}}
    wide = geo.county_cells(layer, targets, ["id"]).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in wide}[2] >= 16
    assert geo.county_cells(layer.limit(0), targets, ["id"]).count() == 0


def test_a_wide_grid_costs_a_small_polygon_nothing():
    spans = list(geo.polygon_spans([ring((90_000.2, 3.2), (90_004.2, 3.2), (90_004.2, 6.2), (90_000.2, 6.2))], 100_000, 100_000))
    assert [(row, cols.tolist()) for row, cols in spans] == [(row, [90_000, 90_001, 90_002, 90_003]) for row in (3, 4, 5)]
    assert list(geo.polygon_spans([ring((-9.0, 1.0), (-5.0, 1.0), (-5.0, 5.0))], 10, 10)) == []


@pytest.mark.parametrize("method", ["bilinear", "near"])
def test_resampling_between_systems(spark, method):
    """A plane in degrees, looked up from metric cells."""
    of, to = geo.Grid(4326, -100.0, 40.0, 0.01), geo.Grid(5070, -333_000.0, 1_880_000.0, 500.0)
    source = spark.createDataFrame([(1, r, c, 3.0 * r + 2.0 * c) for r in range(60) for c in range(60)], "k int, row int, col int, value double")
    target = spark.createDataFrame([(1, r, c) for r in range(0, 40, 7) for c in range(0, 40, 7)], "k int, row int, col int")
    got = {(r.row, r.col): r.value for r in geo.resampled(target, source, to, of, ["k"], method=method).collect()}
    inner = 0
    for r in range(0, 40, 7):
        for c in range(0, 40, 7):
            lon, lat = C.project(np.array([-333_000 + (c + 0.5) * 500]), np.array([1_880_000 - (r + 0.5) * 500]), 5070, 4326, np)
            fr, fc = (40.0 - lat[0]) / 0.01 - 0.5, (lon[0] + 100.0) / 0.01 - 0.5
            if 0 <= fr <= 59 and 0 <= fc <= 59:
                inner += 1
                assert got[r, c] == pytest.approx(3 * fr + 2 * fc if method == "bilinear" else 3 * round(fr) + 2 * round(fc), abs=1e-6)
    assert inner > 20
    with pytest.raises(ValueError):
        geo.resampled(target, source, to, of, ["k"], method="cubic")


def small_run(spark, grids, counties=(1, 2)):
    support = spark.createDataFrame([(c, 2000, x, y, 1.0 + x + y) for c in counties for x in range(12) for y in range(12) if x % 4 and y % 5], "county_id int, yr int, cx int, cy int, w double")
    stats = spark.createDataFrame([(c, 2000, 60, 800) for c in counties], "county_id int, yr int, harvested_cells long, yield_kg_ha long")
    options = batch.DisaggOptions(least_patch=2, most_field=4, side=2, least_unit=1, most_unit=500, cluster_dist_m=100.0, betas=(1.0,))
    return batch.disagg_batch(support, stats, options, grids)


def test_zones_lie_on_their_grid(spark):
    grids = spark.createDataFrame([(1, 5070, -500_000.0, 1_500_000.0, 30.0), (2, 5070, 700_000.0, 900_000.0, 30.0)], "county_id int, crs int, x_min double, y_max double, res double")
    zones = small_run(spark, grids)["merged"].collect()
    for c, (x, y) in {1: (-500_000, 1_500_000), 2: (700_000, 900_000)}.items():
        own = [z for z in zones if z.county_id == c]
        assert own and all(x < z.x < x + 360 and y - 360 < z.y < y for z in own)
        west, north = (v[0] for v in C.project(np.array([float(x)]), np.array([float(y)]), 5070, 4326, np))
        assert all(abs(z.lon - west) < 0.006 and 0 < north - z.lat < 0.006 for z in own)
    plain = lambda c: sorted((z.cluster_id, round(z.cluster_area_ha, 9)) for z in zones if z.county_id == c)
    assert plain(1) == plain(2)


def test_without_a_grid_there_are_no_degrees(spark):
    assert {(z.lon, z.lat) for z in small_run(spark, None)["merged"].collect()} == {(None, None)}
    some = small_run(spark, spark.createDataFrame([(1, 4326, -101.0, 33.0, 0.0003)], "county_id int, crs int, x_min double, y_max double, res double"))
    assert {(r.county_id, r.reason) for r in some["skipped"].collect()} == {(2, "no grid")}
    assert all(-101 < z.lon < -100.99 and 32.99 < z.lat < 33 for z in some["merged"].collect())
    with pytest.raises(ValueError, match="y_max"):
        small_run(spark, spark.range(1).withColumnRenamed("id", "county_id"))


def with_gaps(spark):
    rows = [(1, 2000, i, 0, i / 10, 1.0 + i) for i in range(11)] + [(1, 2000, i, 1, v, v) for i, v in enumerate((NAN, NAN, NAN, INF, -INF, None, NAN, NAN, NAN))]
    return spark.createDataFrame(rows, "county_id int, yr int, cx int, cy int, ndvi double, et double")


def test_cells_without_numbers_count_nowhere(spark):
    cells = with_gaps(spark)
    assert weights.quantile(cells, "ndvi", 0.5).first().ndvi_q == 0.5
    assert weights.screen(cells, "ndvi", 0.05).count() == 10 == weights.screen(cells, "et", 0.05).count()
    harvest = spark.createDataFrame([(1, 2000, 3.0)], "county_id int, yr int, harvested_cells double")
    chosen = weights.eligibility(cells, harvest)
    assert tuple(chosen.first())[2:] == (0.8, 0.8, 3) and weights.eligible(cells, chosen).count() == 3
    w = weights.surface(cells).collect()
    assert len(w) == 11 and sum(x.w_norm for x in w) == pytest.approx(1) and all(math.isfinite(x.weight) for x in w)
    nothing = cells.where("cy = 1")
    assert weights.quantile(nothing, "ndvi", 0.5).count() == weights.eligibility(nothing, harvest).count() == weights.surface(nothing).count() == 0


def test_a_signal_of_gaps_alone_leaves_the_other(spark):
    cells = with_gaps(spark).where("cy = 0")
    for lost, left in (("et", "ndvi"), ("ndvi", "et")):
        w = weights.surface(cells.withColumn(lost, F.lit(NAN))).collect()
        assert len(w) == 11 and sum(x.w_norm for x in w) == pytest.approx(1) and {x[f"w_{lost}"] for x in w} == {None} and all(x.weight == x[f"w_{left}"] for x in w)


def test_no_window_holds_a_county(spark):
    assert "Window" not in weights.surface(with_gaps(spark))._jdf.queryExecution().optimizedPlan().toString()


def test_wkb_of_other_byte_orders_and_heights():
    raw = struct.pack(">BII", 0, 1003, 1) + struct.pack(">I", 4) + struct.pack(">12d", *(v for p in ((0, 0, 7), (2, 0, 7), (2, 2, 7), (0, 0, 7)) for v in p))
    assert geo.polygons_of(raw)[0][0].tolist() == [[0, 0], [2, 0], [2, 2], [0, 0]]


def test_a_cell_of_many_pairs_is_cut(spark, monkeypatch):
    """Few rows, many pairs: more tasks than the bytes ask for, and each pair once."""
    monkeypatch.setattr(geo, "_CHUNK", 16)
    monkeypatch.setattr(geo, "_PAIRS", 4_000)
    r = np.random.default_rng(4)
    p, s = ([(i, i % 2, *map(float, r.random(2) * 30)) for i in range(n)] for n in (150, 400))
    points, sites = spark.createDataFrame(p, "point_id long, k long, x double, y double"), spark.createDataFrame(s, "site_id long, k long, sx double, sy double")
    found = geo.within(points, sites, 10.0, ["k"])
    want = sorted((a[0], b[0]) for a in p for b in s if a[1] == b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 10)
    assert sorted((x.point_id, x.site_id) for x in found.collect()) == want and len(want) > 5_000
    assert set(found.columns) == {"k", "point_id", "x", "y", "site_id", "sx", "sy", "distance"}
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 5 and max(x["count"] for x in sizes) < len(want) / 2
    assert geo.within(points.limit(0), sites, 10.0, ["k"]).count() == 0
