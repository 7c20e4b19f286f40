"""Golden micro-cases and properties of the operators."""

import os
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acreflow.operators import allocate, composite, cropmask, geo, segment, selection, weights, zones
from acreflow.plans import batch
from acreflow.schemas import require_columns
from acreflow.sources import geotiff, tables


def units(spark, rows, target):
    data = [(1, 2000, f"u{i}", a, w, target) for i, (a, w) in enumerate(rows)]
    return spark.createDataFrame(data, "county_id int, yr int, unit_id string, area_cells long, w_sum double, harvested_cells long")


@pytest.mark.parametrize(
    ("areas", "target", "kept"),
    [([(10, 3), (10, 2), (10, 1)], 30, 2), ([(50, 2), (10, 1)], 20, 1), ([(10, 1)], 5, 1), ([(10, 3), (10, 2), (10, 1)], 25, 2), ([(10, 3), (10, 2), (10, 1)], 500, 2)],
)
def test_harvest_prefix(spark, areas, target, kept):
    got = selection.harvest_prefix(units(spark, [(a, float(w)) for a, w in areas], target))
    assert got.count() == kept


@pytest.mark.parametrize(("shares", "kept"), [((0.6, 0.36, 0.04), 2), ((0.97, 0.03), 2), ((1.0,), 1), ((0.5, 0.3, 0.1, 0.05, 0.05), 4)])
def test_prune(spark, shares, kept):
    rows = selection.prune(units(spark, [(1, s) for s in shares], 1)).collect()
    assert len(rows) == kept and sum(r.w_share for r in rows) == pytest.approx(1)
    if kept == 2 and shares[0] == 0.6:
        assert sorted(r.w_share for r in rows) == pytest.approx([0.375, 0.625])


def allocated(spark, w, y, caps, area=None, beta=1.0, **options):
    area = area or [1.0] * len(w)
    rows = [(1, 2000, beta, f"u{i}", a, x, 10.0, y, *caps) for i, (x, a) in enumerate(zip(w, area, strict=True))]
    df = spark.createDataFrame(rows, "county_id int, yr int, beta double, unit_id string, area_ha double, w_share double, county_area_ha double, county_yield double, y_min double, y_max double, min_abs double")
    return allocate.allocate(df, **options)


def test_clamp_then_recentre(spark):
    got = [r.yield_kg_ha for r in allocated(spark, [0.2, 0.8], 1000.0, (500.0, 1500.0, 0.0)).orderBy("unit_id").collect()]
    assert got == pytest.approx([500, 1500])


def test_the_mean_may_deviate(spark):
    t = allocated(spark, [0.2, 0.8], 1000.0, (500.0, 1200.0, 0.0))
    assert [r.yield_kg_ha for r in t.orderBy("unit_id").collect()] == pytest.approx([588.2353, 1200], abs=1e-4)
    check = allocate.check(t).first()
    assert check.area_weighted_mean_yield == pytest.approx(894.1176, abs=1e-4) and check.nass_deviation_pct == pytest.approx(-10.5882, abs=1e-4)
    assert check.units_total_area_scaled_ha == pytest.approx(10)


def test_floor_gives_way_and_beta_zero_is_even(spark):
    assert {r.yield_kg_ha for r in allocated(spark, [0.2, 0.8], 1000.0, (100.0, 800.0, 900.0)).collect()} == {800.0}
    assert {r.yield_kg_ha for r in allocated(spark, [0.1, 0.2, 0.7], 1000.0, (1.0, 9e9, 0.0), beta=0.0).collect()} == {1000.0}


def test_yields_rise_with_weight_within_bounds(spark):
    r = np.random.default_rng(0)
    w = sorted(r.random(40).tolist())
    rows = allocated(spark, w, 900.0, (100.0, 4000.0, 80.0), area=r.random(40).tolist(), beta=1.6, min_frac=0.3, max_frac=2.5).collect()
    y = [x.yield_kg_ha for x in sorted(rows, key=lambda x: x.w_share)]
    assert y == sorted(y) and min(y) >= 270 - 1e-9 and max(y) <= 2250 + 1e-9
    assert sum(x.area_ha_scaled for x in rows) == pytest.approx(10)


def test_caps(spark):
    df = spark.createDataFrame([("Upland Cotton",), ("MAIZE",), ("rye",), (None,)], "crop string")
    got = {r.crop: (r.y_min, r.y_max, r.min_abs) for r in allocate.with_caps(df, F.col("crop")).collect()}
    assert got == {"Upland Cotton": (100, 4000, 80), "MAIZE": (700, 16000, 600), "rye": (100, 10000, 50), None: (100, 10000, 50)}


def flood(cells):
    left, out = set(cells), {}
    while left:
        group, edge = [], [left.pop()]
        while edge:
            x, y = edge.pop()
            group.append((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.remove(n)
                    edge.append(n)
        out |= {c: min(x * 50 + y for x, y in group) for c in group}
    return out


@pytest.mark.parametrize("share", [0.2, 0.5, 0.62, 0.9])
def test_components_equal_a_flood_fill(share):
    r = np.random.default_rng(3)
    x, y = np.nonzero(r.random((40, 50)) < share)
    labels = segment.label_components(x, y, 50)
    want = flood(list(zip(x.tolist(), y.tolist(), strict=True)))
    assert [want[c] for c in zip(x.tolist(), y.tolist(), strict=True)] == labels.tolist()
    assert segment.label_components(np.array([], int), np.array([], int), 50).tolist() == []


def grid(spark, width, height, weight=1.0, skip=()):
    rows = [(1, 2000, x, y, weight) for x in range(width) for y in range(height) if (x, y) not in skip]
    return spark.createDataFrame(rows, "county_id int, yr int, cx int, cy int, w double")


def test_tiles_drop_the_partial_strip(spark):
    labelled = segment.components(grid(spark, 7, 5), 50)
    full = segment.tile_units(segment.tiles(labelled, 10, 3)).orderBy("unit_id").collect()
    assert [(r.unit_id, r.tile_i, r.tile_j, r.area_cells) for r in full] == [("0_1", 0, 0, 9), ("0_2", 1, 0, 9)]
    assert segment.tile_units(segment.tiles(labelled, 10, 3, partial=True)).agg(F.sum("area_cells")).first()[0] == 35
    assert segment.tile_units(segment.tiles(labelled, 10, 3, touches=True)).agg(F.sum("area_cells")).first()[0] > 18
    assert segment.tiles(labelled, 40, 3).count() == 0


def test_sieve_and_membership(spark):
    support = grid(spark, 6, 6, skip={(2, y) for y in range(6)} | {(x, 2) for x in range(6)})
    parts = segment.segmented(support, 50, least_patch=5, most_field=6, side=2, least_unit=2, most_unit=100)
    assert {r.patch for r in parts["fields"].collect()} == {3 * 50 + 3, 3 * 50, 3} and parts["units"].count() > 0
    members = segment.membership(parts["labelled"], parts["tiles"], parts["pseudo_units"]).join(parts["units"].select("unit_id", "area_cells"), "unit_id")
    assert all(r["count"] == r.n for r in members.groupBy("unit_id").agg(F.count("*").alias("count"), F.first("area_cells").alias("n")).collect())


def greedy_linkage(x, y, h):
    groups = [[i] for i in range(len(x))]
    far = lambda a, b: max(np.hypot(x[i] - x[j], y[i] - y[j]) for i in a for j in b)
    while len(groups) > 1:
        d, i, j = min((far(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > h:
            break
        groups[i] += groups.pop(j)
    ids = {k: min(g) for g in groups for k in g}
    order = {m: n for n, m in enumerate(sorted(set(ids.values())), 1)}
    return [order[ids[i]] for i in range(len(x))]


@pytest.mark.parametrize("h", [0.0, 5.0, 20.0, 200.0])
def test_complete_linkage_equals_the_greedy_order(h):
    r = np.random.default_rng(8)
    x, y = r.random(60) * 100, r.random(60) * 100
    got = zones.complete_linkage(x, y, h)
    assert got.tolist() == greedy_linkage(x, y, h)
    for z in set(got.tolist()):
        at = np.flatnonzero(got == z)
        assert np.hypot(x[at][:, None] - x[at], y[at][:, None] - y[at]).max() <= h
    assert zones.complete_linkage(x[:1], y[:1], h).tolist() == [1]
    assert set(zones.complete_linkage(np.zeros(3_000), np.zeros(3_000), h)) == {1}


@pytest.mark.parametrize("h", [0.0, 1.0, 3.0, 8.0, 40.0, 500.0])
def test_linkage_with_ties(h):
    """On whole coordinates many distances are equal, and units coincide."""
    r = np.random.default_rng(9)
    x, y = np.round(r.random(90) * 12), np.round(r.random(90) * 12)
    assert zones.complete_linkage(x, y, h).tolist() == greedy_linkage(x, y, h)


def test_linkage_of_many_units():
    r = np.random.default_rng(10)
    x, y = r.random(12_000) * 3e5, r.random(12_000) * 3e5
    zone = zones.complete_linkage(x, y, 10_000.0)
    _, first = np.unique(zone, return_index=True)
    assert (np.diff(first) > 0).all()
    for z in np.unique(zone)[:50]:
        at = np.flatnonzero(zone == z)
        assert np.hypot(x[at][:, None] - x[at], y[at][:, None] - y[at]).max() <= 10_000.0


@pytest.mark.parametrize("width, height", [(7, 60), (60, 7), (30, 30)])
def test_components_of_any_raster(spark, width, height):
    r = np.random.default_rng(width)
    cells = [(int(x), int(y)) for x in range(width) for y in range(height) if r.random() < 0.55]
    df = spark.createDataFrame([(1, 2000, x, y, 1.0) for x, y in cells], "county_id int, yr int, cx int, cy int, w double")
    groups = {}
    for c in segment.components(df).collect():
        groups.setdefault(c.patch, set()).add((c.cx, c.cy))
    want = {}
    for c, label in flood(cells).items():
        want.setdefault(label, set()).add(c)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}
    with pytest.raises(ValueError):
        segment.label_components(np.array([0, 1]), np.array([24, 0]), 24)


def test_fields_need_a_finite_weight(spark):
    rows = [(1, 2000, 1, float("inf")), (1, 2000, 2, float("nan")), (1, 2000, 3, 1.5), (1, 2000, 4, None)]
    df = spark.createDataFrame(rows, "county_id int, yr int, patch long, w double")
    assert [r.patch for r in segment.fields(df).collect()] == [3]


def test_quantiles_equal_numpys(spark):
    r = np.random.default_rng(3)
    data = {1: r.integers(0, 9, 50) / 4.0, 2: r.random(101), 3: np.array([2.5]), 4: np.array([1.0, 1.0, 1.0]), 5: np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, 2000, float(v)) for k, x in data.items() for v in x] + [(1, 2000, None), (6, 2000, None)], "county_id int, yr int, v double")
    for low, high, step in ((0, 1000, 25), (50, 50, 1), (100, 900, 10)):
        got = weights.quantiles(weights._counts(df, "v"), low, high, step).collect()
        assert len(got) == len(data) * len(range(low, high + 1, step))
        assert all(abs(x.q - np.quantile(data[x.county_id], x["_p"] / 1000)) < 1e-9 for x in got)


def test_no_window_holds_a_field(spark):
    support = grid(spark, 5, 5)
    parts = segment.segmented(support, least_patch=2, most_field=4, side=2, least_unit=1, most_unit=50)
    for name in ("labelled", "tiles"):
        assert "Window" not in parts[name]._jdf.queryExecution().optimizedPlan().toString()


def square(x, y, size):
    ring = ((x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y))
    return struct.pack("<II", 1, 5)[4:] + b"".join(struct.pack("<2d", *p) for p in ring)


def test_polygons_become_cells(spark):
    hole = struct.pack("<BII", 1, 3, 2) + square(1.0, 1.0, 6.0) + square(3.0, 3.0, 2.0)
    two = struct.pack("<BII", 1, 6, 2) + (struct.pack("<BII", 1, 3, 1) + square(0.2, 0.2, 0.5)) + (struct.pack("<BII", 1, 3, 1) + square(5.6, 5.6, 9.0))
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 5) + struct.pack(">10d", 2.0, 2.0, 4.0, 2.0, 4.0, 4.0, 2.0, 4.0, 2.0, 2.0)
    df = spark.createDataFrame([(1, hole), (2, two), (3, None), (4, big)], "k int, geom binary")
    cells = lambda touches: {(r.k, r.row, r.col) for r in geo.polygon_cells(df, ["k"], 0.0, 8.0, 1.0, 8, 8, touches).collect()}
    inside = {(1, 7 - y, x) for x in range(1, 7) for y in range(1, 7) if not (3 <= x < 5 and 3 <= y < 5)} | {(2, 7, 0)} | {(2, 7 - y, x) for x in (6, 7) for y in (6, 7)} | {(4, 7 - y, x) for x in (2, 3) for y in (2, 3)}
    assert cells(False) == inside
    touching = cells(True)
    assert inside < touching and {(2, 7 - 5, 5), (2, 7 - 5, 7), (2, 7 - 7, 5)} <= touching
    with pytest.raises(ValueError):
        geo.rings_of(struct.pack("<BI2d", 1, 1, 0.0, 0.0))


def lzw(data):
    """Codes of single bytes, cleared before they get longer."""
    bits = "".join(f"{c:09b}" for i in range(0, len(data), 200) for c in (256, *data[i : i + 200])) + f"{257:09b}"
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def tiff(values, compression, predictor=1, order="<"):
    """A raster in tiles of 16 x 16."""
    h, w = values.shape
    blocks = []
    for r in range(0, h, 16):
        for c in range(0, w, 16):
            tile = np.zeros((16, 16), values.dtype)
            part = values[r : r + 16, c : c + 16]
            tile[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                tile[:, 1:] -= tile[:, :-1].copy()
            raw = tile.astype(values.dtype.newbyteorder(order)).tobytes()
            blocks.append({1: raw, 5: lzw(raw), 8: zlib.compress(raw)}[compression])
    at = 8 + sum(map(len, blocks))
    offsets = np.cumsum([8, *map(len, blocks)])[:-1].tolist()
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [values.dtype.itemsize * 8]), (259, 3, [compression]), (317, 3, [predictor]), (322, 4, [16]), (323, 4, [16]), (324, 4, offsets), (325, 4, list(map(len, blocks))), (339, 3, [{"u": 1, "i": 2, "f": 3}[values.dtype.kind]])]
    head, extra = struct.pack(order + "H", len(tags)), b""
    for tag, kind, held in tags:
        raw = struct.pack(order + ("H" if kind == 3 else "I") * len(held), *held)
        if len(raw) > 4:
            raw, extra = struct.pack(order + "I", at + 6 + 12 * len(tags) + len(extra)), extra + raw
        head += struct.pack(order + "HHI", tag, kind, len(held)) + raw.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + b"".join(blocks) + head + b"\0" * 4 + extra


@pytest.mark.parametrize("compression, predictor, order", [(1, 1, "<"), (5, 1, "<"), (8, 2, "<"), (5, 2, ">"), (1, 2, ">")])
def test_rasters_of_other_writers(compression, predictor, order):
    r = np.random.default_rng(compression)
    for kind in ("u1", "i2", "u4"):
        values = r.integers(0, 100, (37, 20)).astype(kind)
        assert (geotiff.read(tiff(values, compression, predictor, order)).values == values).all()


def test_rasters_round_trip(spark, tmp_path):
    values = np.arange(150 * 33, dtype=np.float32).reshape(150, 33)
    values[3, 4] = np.nan
    (tmp_path / "a.tif").write_bytes(geotiff.write(geotiff.Raster(values, -1000.5, 2000.0, 30.0, epsg=5070)))
    back = geotiff.read((tmp_path / "a.tif").read_bytes())
    assert np.array_equal(back.values, values, equal_nan=True) and (back.x_min, back.y_max, back.res, back.epsg) == (-1000.5, 2000.0, 30.0, 5070)
    got = {(r.row, r.col): r.value for r in tables.decode_tiffs(spark, str(tmp_path / "a.tif"), geotiff.pixels, geotiff.PIXELS).collect()}
    assert got == {(i, j): float(values[i, j]) for i in range(150) for j in range(33) if (i, j) != (3, 4)}
    with pytest.raises(ValueError):
        geotiff.read(b"no raster at all")


def test_settled_tables_are_dropped(spark):
    out = tables.settled(spark.range(5))
    path = out._settled_at
    assert out.count() == 5
    tables.dropped(out)
    assert not os.path.exists(path.removeprefix("file:"))


def zone_rows(spark, rows):
    data = [(1, 2000, 1.0, i, x, 0.0, a, a * y, n, y, 100.0) for i, (x, a, y, n) in enumerate(rows)]
    return spark.createDataFrame(data, "county_id int, yr int, beta double, cluster_id long, x double, y double, cluster_area_ha double, cluster_prod_kg double, n_units long, cluster_yield_kg_ha double, floor double")


def test_floor_merge(spark):
    z = zone_rows(spark, [(0.0, 10.0, 100.0, 2), (1.0, 5.0, 100.0, 3), (5.0, 20.0, 500.0, 4)])
    got = {r.cluster_id: r for r in zones.merged_floors(z).collect()}
    assert set(got) == {0, 2} and got[2].cluster_area_ha == 25 and got[2].cluster_yield_kg_ha == pytest.approx(10500 / 25)
    assert (got[2].n_units, got[2].n_units_merged, got[0].n_units_merged) == (4, 7, 2)
    assert zones.floor_assignments(z).first().distance == 4.0


def test_floor_merge_without_others(spark):
    z = zone_rows(spark, [(0.0, 10.0, 100.0, 1), (1.0, 5.0, 90.0, 1), (2.0, 5.0, 80.0, 1)])
    moves = {r.cluster_id: r.target_id for r in zones.floor_assignments(z).collect()}
    assert moves == {1: 0, 2: 0}
    assert zones.merged_floors(z).agg(F.sum("cluster_prod_kg")).first()[0] == pytest.approx(z.agg(F.sum("cluster_prod_kg")).first()[0])
    assert zones.merged_floors(zone_rows(spark, [(0.0, 1.0, 50.0, 1)])).count() == 1


def test_mask_strategies(spark):
    cells = {2010: [(0, 0), (0, 1)], 2011: [(0, 0), (1, 1)], 2012: [(0, 0), (0, 1), (2, 2)], 2008: [(5, 5)], 2009: [(5, 5), (6, 6)]}
    classes = spark.createDataFrame([(1, y, a, b, 1) for y, at in cells.items() for a, b in at] + [(1, 2013, 9, 9, 2)], "county_id int, yr int, cx int, cy int, cdl int")
    cases = [(2011, 4.0, "union_2010_2011_2012", 4), (2011, 1.0, "intersect_2010_2011_2012", 1), (2011, 2.0, "exact_2011", 2), (2011, 2 / 0.6, "exact_2011", 2), (2011, None, "exact_2011", 2), (2005, 1.0, "union_2008_2009_2010", 4), (2020, 1.0, "failed_to_build_mask", None), (2014, 1.0, "union_2013_2014_2015", 0)]
    for year, planted, label, area in cases:
        target = spark.createDataFrame([(1, year, planted)], "county_id int, yr int, planted_cells double")
        chosen, decisions = cropmask.masks(target, classes, 1)
        d = decisions.first()
        assert (d.strategy, d.mask_cells) == (label, area), (year, planted)
        assert chosen.where("chosen").count() == (area or 0)


def test_eligibility_edges(spark):
    cells = spark.createDataFrame([(1, 2000, i, 0, i / 10) for i in range(11)], "county_id int, yr int, cx int, cy int, ndvi double")
    harvest = lambda h: spark.createDataFrame([(1, 2000, h)], "county_id int, yr int, harvested_cells double")
    pick = lambda h, **k: tuple(weights.eligibility(cells, harvest(h), **k).first())[2:]
    assert pick(2.0) == (0.9, 0.9, 2) and pick(3.0) == (0.8, 0.8, 3) and pick(99.0) == (0.1, 0.1, 10)
    assert pick(2.0, buffer=0.5) == (0.8, 0.8, 3)
    assert pick(None) == (0.5, 0.5, 6) and pick(0.0) == (0.5, 0.5, 6)
    assert weights.eligible(cells, weights.eligibility(cells, harvest(3.0))).count() == 3


def test_surface_sums_to_one_and_survives_a_missing_signal(spark):
    cells = grid(spark, 4, 4).select("county_id", "yr", "cx", "cy", (F.col("cx") / 4).alias("ndvi"), (F.col("cy") * 1.0).alias("et"))
    assert weights.surface(cells).agg(F.sum("w_norm")).first()[0] == pytest.approx(1)
    only = weights.surface(cells.withColumn("ndvi", F.lit(None).cast("double")))
    assert only.count() == 16 and only.agg(F.sum("w_norm")).first()[0] == pytest.approx(1)
    alone = weights.surface(cells.withColumn("et", F.lit(None).cast("double")), ndvi_only=F.col("yr") <= 2000)
    assert alone.agg(F.sum("w_norm")).first()[0] == pytest.approx(1)


def test_composites(spark):
    rows = [(1, "2024-06-01", "LC08", 0, 9000.0, 20000.0, 30000.0), (1, "2024-06-02", "LE07", 0, 9000.0, 20000.0, 30000.0), (1, "2024-06-03", "LC09", 8, 1.0, 1.0, 1.0), (1, "2024-10-01", "LC08", 0, 1.0, 1.0, 1.0), (2, "2024-06-05", "XX", 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pixel int, ts string, sensor string, QA_PIXEL int, SR_B3 double, SR_B4 double, SR_B5 double").withColumn("ts", F.to_timestamp("ts"))
    found, scale = composite.ndvi_composite(df, "landsat", "2024-06-01", "2024-09-30", ["pixel"])
    rows = found.collect()
    assert scale == 30 and len(rows) == 1 and rows[0].n_obs == 2 and 0 <= rows[0].ndvi <= 1
    assert {r.pixel: r.ndvi for r in composite.on_grid(found, df, ["pixel"]).collect()}[2] == 0.0


def test_resampling(spark):
    source = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 1, 0, 5.0)], "k int, row int, col int, value double")
    target = spark.createDataFrame([(0, 1, 0.5, 0.5), (0, 2, 0.0, 0.0), (0, 3, 9.0, 9.0), (0, 4, 0.0, 0.25)], "k int, cell int, r double, c double")
    got = {r.cell: r.value for r in geo.bilinear(target, source, F.col("r"), F.col("c"), ["k"], ["cell"]).collect()}
    assert got == pytest.approx({1: 3.0, 2: 1.0, 4: 1.5})
    assert {r.cell: r.value for r in geo.nearest(target, source, F.col("r"), F.col("c"), ["k"]).collect()}[4] == 1.0


def test_batch_on_a_small_county(spark):
    pixels = spark.createDataFrame([(c, 2000, x, y, 0.2 + (x * 7 + y * 3) % 11 / 20, 0.1 + (x * 5 + y) % 7 / 10, (x + y) % 5 > 0) for c in (1, 2) for x in range(20) for y in range(20)], "county_id int, yr int, cx int, cy int, ndvi double, et double, c boolean").withColumn("cdl", F.col("c").cast("int")).drop("c")
    stats = spark.createDataFrame([(1, 2000, 150, 800), (2, 2000, 0, 800), (3, 2000, 9, 9)], "county_id int, yr int, harvested_cells long, yield_kg_ha long")
    out = batch.weights_batch(pixels, stats, batch.WeightOptions(first=1999))
    assert {(r.county_id, r.reason) for r in out["skipped"].collect()} == {(2, "no harvested area"), (3, "no raster")}
    w = out["weights"]
    assert {r.county_id: round(r.s, 9) for r in w.groupBy("county_id").agg(F.sum("w_norm").alias("s")).collect()} == {1: 1.0}
    o = batch.DisaggOptions(least_patch=2, most_field=10, side=3, least_unit=1, most_unit=500, cluster_dist_m=150.0, betas=(1.0, 1.4))
    run = batch.disagg_batch(w.select("county_id", "yr", "cx", "cy", F.col("w_norm").alias("w")), stats, o)
    check = run["check"].collect()
    assert len(check) == 2 and all(abs(r.units_total_area_scaled_ha - 150 * 0.09) < 1e-9 for r in check)
    merged, zone = run["merged"].toPandas(), run["zones"].toPandas()
    assert isinstance(merged, pd.DataFrame) and merged.cluster_prod_kg.sum() == pytest.approx(zone.cluster_prod_kg.sum())
    assert run["qa"].count() == 2


def test_required_columns(spark):
    with pytest.raises(ValueError, match="harvested_cells"):
        batch.weights_batch(grid(spark, 1, 1).withColumns({"ndvi": F.lit(1.0), "et": F.lit(1.0), "cdl": F.lit(1)}), grid(spark, 1, 1))
    assert require_columns(grid(spark, 1, 1), ["cx"]).count() == 1
