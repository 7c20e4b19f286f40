"""Components over blocks, outlines, merging sieve, touching cells, linkage of many units, ranks in parts, resumed batches."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreflow.operators import geo, segment, selection, stars, weights, zones
from acreflow.plans import batch
from acreflow.sources import tables


def flood(cells, kind=None):
    """Of each cell the least (x, y) of its 4-neighbour component."""
    kind, left, out = kind or {}, set(cells), {}
    while left:
        start = left.pop()
        group, edge = [start], [start]
        while edge:
            x, y = edge.pop()
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left and kind.get(n) == kind.get((x, y)):
                    left.remove(n)
                    group.append(n)
                    edge.append(n)
        out |= dict.fromkeys(group, min(group))
    return out


def raster(spark, masks, kinds=None):
    rows = [(c, 2000, int(x), int(y), 1.0, int(kinds[c][x, y]) if kinds else 0) for c, m in masks.items() for x, y in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "county_id int, yr int, cx int, cy int, w double, class int")


@pytest.mark.parametrize("block", [1, 3, 7, 16, 1000])
def test_blocks_change_nothing(spark, block):
    r = np.random.default_rng(block)
    spiral = np.ones((21, 21), bool)
    for i in range(1, 20, 2):  # one long winding component
        spiral[i, (0 if i % 4 == 1 else 1) : (20 if i % 4 == 1 else 21)] = False
    masks = {1: r.random((23, 31)) < 0.6, 2: spiral, 3: np.zeros((3, 3), bool), 4: np.ones((9, 14), bool)}
    got = segment.components(raster(spark, masks), 40, block)
    assert got.columns == ["county_id", "yr", "cx", "cy", "w", "class", "patch"]
    rows = got.collect()
    assert len(rows) == sum(int(m.sum()) for m in masks.values())
    for c, m in masks.items():
        want = flood([(int(x), int(y)) for x, y in zip(*np.nonzero(m), strict=True)])
        assert {(x.cx, x.cy): x.patch for x in rows if x.county_id == c} == {k: a * 40 + b for k, (a, b) in want.items()}
    own = segment.components(raster(spark, masks), None, block).collect()
    assert len({(x.county_id, x.patch) for x in own}) == len({(x.county_id, x.patch) for x in rows})


@pytest.mark.parametrize("block", [4, 1000])
def test_components_of_one_kind(spark, block):
    r = np.random.default_rng(9)
    masks, kinds = {1: r.random((14, 17)) < 0.9}, {1: r.integers(0, 3, (14, 17))}
    cells = [(int(x), int(y)) for x, y in zip(*np.nonzero(masks[1]), strict=True)]
    want = flood(cells, {c: int(kinds[1][c]) for c in cells})
    got = segment.components(raster(spark, masks, kinds), 20, block, "class").collect()
    assert {(x.cx, x.cy): x.patch for x in got} == {k: a * 20 + b for k, (a, b) in want.items()}


def test_components_refuse_what_they_cannot_name(spark):
    one = raster(spark, {1: np.ones((2, 9), bool)})
    with pytest.raises(ValueError, match="width 8"):
        segment.components(one, 8)
    with pytest.raises(ValueError, match="from 0"):
        segment.components(one.withColumn("cx", F.col("cx") - 1))
    assert segment.components(one.limit(0)).count() == 0


def test_a_block_is_the_largest_group(spark):
    plan = segment.components(raster(spark, {1: np.ones((9, 9), bool)}), 10, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan  # labelled already, block by block


def test_stars_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95)]
    got = stars.components(spark.createDataFrame(edges, "u long, v long"))
    assert {(x.u, x.root) for x in got.collect()} == {(i, 0) for i in range(1, 61)} | {(95, 90), (100, 90)}


@pytest.mark.parametrize("seed", range(3))
def test_outlines_and_cells_are_inverse(spark, seed):
    r = np.random.default_rng(seed)
    masks = {c: r.random((12, 15)) < p for c, p in ((1, 0.4), (2, 0.6), (3, 0.85), (4, 1.0))}
    cells = raster(spark, masks)
    got = segment.outlines(cells.union(cells), ["county_id"], -500.0, 900.0, 10.0)  # repeated cells are one
    assert got.columns == ["county_id", "n_rings", "geom"]
    back = geo.polygon_cells(got, ["county_id"], -500.0, 900.0, 10.0, 30, 30).collect()
    assert {(x.county_id, x.col, x.row) for x in back} == {(c, int(x), int(y)) for c, m in masks.items() for x, y in zip(*np.nonzero(m), strict=True)}
    for row in got.collect():
        polygons = geo.polygons_of(row.geom)
        assert sum(len(p) for p in polygons) == row.n_rings
        labels = flood([(int(x), int(y)) for x, y in zip(*np.nonzero(masks[row.county_id]), strict=True)])
        assert len(polygons) == len(set(labels.values()))  # a polygon for each part
        area = 0.0
        for p in polygons:
            for i, ring in enumerate(p):
                assert (ring[0] == ring[-1]).all() and len({tuple(v) for v in ring[:-1].tolist()}) == len(ring) - 1  # simple
                turn = segment._area(ring)
                assert (turn > 0) == (i == 0)  # shells against the clock, holes with it
                area += turn
        assert area == 100 * masks[row.county_id].sum()
    area, border = geo.measures(F.col("geom"))
    assert {(x.county_id, x.a) for x in got.select("county_id", area.alias("a")).collect()} == {(c, 100.0 * m.sum()) for c, m in masks.items()}
    assert segment.outlines(cells.limit(0), ["county_id"]).count() == 0


def merged(kinds, least):
    """Regions, joined by the same rules one after the other."""
    cells = list(kinds)
    label = flood(cells, kinds)
    size = {}
    for v in label.values():
        size[v] = size.get(v, 0) + 1
    near = {}
    for x, y in cells:
        for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if n in label and label[n] != label[x, y]:
                near.setdefault(label[x, y], set()).add(label[n])
    best = {a: min(b, key=lambda v: (-size[v], v)) for a, b in near.items()}
    into = {}
    for a in size:
        if size[a] >= least:
            continue
        at, seen = best.get(a), {a}
        while at is not None and size[at] < least and at not in seen:
            seen.add(at)
            at = best.get(at)
        if at is not None and size[at] >= least:
            into[a] = at
    return {c: into.get(v, v) for c, v in label.items()}


@pytest.mark.parametrize("least", [1, 3, 6, 1000])
def test_small_regions_join_their_largest_neighbour(spark, least):
    r = np.random.default_rng(least)
    masks = {1: r.random((13, 16)) < 0.85, 2: r.random((13, 16)) < 0.5}
    kinds = {c: r.integers(0, 3, m.shape) for c, m in masks.items()}
    labelled = segment.components(raster(spark, masks, kinds), 20, by="class")
    got = segment.sieve_into(labelled, "class", least)
    assert got.columns == labelled.columns
    rows = got.collect()
    for c, m in masks.items():
        own = {(int(x), int(y)): int(kinds[c][x, y]) for x, y in zip(*np.nonzero(m), strict=True)}
        want = merged(own, least)
        assert {(x.cx, x.cy): (x.patch, x["class"]) for x in rows if x.county_id == c} == {k: (a * 20 + b, own[a, b]) for k, (a, b) in want.items()}


def test_touching_cells(spark):
    cells = raster(spark, {1: np.ones((6, 6), bool)}).withColumn("w", (F.col("cx") + 1.0) * F.when(F.col("cy") == 5, float("nan")).otherwise(1.0))
    members = spark.createDataFrame([(1, 2000, 1, 1), (1, 2000, 1, 2), (1, 2000, 1, 1), (1, 2000, 0, 4)], "county_id int, yr int, cx int, cy int")
    took = lambda how: {(x.cx, x.cy): x.w_cap for x in selection.capped_surface(cells, members, "w", how).collect()}
    own = {(1, 1), (1, 2), (0, 4)}
    sides = {(x + i, y + j) for x, y in own for i, j in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))}
    corners = {(x + i, y + j) for x, y in own for i in (-1, 0, 1) for j in (-1, 0, 1)}
    for how, want in (("none", own), ("sides", sides), ("corners", corners)):
        want = {(x, y) for x, y in want if 0 <= x < 6 and 0 <= y < 5}
        got = took(how)
        total = sum(x + 1.0 for x, _ in want)
        assert got == pytest.approx({(x, y): (x + 1.0) / total for x, y in want})
    with pytest.raises(ValueError):
        selection.capped_surface(cells, members, touching="all")
    assert selection.capped_surface(cells, members.limit(0)).count() == 0


def test_zones_of_a_split_county(spark):
    """Far villages, near ones, ties; numbered as if nothing were split."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.random(60) * 900, 5000 + r.integers(0, 6, 40) * 100.0, 5900 + r.random(30) * 300, [90_000.0, -40_000.0]])
    y = np.concatenate([r.random(60) * 900, r.integers(0, 6, 40) * 100.0, r.random(30) * 300, [-7.0, 3.0]])
    order = r.permutation(len(x))
    rows = [(c, 2000, f"u{i:03}", n, float(x[i]) + c, float(y[i])) for c in (1, 2) for n, i in enumerate(order.tolist())]
    units = spark.createDataFrame(rows, "county_id int, yr int, unit_id string, rn int, x double, y double")
    for height in (150.0, 400.0):
        whole, split = (zones.zoned(units, height, split=s) for s in (False, True))
        assert whole.columns == split.columns
        assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in split.collect()}
    parts = zones._parts(units, 400.0, "x", "y", zones.KEYS)
    assert parts.select("county_id", "_part").distinct().count() >= 8


def test_linkage_of_fifty_thousand_units():
    r = np.random.default_rng(1)
    x, y = r.random(50_000) * 60_000, r.random(50_000) * 60_000
    began = time.perf_counter()
    zone = zones.complete_linkage(x, y, 10_000.0)
    assert time.perf_counter() - began < 60
    for z in np.unique(zone)[::10]:
        at = np.flatnonzero(zone == z)
        hull = np.array(zones._hull(x, y, at.tolist()))
        assert np.hypot(x[hull][:, None] - x[hull], y[hull][:, None] - y[hull]).max() <= 10_000.0


@pytest.mark.parametrize("large", [0, 40, 1 << 14])
def test_ranks_in_parts(spark, monkeypatch, large):
    monkeypatch.setattr(weights, "LARGE", large)
    r = np.random.default_rng(large)
    data = {1: r.random(3000), 2: r.integers(0, 30, 2000) / 7.0, 3: np.exp(r.normal(size=2500) * 20), 4: np.array([2.5]), 5: np.array([1.0, 1.0, 1.0])}
    df = spark.createDataFrame([(k, 2000, float(v)) for k, x in data.items() for v in x], "county_id int, yr int, v double")
    counts = weights._counts(df, "v")
    got = {(x.county_id, x._p): x.q for x in weights.quantiles(counts, 0, 1000, 25).collect()}
    assert len(got) == 5 * 41
    for (k, p), q in got.items():
        assert q == pytest.approx(np.quantile(data[k], p / 1000), rel=1e-12, abs=1e-9)
    asked = [(k, float(t)) for k, x in data.items() for t in (*np.quantile(x, [0.1, 0.5, 0.77]), x.min() - 1, x.max() + 1, x[0])]
    thresholds = spark.createDataFrame([(k, 2000, t, i) for i, (k, t) in enumerate(asked)], "county_id int, yr int, _v double, i int")
    above = {x.i: x._above for x in weights._reaching(counts, thresholds, weights._parted(counts)).collect()}
    assert above == {i: int((data[k] >= t).sum()) for i, (k, t) in enumerate(asked)}


def test_no_window_sorts_a_large_group(spark, monkeypatch):
    """The rows of a part are a fraction of the group's."""
    monkeypatch.setattr(weights, "LARGE", 100)
    df = spark.createDataFrame([(1, 2000, float(i)) for i in range(20_000)], "county_id int, yr int, v double")
    counts = weights._counts(df, "v")
    parts = weights._in_parts(counts, weights._parted(counts)).groupBy("_k").count().collect()
    assert len(parts) > 40 and max(x["count"] for x in parts) < 20_000 / 20


def run_batch(spark, path, stats, **options):
    pixels = spark.createDataFrame([(c, y, x, z, 0.2 + (x * 7 + z * 3 + c) % 11 / 20, 0.1 + (x * 5 + z) % 7 / 10, int((x + z) % 5 > 0)) for c in (1, 2, 3) for y in (2000, 2001) for x in range(12) for z in range(12)], "county_id long, yr int, cx int, cy int, ndvi double, et double, cdl int")
    return pixels, batch.resume_weights(pixels, stats, path, "cotton", options=batch.WeightOptions(first=1999, **options))


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_is_taken_up_where_it_ended(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [(c, y, 60, 800) for c in (1, 2, 3) for y in (2000, 2001)]
    stats = spark.createDataFrame([*rows, (9, 2000, 5, 5)], "county_id long, yr int, harvested_cells long, yield_kg_ha long")
    assert batch.read_weights(spark, path, "cotton") is None and batch.finished(spark, path, "cotton").count() == 0
    pixels, skips = run_batch(spark, path, stats.where("county_id < 3"))
    assert {(r.county_id, r.reason) for r in skips.collect()} == {(3, "no statistics")}
    first = files(path)
    _, skips = run_batch(spark, path, stats)
    assert {(r.county_id, r.reason) for r in skips.collect()} == {(1, "already cached"), (2, "already cached"), (9, "no raster")}
    after = files(path)
    assert {k: v for k, v in after.items() if k in first} == first and len(after) == len(first) + 4
    whole = {tuple(r) for r in batch.read_weights(spark, path, "cotton").select("county_id", "yr", "cx", "cy", F.round("w_norm", 12)).collect()}
    direct = batch.weights_batch(pixels, stats, batch.WeightOptions(first=1999))["weights"]
    assert whole == {tuple(r) for r in direct.select("county_id", "yr", "cx", "cy", F.round("w_norm", 12)).collect()}
    # A second run computes nothing.
    assert {r.reason for r in run_batch(spark, path, stats)[1].collect()} == {"already cached", "no raster"} and files(path) == after
    # One deleted county and year is computed alone; so is one whose mark is lost, over what was there.
    for lost in ("weights", "finished"):
        part = next((tmp_path / "cache" / lost).rglob("yr=2001/county_id=2"))
        for f in list(part.iterdir()):
            f.unlink()
        part.rmdir()
        assert batch.finished(spark, path, "cotton").count() == 5
        run_batch(spark, path, stats)
        now = files(path)
        changed = {os.path.dirname(k) for k, _ in set(now.items()) ^ set(after.items())}
        assert changed and all(c.endswith("yr=2001/county_id=2") for c in changed)
        assert {tuple(r) for r in batch.read_weights(spark, path, "cotton").select("county_id", "yr", "cx", "cy", F.round("w_norm", 12)).collect()} == whole
        after = now


def test_tables_of_a_step_go_with_it(spark):
    with tables.released() as keep:
        a = tables.settled(spark.range(3))
        with tables.released() as inner:
            b, c = inner(spark.range(4)), tables.settled(spark.range(5))
        kept = keep(b)
        d = keep(spark.range(6))
    there = lambda t: os.path.exists(t._settled_at.removeprefix("file:"))
    assert (there(a), there(c), there(kept), there(d)) == (False, False, True, True) and kept.count() == 4
    tables.dropped(kept, d, d)
    assert not there(kept)


def test_weights_without_an_eligible_cell_are_resumed(spark, tmp_path):
    """Equal signals: nothing lies above the screen, so the first run stores no row; a later one adds to it."""
    rows = lambda year, signal: [(1, year, x, 0, signal(x), signal(x), 1) for x in range(10)]
    schema = "county_id long, yr int, cx int, cy int, ndvi double, et double, cdl int"
    stats = lambda *years: spark.createDataFrame([(1, y, 10, 700) for y in years], "county_id long, yr int, harvested_cells long, yield_kg_ha long")
    path, options = str(tmp_path / "cache"), batch.WeightOptions(first=1999)
    flat = rows(2000, lambda x: 0.5)
    for _ in range(2):
        batch.resume_weights(spark.createDataFrame(flat, schema), stats(2000), path, "cotton", options=options)
        assert batch.read_weights(spark, path, "cotton") is None
        assert [tuple(r) for r in batch.finished(spark, path, "cotton").collect()] == [(1, 2000, 0)]
    both = spark.createDataFrame(flat + rows(2001, lambda x: x / 10), schema)
    batch.resume_weights(both, stats(2000, 2001), path, "cotton", options=options)
    assert {r.yr for r in batch.read_weights(spark, path, "cotton").collect()} == {2001}
