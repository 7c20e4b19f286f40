"""Raster files: codecs, the data source's blocks and pruning, its writer, and what a failed write leaves."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreflow.sources import geotiff, raster


def planes(values):
    """Predictor 3 as other writers have it: bytes by significance, then differences within a row."""
    rows = values.astype(">f" + str(values.dtype.itemsize)).view(np.uint8).reshape(*values.shape, -1).transpose(0, 2, 1).reshape(len(values), -1)
    return np.concatenate([rows[:, :1], rows[:, 1:] - rows[:, :-1]], axis=1).tobytes()


def other_tiff(values, compression, predictor=1, order="<", large=False, block=(16, 16), strips=False, nodata=None):
    """A raster as another writer might lay it out: classic or large, tiles or strips, padded tiles."""
    h, w = values.shape
    bh, bw = (block[0], w) if strips else block
    blocks = []
    for r in range(0, h, bh):
        for c in range(0, w, bw):
            part = values[r : r + bh, c : c + bw]
            tile = part if strips else np.zeros((bh, bw), values.dtype)
            if not strips:
                tile[: part.shape[0], : part.shape[1]] = part
            if predictor == 3:
                raw = planes(tile)
            else:
                if predictor == 2:
                    words = tile.view(f"u{tile.dtype.itemsize}")
                    tile = np.concatenate([words[:, :1], words[:, 1:] - words[:, :-1]], axis=1)
                raw = tile.astype(tile.dtype.newbyteorder(order)).tobytes()
            blocks.append({1: lambda x: x, 5: geotiff.lzw, 8: zlib.compress, 32946: zlib.compress}[compression](raw))
    head_size = 16 if large else 8
    at = head_size + sum(map(len, blocks))
    offsets = np.cumsum([head_size, *map(len, blocks)])[:-1].tolist()
    wide = 16 if large else 4
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [values.dtype.itemsize * 8]), (259, 3, [compression])]
    tags += [(273, wide, offsets), (278, 3, [bh]), (279, wide, list(map(len, blocks)))] if strips else []
    tags += [(317, 3, [predictor])]
    tags += [] if strips else [(322, 4, [bw]), (323, 4, [bh]), (324, wide, offsets), (325, wide, list(map(len, blocks)))]
    tags += [(339, 3, [{"u": 1, "i": 2, "f": 3}[values.dtype.kind]]), (33550, 12, [30.0, 30.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, -1000.0, 5000.0, 0.0])]
    tags += [(42113, 2, f"{nodata}\0".encode())] if nodata is not None else []
    tags.sort()
    room, count = (8, "Q") if large else (4, "I")
    size = (20 if large else 12) * len(tags) + (8 if large else 2) + room
    head, extra = struct.pack(order + ("Q" if large else "H"), len(tags)), b""
    for tag, kind, held in tags:
        raw = held if kind == 2 else struct.pack(order + {3: "H", 4: "I", 12: "d", 16: "Q"}[kind] * len(held), *held)
        n = len(held)
        if len(raw) > room:
            raw, extra = struct.pack(order + count, at + size + len(extra)), extra + raw
        head += struct.pack(order + "HH" + count, tag, kind, n) + raw.ljust(room, b"\0")
    start = struct.pack(order + "HHHQ", 43, 8, 0, at) if large else struct.pack(order + "HI", 42, at)
    return (b"II" if order == "<" else b"MM") + start + b"".join(blocks) + head + b"\0" * room + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("strips, large", [(True, False), (False, True), (False, False)])
@pytest.mark.parametrize("compression", [1, 5, 8])
def test_other_writers_floats_come_back_bit_by_bit(compression, strips, large, order):
    r = np.random.default_rng(compression)
    for kind in ("f4", "f8"):
        values = (np.cumsum(r.normal(size=(37, 45)), axis=1) / 7).astype(kind)
        values[r.random(values.shape) < 0.2] = np.nan
        values[0, :4] = [0.1, 0.2, np.inf, -0.0]
        for predictor in (1, 2, 3):
            got = geotiff.read(other_tiff(values, compression, predictor, order, large, strips=strips))
            assert got.values.tobytes() == values.tobytes(), (kind, predictor)
            assert (got.x_min, got.y_max, got.res) == (-1000.0, 5000.0, 30.0)


def test_float_differences_of_the_cache_form():
    for row in ([0.1, 0.2, 0.3, 0.4], [0.5, 0.25, 0.75, 1.0]):
        values = np.array([row], np.float32)
        assert (geotiff.read(other_tiff(values, 5, 2, strips=True)).values == values).all()
        assert (geotiff.read(geotiff.write(geotiff.Raster(values, 0.0, 0.0, 1.0), 5, 2)).values == values).all()


@pytest.mark.parametrize("n", [0, 1, 2, 255, 4000, 60_000])
def test_lzw_round_trips(n):
    r = np.random.default_rng(n)
    for data in (bytes(n), r.integers(0, 256, n).astype("u1").tobytes(), r.integers(0, 3, n).astype("u1").tobytes(), b"abcabd" * (n // 6)):
        assert geotiff.unlzw(geotiff.lzw(data)) == data
    assert geotiff.unlzw(b"") == b""


def test_damaged_streams_are_refused():
    with pytest.raises(ValueError):
        geotiff.unlzw(bytes([0x80, 0x7F, 0xFF, 0xFF, 0xFF]))
    with pytest.raises(ValueError):
        geotiff.header(io.BytesIO(b"II*"))
    whole = other_tiff(np.zeros((3, 3), "u2"), 1, strips=True)
    with pytest.raises(ValueError):  # differences of float bytes, of whole numbers
        geotiff.read(whole.replace(struct.pack("<HHIHH", 317, 3, 1, 1, 0), struct.pack("<HHIHH", 317, 3, 1, 3, 0)))


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(1)
    a, b = (r.integers(1, 100, (100, 130)) / 8).astype("f4"), r.integers(0, 9, (40, 50)).astype("u1")
    a[r.random(a.shape) < 0.3] = np.nan
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.tif").write_bytes(other_tiff(a, 5, 3))
    (tmp_path / "b.TIF").write_bytes(other_tiff(b, 8, 2, ">", True, nodata=0))
    (tmp_path / "notes.txt").write_text("no raster")
    return tmp_path, a, b


def cells(values, nodata=None):
    return {(i, j): float(values[i, j]) for i in range(values.shape[0]) for j in range(values.shape[1]) if values[i, j] == values[i, j] and values[i, j] != nodata}


def test_blocks_are_partitions(spark, folder):
    at, a, b = folder
    df = raster.read_rasters(spark, str(at / "x" / "a.tif"), partition_bytes=4 * 256)
    assert df.columns == ["path", "row", "col", "value"]
    assert df.rdd.getNumPartitions() == 7 * 9  # a tile each
    assert {(x.row, x.col): x.value for x in df.collect()} == cells(a)
    assert raster.read_rasters(spark, str(at / "x" / "a.tif")).rdd.getNumPartitions() == 1
    both = raster.read_rasters(spark, str(at)).collect()
    assert {x.path.rsplit("/", 1)[1] for x in both} == {"a.tif", "b.TIF"}
    assert {(x.row, x.col): x.value for x in both if x.path.endswith("b.TIF")} == cells(b, 0)
    with pytest.raises(Exception, match="no raster"):
        raster.read_rasters(spark, str(at / "nothing")).count()


def test_an_extent_reads_its_blocks_alone(spark, folder):
    at, a, _ = folder
    extent = (-1000 + 30 * 20, 5000 - 30 * 60, -1000 + 30 * 40, 5000 - 30 * 35)  # columns 20 to 39, rows 35 to 59
    df = raster.read_rasters(spark, str(at / "x" / "a.tif"), extent, 4 * 256)
    assert df.rdd.getNumPartitions() == 2 * 2  # rows of tiles 2 and 3, columns 1 and 2
    assert {(x.row, x.col): x.value for x in df.collect()} == {k: v for k, v in cells(a).items() if 35 <= k[0] < 60 and 20 <= k[1] < 40}
    assert raster.read_rasters(spark, str(at / "x" / "a.tif"), (9e6, 9e6, 9.1e6, 9.1e6)).count() == 0
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "true")
    try:
        some = raster.read_rasters(spark, str(at / "x" / "a.tif"), partition_bytes=4 * 256).where("row >= 80 and row < 96 and col > 111 and value > 3")
        assert some.rdd.getNumPartitions() == 1 * 2
        assert {(x.row, x.col): x.value for x in some.collect()} == {k: v for k, v in cells(a).items() if 80 <= k[0] < 96 and k[1] > 111 and v > 3}
    finally:
        spark.conf.unset(name)


def test_many_files_read_their_own_headers(spark, folder, monkeypatch):
    at, a, b = folder
    options = {"path": str(at), "extent": "-1000,4000,-100,5000"}
    few = raster.Reader(options)
    monkeypatch.setattr(raster, "HEADERS", 1)
    many = raster.Reader(options)
    rows = lambda r: sorted((p, i, j, v) for part in r.partitions() for batch in r.read(part) for p, i, j, v in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    assert all(p.header is None for p in many.partitions())
    found = rows(many)
    monkeypatch.setattr(raster, "HEADERS", 256)
    assert found == rows(few) and found


def weights(spark, counties=3):
    r = np.random.default_rng(2)
    rows = [("cotton", f"County {c}", 2020 + y, i, j, float(np.float32(r.random()))) for c in range(counties) for y in range(2) for i in range(150) for j in range(0, 40, 3) if (i + j + c) % 4]
    df = spark.createDataFrame(rows, "crop string, county string, year int, row int, col int, value double")
    grids = spark.createDataFrame([(f"County {c}", 5070, -1000.0 * c, 500.0, 30.0, 150, 40) for c in range(counties)], "county string, crs int, x_min double, y_max double, res double, n_rows int, n_cols int")
    return df, grids


def test_written_files_come_back(spark, tmp_path):
    df, grids = weights(spark)
    raster.write_rasters(df, grids, str(tmp_path), "weight")
    names = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    assert names == sorted(f"weight/COTTON/weight_COUNTY_{c}_{y}.tif" for c in range(3) for y in (2020, 2021))
    want = {(f"weight/COTTON/weight_{x.county.upper().replace(' ', '_')}_{x.year}.tif", x.row, x.col): x.value for x in df.collect()}
    got = {(x.path[len(str(tmp_path)) + 1 :], x.row, x.col): x.value for x in raster.read_rasters(spark, str(tmp_path), partition_bytes=4096).collect()}
    assert got == want
    h = geotiff.header((tmp_path / names[2]).open("rb"))
    assert (h.compression, h.predictor, h.kind, h.epsg, h.x_min, h.height, h.width) == (5, 2, "<f4", 5070, -1000.0, 150, 40)
    # A second write replaces its own files and leaves the others.
    raster.write_rasters(df.where("county = 'County 1' and year = 2020").withColumn("value", F.lit(0.5)), grids, str(tmp_path), "weight")
    again = raster.read_rasters(spark, str(tmp_path))
    assert again.where("value = 0.5").select("path").distinct().count() >= 1 and again.count() == len(want)
    with pytest.raises(ValueError):
        raster.write_rasters(df, grids, str(tmp_path), "kind")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df, grids = weights(spark)
    bad = df.unionByName(df.limit(1).withColumn("row", F.lit(5000)))
    with pytest.raises(Exception, match="outside its"):
        raster.write_rasters(bad, grids, str(tmp_path), "weight")
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
    with pytest.raises(Exception, match="lack the columns"):
        df.write.format("geotiff").mode("append").save(str(tmp_path))
    raster.write_rasters(df.limit(0), grids, str(tmp_path), "weight")
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
