"""Grids and points: cells of coordinates, resampling between grids, polygons as cell sets, centres, distances."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreflow.functions.columns import ALBERS, from_albers, norm_county, project, project_by
from acreflow.schemas import require_columns
from acreflow.sources.tables import settled

#: Columns of a table of grids, beside its keys.
GRID = ("crs", "x_min", "y_max", "res")


@dataclass(frozen=True)
class Grid:
    """A north-up grid of square cells: the system of its coordinates, the upper left corner, the cell size. The corner
    and the size may be columns of the rows at hand."""

    crs: int
    x_min: float | Column
    y_max: float | Column
    res: float | Column

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return centre(row, col, self.x_min, self.y_max, self.res)

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) of a point, fractional, cell centres at whole numbers."""
        return (F.lit(self.y_max) - y) / self.res - 0.5, (x - F.lit(self.x_min)) / self.res - 0.5

    def place_of(self, row: Column, col: Column, grid: Grid) -> tuple[Column, Column]:
        """Where the centre of another grid's cell lies on this one: the inverse way, from target to source."""
        return self.place(*project(*grid.centre(row, col), grid.crs, self.crs))


def centre(row: Column, col: Column, x_min: float, y_max: float, res: float) -> tuple[Column, Column]:
    """Coordinates of a cell's centre."""
    return F.lit(x_min) + (col + 0.5) * res, F.lit(y_max) - (row + 0.5) * res


def cell_at(x: Column, y: Column, x_min: float, y_max: float, res: float) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a point."""
    return F.floor((F.lit(y_max) - y) / res).cast("int"), F.floor((x - F.lit(x_min)) / res).cast("int")


def nearest(target: DataFrame, source: DataFrame, row: Column, col: Column, keys: list[str], value: str = "value") -> DataFrame:
    """Values of the source cells (keys, row, col, value) that the target cells' places fall into. row and col: of the
    target's place on the source grid, fractional, cell centres at whole numbers. An equality join."""
    asked = target.withColumns({"_r": F.round(row).cast("int"), "_c": F.round(col).cast("int")})
    given = source.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value))
    return asked.join(given, [*keys, "_r", "_c"]).drop("_r", "_c")


def bilinear(target: DataFrame, source: DataFrame, row: Column, col: Column, keys: list[str], cell: list[str], value: str = "value") -> DataFrame:
    """(keys, cell, value): the weighted mean of the four source cells around each place; weights of absent cells go
    to those present, and a place without any drops. Four rows a cell, one equality join, one grouping."""
    r0, c0 = F.floor(row), F.floor(col)
    corners = F.array(*[
        F.struct((r0 + i).cast("int").alias("_r"), (c0 + j).cast("int").alias("_c"), ((row - r0 if i else r0 + 1 - row) * (col - c0 if j else c0 + 1 - col)).alias("_w"))
        for i in (0, 1) for j in (0, 1)
    ])
    asked = target.select(*keys, *cell, F.inline(corners)).where("_w > 0")
    given = source.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v")).where("_v is not null")
    return asked.join(given, [*keys, "_r", "_c"]).groupBy(*keys, *cell).agg(F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.sum("_w")).alias(value))


def resampled(target: DataFrame, source: DataFrame, to: Grid, of: Grid, keys: list[str], value: str = "value", method: str = "bilinear", cell: tuple[str, str] = ("row", "col")) -> DataFrame:
    """(keys, cell, value): the cells of ``target``, on the grid ``to``, with the values of ``source`` (keys, row, col,
    value), on the grid ``of`` and in any system of coordinates. Cells for which there is no value drop."""
    row, col = of.place_of(F.col(cell[0]), F.col(cell[1]), to)
    placed = target.select(*keys, *cell, row.alias("_pr"), col.alias("_pc"))
    if method == "bilinear":
        return bilinear(placed, source, F.col("_pr"), F.col("_pc"), keys, list(cell), value)
    if method != "near":
        raise ValueError(f"method must be bilinear or near, not {method}")
    return nearest(placed, source, F.col("_pr"), F.col("_pc"), keys, value).select(*keys, *cell, value)


# Polygons --------------------------------------------------------------------------------------------------------

Ring = np.ndarray  # rows of (x, y), the first again at the end


def polygons_of(wkb: bytes) -> list[list[Ring]]:
    """The polygons of a WKB polygon or multipolygon, each as its rings, without heights and measures."""

    def read(at: int) -> tuple[list[list[Ring]], int]:
        order = "<" if wkb[at] else ">"
        kind, at = struct.unpack_from(order + "I", wkb, at + 1)[0], at + 5
        size = 2 + bool(kind & 0x80000000 or kind % 10000 // 1000 in (1, 3)) + bool(kind & 0x40000000 or kind % 10000 // 1000 in (2, 3))
        if kind & 0x20000000:
            at += 4  # a reference system
        n, at = struct.unpack_from(order + "I", wkb, at)[0], at + 4
        if kind & 0xFF == 6 or kind % 1000 == 6:
            out = []
            for _ in range(n):
                more, at = read(at)
                out += more
            return out, at
        if kind & 0xFF != 3 and kind % 1000 != 3:
            raise ValueError("only polygons and multipolygons are read")
        rings = []
        for _ in range(n):
            m, at = struct.unpack_from(order + "I", wkb, at)[0], at + 4
            rings.append(np.frombuffer(wkb, order + "f8", m * size, at).reshape(m, size)[:, :2].astype(float))
            at += 8 * m * size
        return [rings], at

    return read(0)[0]


def rings_of(wkb: bytes) -> list[Ring]:
    """All rings of a WKB polygon or multipolygon."""
    return [ring for polygon in polygons_of(wkb) for ring in polygon]


def wkb_of(polygons: list[list[Ring]]) -> bytes:
    """A WKB polygon, or a multipolygon of several or none."""
    one = [struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in rings) for rings in polygons]
    return one[0] if len(one) == 1 else struct.pack("<BII", 1, 6, len(one)) + b"".join(one)


def densified(ring: Ring, longest: float) -> Ring:
    """The ring with points between its own, so that no side is longer."""
    step = np.diff(ring, axis=0)
    parts = np.maximum(1, np.ceil(np.hypot(step[:, 0], step[:, 1]) / longest)).astype(int)
    side = np.repeat(np.arange(len(step)), parts)
    share = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) / parts[side]
    return np.concatenate([ring[side] + share[:, None] * step[side], ring[-1:]])


def projected_wkb(wkb: bytes | None, source: int, target: int, longest: float | None = None) -> bytes | None:
    """The geometry's vertices in another system. A straight side is a curve there: ``longest`` (in units of the source)
    cuts sides before they are projected, so that the curve is followed."""
    if wkb is None or source == target:
        return wkb
    move = lambda ring: np.stack(project(ring[:, 0], ring[:, 1], source, target, np), -1)
    return wkb_of([[move(densified(r, longest) if longest and len(r) > 1 else r) if len(r) else r for r in rings] for rings in polygons_of(wkb)])


def measures(geom: Column) -> tuple[Column, Column]:
    """Area (holes out) and length of border of WKB polygons, in the units of their coordinates; null of null."""

    @F.pandas_udf("area double, border double")
    def measured(wkb: pd.Series) -> pd.DataFrame:
        def one(raw: bytes | None) -> tuple[float | None, float | None]:
            if raw is None:
                return None, None
            area = border = 0.0
            for polygon in polygons_of(raw):
                for i, r in enumerate(polygon):
                    (x, y), (u, v) = (r[:-1] - r[0]).T, (r[1:] - r[0]).T
                    area += abs(float((x * v - u * y).sum()) / 2) * (-1 if i else 1)
                    border += float(np.hypot(u - x, v - y).sum())
            return area, border

        return pd.DataFrame([one(w) for w in wkb], columns=["area", "border"])

    found = measured(geom)
    return found["area"], found["border"]


def projected_layer(layer: DataFrame, source: int, target: int, geom: str = "geom", longest: float | None = None) -> DataFrame:
    """``layer`` with its polygons (WKB in ``geom``) in another system of coordinates; null stays null. Narrow."""
    at, names = layer.columns.index(geom), layer.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns = list(batch.columns)
            columns[at] = pa.array([projected_wkb(w, source, target, longest) for w in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    return layer.mapInArrow(run, layer.schema)


def polygon_spans(rings: list[np.ndarray], n_rows: int, n_cols: int, touches: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(row, columns) of the cells of a polygon in grid units (x right, y down): those whose centre lies inside by the
    even-odd rule, and with ``touches`` all that its boundary passes through, too."""
    a = np.concatenate([r[:-1] if (r[0] == r[-1]).all() else r for r in rings])
    b = np.concatenate([np.roll(r[:-1] if (r[0] == r[-1]).all() else r, -1, 0) for r in rings])
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    # Columns are counted from the polygon's first: a wide raster costs a small polygon nothing.
    first_col = int(np.clip(np.floor(a[:, 0].min()), 0, n_cols))
    n_cols = int(np.clip(np.floor(a[:, 0].max()) + 1, first_col, n_cols)) - first_col
    a, b = a - [first_col, 0], b - [first_col, 0]
    for row in range(max(0, int(np.floor(low.min()))), min(n_rows, int(np.floor(high.max())) + 1)):
        y, hit = row + 0.5, np.zeros(n_cols + 1, np.int64)
        at = np.flatnonzero((a[:, 1] <= y) != (b[:, 1] <= y))
        cross = np.sort(a[at, 0] + (y - a[at, 1]) / (b[at, 1] - a[at, 1]) * (b[at, 0] - a[at, 0]))
        np.add.at(hit, np.clip(np.ceil(cross[::2] - 0.5), 0, n_cols).astype(int), 1)
        np.add.at(hit, np.clip(np.ceil(cross[1::2] - 0.5), 0, n_cols).astype(int), -1)
        inside = hit.cumsum()[:-1] > 0
        if touches:
            at = np.flatnonzero((low < row + 1) & (high >= row))
            rise = b[at, 1] - a[at, 1]
            ends = [np.where(rise == 0, x, a[at, 0] + np.clip(np.divide(edge - a[at, 1], rise, out=np.zeros(len(at)), where=rise != 0), 0, 1) * (b[at, 0] - a[at, 0])) for edge, x in ((row, a[at, 0]), (row + 1, b[at, 0]))]
            for first, last in zip(np.floor(np.minimum(*ends)).astype(int), np.floor(np.maximum(*ends)).astype(int), strict=True):
                inside[max(0, first) : max(0, last + 1)] = True
        if len(found := np.flatnonzero(inside)):
            yield row, found + first_col


#: Cells of polygons that are emitted at a time, about.
_EMIT = 1 << 16


def cells_on_grids(layer: DataFrame, keys: list[str], touches: bool = False, geom: str = "geom", source: int | None = None, longest: float | None = None) -> DataFrame:
    """(keys, row, col): the cells of each polygon of ``layer`` (WKB in ``geom``; null: none) on the grid of its own row, which
    the columns x_min, y_max, res, n_rows and n_cols describe. Where the polygons' system is given (``source``) and isn't
    that of the row's grid (crs), they are brought there first, sides cut to ``longest``.

    A narrow operator: a polygon at a time, its cells emitted as they come, so polygons may be large or many."""
    frame = ["x_min", "y_max", "res", "n_rows", "n_cols", *(["crs"] if source else [])]
    rows = layer.select(*keys, geom, *frame)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = batch.select(keys)
            whose: list[np.ndarray] = []
            found: list[np.ndarray] = []

            def emit() -> pa.RecordBatch:
                at, cells = np.concatenate(whose), np.concatenate(found)
                whose.clear()
                found.clear()
                return pa.RecordBatch.from_arrays([*own.take(pa.array(at)).columns, pa.array(cells[:, 0]), pa.array(cells[:, 1])], [*keys, "row", "col"])

            held = 0
            for i, (wkb, x_min, y_max, res, n_rows, n_cols, *crs) in enumerate(zip(*(c.to_pylist() for c in batch.columns[len(keys) :]), strict=True)):
                if wkb is None:
                    continue
                if crs:
                    wkb = projected_wkb(wkb, source, crs[0], longest)
                rings = [np.stack([(r[:, 0] - x_min) / res, (y_max - r[:, 1]) / res], -1) for r in rings_of(wkb) if len(r)]
                if not rings:
                    continue
                for row, cols in polygon_spans(rings, n_rows, n_cols, touches):
                    whose.append(np.full(len(cols), i))
                    found.append(np.stack([np.full(len(cols), row, np.int32), cols.astype(np.int32)], -1))
                    held += len(cols)
                    if held > _EMIT:
                        yield emit()
                        held = 0
            if held:
                yield emit()

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[: len(keys)]) + ", row int, col int")


def polygon_cells(layer: DataFrame, keys: list[str], x_min: float, y_max: float, res: float, n_rows: int, n_cols: int, touches: bool = False, geom: str = "geom") -> DataFrame:
    """(keys, row, col): the cells of each polygon of ``layer`` (WKB in ``geom``, in the grid's coordinates; null: none) on
    one grid for all."""
    one = {"x_min": F.lit(float(x_min)), "y_max": F.lit(float(y_max)), "res": F.lit(float(res)), "n_rows": F.lit(n_rows), "n_cols": F.lit(n_cols)}
    return cells_on_grids(layer.select(*keys, geom).withColumns(one), keys, touches, geom)


def county_cells(layer: DataFrame, targets: DataFrame, keys: list[str], source: int = 4326, touches: bool = True, longest: float | None = None) -> DataFrame:
    """(keys, row, col): each target's county as cells of its own grid.

    layer: (COUNTY as given, geom in the system ``source``); targets: (keys, county, crs, x_min, y_max, res, n_rows,
    n_cols). Names are normalised on both sides; a county of several polygons has the cells of all; one without any
    has none. A layer has a row a county, so the join is as small as the targets."""
    require_columns(layer, ["COUNTY", "geom"], "the county layer")
    require_columns(targets, [*keys, "county", *GRID, "n_rows", "n_cols"], "targets")
    named = layer.select(norm_county(F.col("COUNTY")).alias("_county"), "geom")
    joined = targets.withColumn("_county", norm_county(F.col("county"))).join(named, "_county")
    return cells_on_grids(joined, keys, touches, "geom", source, longest).distinct()


def in_polygon(pixels: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a polygon given as its cells."""
    return pixels.join(members.select(*keys).distinct(), keys, "left_semi")


def in_box(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int], row: str = "row", col: str = "col") -> DataFrame:
    """Cells of an extent, ends included: a range predicate that reaches the scan."""
    return pixels.where(F.col(row).between(*rows) & F.col(col).between(*cols))


def boxes(cells: DataFrame, keys: list[str], res: float = 1.0, x: str = "cx", y: str = "cy") -> DataFrame:
    """Bounding box of each key's cell edges; cells span x..x+1."""
    edge = lambda f, c, add: ((f(c) + add) * res).cast("double")
    return cells.groupBy(*keys).agg(edge(F.min, x, 0).alias("x_min"), edge(F.min, y, 0).alias("y_min"), edge(F.max, x, 1).alias("x_max"), edge(F.max, y, 1).alias("y_max"))


def unit_centres(cells: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """Centres of units both ways: lon and lat are means of the cells' degrees (transform, then average); x and y the
    means on the plane."""
    lon, lat = from_albers(x, y)
    return cells.withColumns({"_x": x, "_y": y, "_lon": lon, "_lat": lat}).groupBy(*keys).agg(F.avg("_lon").alias("lon"), F.avg("_lat").alias("lat"), F.avg("_x").alias("x"), F.avg("_y").alias("y"))


def on_plane(cells: DataFrame, grids: DataFrame, keys: list[str], x: str = "cx", y: str = "cy") -> DataFrame:
    """``cells`` with the centre of each cell on the equal-area plane, as _x and _y in metres.

    grids: (some of ``keys``, crs, x_min, y_max, res), a row a raster; x counts columns from the left edge, y rows from the
    top. Cells of a raster without a grid have no place."""
    own = [k for k in keys if k in grids.columns]
    named = grids.select(*own, *[F.col(c).alias(f"_{c}") for c in GRID])
    placed = cells.join(named, own, "left")
    place = centre(F.col(y), F.col(x), F.col("_x_min"), F.col("_y_max"), F.col("_res"))
    px, py = project_by(*place, F.col("_crs"), ALBERS)
    return placed.withColumns({"_x": px, "_y": py}).drop(*[f"_{c}" for c in GRID])


def zone_degrees(zones: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """lon and lat of zones: average on the plane, then transform."""
    lon, lat = from_albers(F.col(x), F.col(y))
    return zones.withColumns({"lon": lon, "lat": lat})


#: Rows of a side of a cell that meet at a time, and pairs of a task, about.
_CHUNK, _PAIRS = 1 << 10, 1 << 22


def within(points: DataFrame, sites: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Pairs of a point (point_id, x, y) and a site (site_id, sx, sy) of the same keys at most ``radius`` apart.

    A range join on a grid of radius-sized cells: each site stands in the nine cells around it, so the join is an
    equality and no pair meets twice. Pairs may be many where rows are few, so tasks are made by pairs, not by bytes:
    both sides of a cell are cut into chunks by hash, each chunk meets each of the other side, and there is a partition
    for about _PAIRS pairs. Cells are counted first, for that."""
    g = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.struct((g("sx") + i).alias("_gx"), (g("sy") + j).alias("_gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cell = [*keys, "_gx", "_gy"]
    sides = points.withColumns({"_gx": g("x"), "_gy": g("y")}), sites.select("*", F.inline(near))
    counts = [side.groupBy(*cell).agg(F.count("*").alias(n)) for side, n in zip(sides, ("_np", "_ns"), strict=True)]
    both = settled(counts[0].join(counts[1], cell))
    n = int(both.agg(F.coalesce(F.sum(F.col("_np").cast("double") * F.col("_ns")), F.lit(0.0))).first()[0] // _PAIRS) + 1
    chunks = lambda c: F.ceil(F.col(c) / _CHUNK).cast("int")
    own = lambda df, c: F.pmod(F.xxhash64(*df.columns), chunks(c)).cast("int")
    others = lambda c: F.explode(F.sequence(F.lit(0), chunks(c) - 1))
    p = sides[0].join(both, cell).withColumn("_p", own(sides[0], "_np")).withColumn("_s", others("_ns")).drop("_np", "_ns")
    s = sides[1].join(both, cell).withColumn("_s", own(sides[1], "_ns")).withColumn("_p", others("_np")).drop("_np", "_ns")
    on = [*cell, "_p", "_s"]
    found = p.repartition(n, *on).join(s.repartition(n, *on), on)
    return found.withColumn("distance", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))).where(F.col("distance") <= radius).drop("_gx", "_gy", "_p", "_s")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
