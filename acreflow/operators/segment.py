"""Fields and harvest units of a raster: components, sieve, zonal sums, tiles of giant fields, ranking.

A unit is its set of cells; areas are counted in cells and become hectares last, so that comparisons are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreflow.functions.columns import is_finite
from acreflow.operators import geo, stars
from acreflow.sources.tables import dropped, settled

KEYS = ("county_id", "yr")
CELL = ("cx", "cy")


def label_components(x: np.ndarray, y: np.ndarray, width: int | None = None, kind: np.ndarray | None = None) -> np.ndarray:
    """For each cell the least code x * width + y of its 4-neighbour component. Repeated cells are allowed; coordinates
    are whole numbers from 0. ``width`` is above every y; by default the least such, plus one. With ``kind`` (whole numbers)
    only cells of one kind are neighbours.

    Neighbours by binary search in the sorted codes; labels fall by hooking and pointer jumping, in a number of
    rounds that grows with the logarithm of a component's size."""
    if len(x) and min(x.min(), y.min()) < 0:
        raise ValueError("cells are numbered from 0")
    highest = int(y.max()) if len(y) else 0
    if width is not None and width <= highest:
        raise ValueError(f"a raster of width {width} has no cell {highest}")
    width = width or highest + 2
    code = x.astype(np.int64) * width + y
    cells, at, place = np.unique(code, return_index=True, return_inverse=True)
    own = None if kind is None else kind[at]
    pairs = []
    for step, inside in ((1, cells % width != width - 1), (width, np.ones(len(cells), bool))):
        at = np.searchsorted(cells, cells + step)
        hit = (at < len(cells)) & inside
        hit[hit] = cells[at[hit]] == cells[hit] + step
        if own is not None:
            hit[hit] = own[at[hit]] == own[hit]
        pairs.append((np.flatnonzero(hit), at[hit]))
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    root = np.arange(len(cells))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return cells[root][place]


#: Side of the blocks in which a raster is labelled: a million cells at most in a task.
BLOCK = 1024


def _widths(support: DataFrame, width: int | None) -> DataFrame:
    """(keys, _width): of the codes that name components, one beyond every cell of the raster and its right neighbour."""
    if width is not None:
        return support.select(*KEYS).distinct().withColumn("_width", F.lit(width).cast("long"))
    return support.groupBy(*KEYS).agg((F.max("cy") + 2).cast("long").alias("_width"))


def _labelled_blocks(support: DataFrame, block: int, by: str | None) -> DataFrame:
    """``support`` with _x and _y, the least cell of the component within its block of the raster. Stored: a block is the
    largest group that a task holds, and only Arrow columns move."""
    names = support.columns

    def run(group: pa.Table) -> pa.Table:
        x, y = (group.column(c).to_numpy().astype(np.int64) for c in CELL)
        x0, y0 = x.min(), y.min()
        width = int(y.max() - y0) + 2
        code = label_components(x - x0, y - y0, width, group.column(by).to_numpy() if by else None)
        out = group.select(names)
        return out.append_column("_x", pa.array(x0 + code // width)).append_column("_y", pa.array(y0 + code % width))

    place = {f"_b{i}": F.floor(F.col(c) / block).cast("int") for i, c in enumerate(CELL)}
    schema = ", ".join(f"`{n}` {t}" for n, t in support.dtypes) + ", _x long, _y long"
    return settled(support.withColumns(place).groupBy(*KEYS, "_b0", "_b1").applyInArrow(run, schema))


def _seams(labelled: DataFrame, block: int, by: str | None) -> DataFrame:
    """(u, v): components of neighbouring blocks that touch, by equality joins of the cells on both sides of the seams."""
    node, alike = F.struct(*KEYS, "_x", "_y"), [by] if by else []

    def across(c: str) -> DataFrame:
        here = labelled.where(F.col(c) % block == block - 1).select(*KEYS, *[(F.col(k) + 1).cast(dict(labelled.dtypes)[k]).alias(k) if k == c else k for k in CELL], *alike, node.alias("u"))
        there = labelled.where(F.col(c) % block == 0).select(*KEYS, *CELL, *alike, node.alias("v"))
        return here.join(there, [*KEYS, *CELL, *alike]).select("u", "v")

    return across("cx").union(across("cy")).distinct()


def components(support: DataFrame, width: int | None = None, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """``support`` with patch, the least code cx * width + cy of its 4-neighbour component; with ``by`` (a column of whole
    numbers, never null) of neighbours with the same value.

    Rasters are labelled in blocks of ``block`` by ``block`` cells, side by side, and the labels are joined over the
    seams as components of a table of touching labels, which grows with the seams only. So no county is one task's,
    whatever its extent. Where every raster lies in its first block there are no seams to join."""
    names = support.columns
    low_x, low_y, high_x, high_y = support.agg(*[f(c) for f in (F.min, F.max) for c in CELL]).first()
    if high_x is not None and min(low_x, low_y) < 0:
        raise ValueError("cells are numbered from 0")
    if width is not None and high_y is not None and high_y >= width:
        raise ValueError(f"a raster of width {width} has no cell {high_y}")
    if high_x is None or max(high_x, high_y) < block:

        def run(group: pa.Table) -> pa.Table:
            patch = label_components(group.column("cx").to_numpy(), group.column("cy").to_numpy(), width, group.column(by).to_numpy() if by else None)
            return group.append_column("patch", pa.array(patch, pa.int64()))

        return support.groupBy(*KEYS).applyInArrow(run, ", ".join(f"`{n}` {t}" for n, t in support.dtypes) + ", patch long").select(*names, "patch")
    labelled = _labelled_blocks(support, block, by)
    roots = stars.components(_seams(labelled, block, by)).select("u.*", F.col("root._x").alias("_rx"), F.col("root._y").alias("_ry"))
    joined = labelled.join(roots, [*KEYS, "_x", "_y"], "left").join(_widths(support, width), list(KEYS))
    patch = F.coalesce("_rx", "_x") * F.col("_width") + F.coalesce("_ry", "_y")
    return joined.withColumn("patch", patch).select(*names, "patch")


def sieve(labelled: DataFrame, least: int = 50) -> DataFrame:
    """Without components of fewer cells. Counts combine before the shuffle and are joined back: no window holds a
    component's rows, however large it is."""
    kept = labelled.groupBy(*KEYS, "patch").count().where(F.col("count") >= least)
    return labelled.join(kept.select(*KEYS, "patch"), [*KEYS, "patch"], "left_semi")


def adjacency(labelled: DataFrame) -> DataFrame:
    """(keys, patch, other, border): regions that touch, both ways, and the number of cell sides between them. Equality
    joins of each cell with the one to its right and the one below."""
    own = labelled.select(*KEYS, *CELL, "patch")
    types = dict(own.dtypes)

    def touching(c: str) -> DataFrame:
        moved = own.select(*KEYS, *[(F.col(k) - 1).cast(types[k]).alias(k) if k == c else k for k in CELL], F.col("patch").alias("other"))
        return own.join(moved, [*KEYS, *CELL]).where("patch != other").select(*KEYS, "patch", "other")

    once = touching("cx").union(touching("cy"))
    return once.union(once.select(*KEYS, F.col("other").alias("patch"), F.col("patch").alias("other"))).groupBy(*KEYS, "patch", "other").agg(F.count("*").alias("border"))


def sieve_into(labelled: DataFrame, value: str, least: int = 50) -> DataFrame:
    """``labelled`` (regions of equal ``value``, as ``components`` with ``by`` gives them) with the regions of fewer cells merged
    into their largest neighbour: value and patch become that region's.

    If the largest neighbour is small too, its own largest neighbour is tried, and so on; a region from which no chain leads
    to a large one, or that has no neighbour, stays as it is. Of neighbours of one size the least patch counts. In that
    order chains can only run in circles between two regions that are each other's largest neighbour: these are taken out,
    and the ends of the others are found by doubling, in rounds that grow with the logarithm of the longest chain."""
    sizes = settled(labelled.groupBy(*KEYS, "patch").agg(F.count("*").alias("n"), F.first(value).alias("_value")))
    best = F.max(F.struct(F.col("n"), (-F.col("other")).alias("other"))).alias("best")
    around = adjacency(labelled).join(sizes.select(*KEYS, F.col("patch").alias("other"), "n"), [*KEYS, "other"]).groupBy(*KEYS, "patch").agg(best)
    around = around.select(*KEYS, "patch", (-F.col("best.other")).alias("to"), (F.col("best.n") >= least).alias("ends"))
    # Of the small regions alone: where each leads, and whether that is large.
    chain = sizes.where(F.col("n") < least).select(*KEYS, "patch").join(around, [*KEYS, "patch"])
    back = chain.where(~F.col("ends")).select(*KEYS, F.col("to").alias("patch"), F.col("patch").alias("to"))
    links = settled(chain.join(back, [*KEYS, "patch", "to"], "left_anti"))
    before = None
    while True:
        open_ = links.agg(F.count_if(~F.col("ends")), F.sum(F.xxhash64(*KEYS, "patch", "to").cast("decimal(38,0)"))).first()
        if not open_[0] or open_ == before:
            break
        before = open_
        further = links.select(*KEYS, F.col("patch").alias("to"), F.col("to").alias("_to"), F.col("ends").alias("_ends"))
        moved = links.join(further, [*KEYS, "to"], "left")
        goes = ~F.col("ends") & F.col("_to").isNotNull()
        last, links = links, settled(moved.select(*KEYS, "patch", F.when(goes, F.col("_to")).otherwise(F.col("to")).alias("to"), F.when(goes, F.col("_ends")).otherwise(F.col("ends")).alias("ends")))
        dropped(last)
    into = links.where("ends").join(sizes.select(*KEYS, F.col("patch").alias("to"), "_value"), [*KEYS, "to"]).select(*KEYS, "patch", F.col("to").alias("_patch"), "_value")
    merged = labelled.join(into, [*KEYS, "patch"], "left")
    return merged.withColumns({"patch": F.coalesce("_patch", "patch"), value: F.when(F.col("_patch").isNotNull(), F.col("_value")).otherwise(F.col(value))}).select(labelled.columns)


def fields(labelled: DataFrame, weight: str = "w") -> DataFrame:
    """(county_id, yr, patch, area_cells, w_sum, w_density): zonal sums; fields without a finite weight drop."""
    sums = labelled.groupBy(*KEYS, "patch").agg(F.count("*").alias("area_cells"), F.sum(weight).alias("w_sum"))
    kept = sums.where(is_finite(F.col("w_sum").cast("double")))
    return kept.withColumn("w_density", F.col("w_sum").cast("double") / F.col("area_cells"))


def split_by_size(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(at most, more than) ``most`` cells."""
    return table.where(F.col("area_cells") <= most), table.where(F.col("area_cells") > most)


def tiles(labelled: DataFrame, most: int, side: int, partial: bool = False, touches: bool = False) -> DataFrame:
    """Cells of fields larger than ``most`` cells with their tile (tile_i, tile_j): squares of ``side`` cells from the
    field's lower corner. Only full tiles fit its bounding box unless ``partial``. With ``touches`` a cell on a tile's
    edge counts in both tiles."""
    extent = [f(c).alias(n) for f, c, n in ((F.min, "cx", "_x0"), (F.min, "cy", "_y0"), (F.max, "cx", "_x1"), (F.max, "cy", "_y1"))]
    boxes = labelled.groupBy(*KEYS, "patch").agg(F.count("*").alias("_n"), *extent).where(F.col("_n") > most)
    giant = labelled.join(boxes, [*KEYS, "patch"]).select(*labelled.columns, "_x0", "_y0", "_x1", "_y1")

    def index(c: str, low: str) -> Column:
        offset = F.col(c) - F.col(low)
        own = F.floor(offset / side).cast("int")
        edge = (offset % side == 0) & (own > 0)
        return F.when(edge, F.array(own - 1, own)).otherwise(F.array(own)) if touches else F.array(own)

    found = giant.withColumn("tile_i", F.explode(index("cx", "_x0"))).withColumn("tile_j", F.explode(index("cy", "_y0")))
    count = lambda low, high: F.floor((F.col(high) - F.col(low) + 1) / side)
    if not partial:
        found = found.where((F.col("tile_i") < count("_x0", "_x1")) & (F.col("tile_j") < count("_y0", "_y1")))
    return found.drop("_x0", "_y0", "_x1", "_y1")


def tile_units(tiled: DataFrame, weight: str = "w") -> DataFrame:
    """(keys, patch_parent, unit_id, area_cells, w_sum, tile_i, tile_j, tile_id): the tiles that have cells, numbered
    column by column; tile_id is that number within the field."""
    sums = tiled.groupBy(*KEYS, "patch", "tile_i", "tile_j").agg(F.count("*").alias("area_cells"), F.sum(weight).alias("w_sum"))
    number = F.row_number().over(Window.partitionBy(*KEYS, "patch").orderBy("tile_i", "tile_j"))
    return sums.withColumn("_i", number).select(*KEYS, F.col("patch").alias("patch_parent"), F.concat_ws("_", F.col("patch").cast("string"), F.col("_i").cast("string")).alias("unit_id"), "area_cells", "w_sum", "tile_i", "tile_j", F.col("_i").cast("long").alias("tile_id"))


def ranked_units(small: DataFrame, tiled: DataFrame, least: int, most: int) -> DataFrame:
    """All units within the size limits (inclusive), by descending weight, with their running area."""
    whole = small.select(*KEYS, F.col("patch").cast("string").alias("unit_id"), "area_cells", "w_sum")
    units = whole.unionByName(tiled.select(*KEYS, "unit_id", "area_cells", "w_sum")).where(F.col("area_cells").between(least, most))
    order = Window.partitionBy(*KEYS).orderBy(F.col("w_sum").desc_nulls_last(), "unit_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return units.withColumn("w_density", F.col("w_sum").cast("double") / F.col("area_cells")).withColumn("cum_cells", F.sum("area_cells").over(order))


def membership(labelled: DataFrame, tiled: DataFrame, units: DataFrame) -> DataFrame:
    """Which cells make up each unit: the geometry of units as a table (keys, unit_id, cx, cy)."""
    numbered = units.where("tile_i is not null").select(*KEYS, F.col("patch_parent").alias("patch"), "tile_i", "tile_j", "unit_id") if "tile_i" in units.columns else None
    whole = labelled.select(*KEYS, F.col("patch").cast("string").alias("unit_id"), *CELL)
    parts = tiled.join(numbered, [*KEYS, "patch", "tile_i", "tile_j"]).select(*KEYS, "unit_id", *CELL) if numbered is not None else None
    return whole.unionByName(parts) if parts is not None else whole


def traced(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> list[np.ndarray]:
    """Simple closed rings, as corners, of the directed unit sides from (x, y) to (x + dx, y + dy) around a set of cells,
    the cells to the right of each side as rows grow downwards. Where two rings meet in a corner they stay apart."""
    follows: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, c, d in zip(x.tolist(), y.tolist(), dx.tolist(), dy.tolist(), strict=True):
        follows.setdefault((a, b), []).append((c, d))
    rings = []
    while follows:
        start = next(iter(follows))
        path, at, seen, c, d = [start], start, {start: 0}, 0, 0
        while at in follows:
            # In a corner of four sides the ring turns right, so it stays with the cells that it goes around.
            right = (-d, c)
            c, d = follows[at].pop(follows[at].index(right) if right in follows[at] else 0)
            if not follows[at]:
                del follows[at]
            at = (at[0] + c, at[1] + d)
            if at in seen:  # a ring is closed: it is cut off, and what led to it goes on
                k = seen[at]
                ring = path[k:]
                for p in ring[1:]:
                    del seen[p]
                del path[k + 1 :]
                rings.append(_corners(np.array([*ring, at])))
            else:
                seen[at] = len(path)
                path.append(at)
    return rings


def _corners(ring: np.ndarray) -> np.ndarray:
    """The ring without the points on its straight sides."""
    step = np.diff(ring, axis=0)
    turn = np.flatnonzero((step != np.roll(step, 1, axis=0)).any(axis=1))
    return ring[np.append(turn, turn[0])]


def _area(ring: np.ndarray) -> float:
    """Signed: above zero where the ring turns from x towards y."""
    return float((ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1]).sum() / 2)


def _holds(ring: np.ndarray, px: float, py: float) -> bool:
    """Whether a point off the ring lies inside."""
    (x, y), (u, v) = ring[:-1].T, ring[1:].T
    cross = (y <= py) != (v <= py)
    return bool((np.where(cross, x + np.divide(py - y, v - y, out=np.zeros(len(x)), where=cross) * (u - x) > px, False)).sum() % 2)


def polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings as ``traced`` gives them, holes with the smallest shell around them; the largest polygon first."""
    shells = sorted((r for r in rings if _area(r) > 0), key=lambda r: (_area(r), r.tolist()))
    out = [[r] for r in shells]
    for hole in sorted((r for r in rings if _area(r) < 0), key=lambda r: r.tolist()):
        side = hole[1] - hole[0]
        mid = (hole[0] + hole[1]) / 2 + np.array([-side[1], side[0]]) / np.hypot(*side) / 2  # of the cell inside the shell, beside the hole
        next(p for p in out if _holds(p[0], *mid)).append(hole)
    return out[::-1]


def outlines(cells: DataFrame, keys: list[str], x_min: float | Column = 0.0, y_max: float | Column = 0.0, res: float | Column = 1.0, x: str = "cx", y: str = "cy") -> DataFrame:
    """(keys, n_rings, geom): sets of cells dissolved to polygons with holes, as WKB; x counts columns from the left edge
    x_min, y rows from the top y_max. Sets of several parts are multipolygons.

    The sides between a set's cells cancel in one grouping before anything is gathered, so a task holds a set's outline,
    not its cells. Tracing and ``geo.polygon_cells`` are inverse."""
    frame = {"_x_min": F.lit(x_min), "_y_max": F.lit(y_max), "_res": F.lit(res)}
    own = cells.select(*keys, F.col(x).cast("long").alias("_x"), F.col(y).cast("long").alias("_y"), *[c.cast("double").alias(n) for n, c in frame.items()]).dropDuplicates([*keys, "_x", "_y"])
    # Each side by its first corner to the left or above, and whether it is walked onwards: right, down, left, up around a cell.
    X, Y = F.col("_x"), F.col("_y")
    side = lambda a, b, across, sign: F.struct(a.alias("_a"), b.alias("_b"), F.lit(across).alias("_across"), F.lit(sign).alias("_sign"))
    sides = own.select(*keys, *frame, F.inline(F.array(side(X, Y, True, 1), side(X + 1, Y, False, 1), side(X, Y + 1, True, -1), side(X, Y, False, -1))))
    border = sides.groupBy(*keys, "_a", "_b", "_across").agg(F.sum("_sign").alias("_sign"), *[F.first(n).alias(n) for n in frame]).where("_sign != 0")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_a", "ascending"), ("_b", "ascending"), ("_across", "ascending")])
        a, b, across, sign = (group.column(c).to_numpy() for c in ("_a", "_b", "_across", "_sign"))
        dx, dy = np.where(across, sign, 0), np.where(across, 0, sign)
        rings = traced(a + (across & (sign < 0)), b + (~across & (sign < 0)), dx, dy)
        left, top, size = (group.column(c)[0].as_py() for c in ("_x_min", "_y_max", "_res"))
        # Downwards becomes upwards, so shells turn against the clock as readers expect, when walked backwards.
        place = lambda r: np.stack([left + r[::-1, 0] * size, top - r[::-1, 1] * size], -1)
        geom = geo.wkb_of([[place(r) for r in p] for p in polygons(rings)])
        return pa.table([*(group.column(k).slice(0, 1) for k in keys), pa.array([len(rings)], pa.int64()), pa.array([geom], pa.binary())], [*keys, "n_rings", "geom"])

    types = dict(cells.dtypes)
    return border.groupBy(*keys).applyInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_rings long, geom binary")


def units_of(labelled: DataFrame, most_field: int, side: int, least_unit: int, most_unit: int, weight: str = "w") -> dict[str, DataFrame]:
    """Fields, tiles and ranked units of labelled cells: {labelled, fields, tiles, pseudo_units, units}."""
    table = fields(labelled, weight)
    small, _ = split_by_size(table, most_field)
    cut = tiles(labelled, most_field, side)
    parts = tile_units(cut, weight)
    return {"labelled": labelled, "fields": table, "tiles": cut, "pseudo_units": parts, "units": ranked_units(small, parts, least_unit, most_unit)}


def segmented(support: DataFrame, width: int | None = None, least_patch: int = 50, most_field: int = 3333, side: int = 47, least_unit: int = 55, most_unit: int = 5555, weight: str = "w") -> dict[str, DataFrame]:
    """Components to ranked units."""
    return units_of(sieve(components(support, width), least_patch), most_field, side, least_unit, most_unit, weight)


def area_report(support: DataFrame, labelled: DataFrame, table: DataFrame, parts: DataFrame, units: DataFrame, cell_ha: float) -> DataFrame:
    """(county_id, yr, areas in ha): support, components after the sieve, fields, tiles and ranked units, as one
    grouping over stacked sums, so that nothing is joined."""
    stage = lambda df, name, n: df.groupBy(*KEYS).agg(n.alias("cells")).select(*KEYS, F.lit(name).alias("stage"), "cells")
    names = ("support", "components", "fields", "tiles", "units")
    sums = [F.count("*"), F.count("*"), F.sum("area_cells"), F.sum("area_cells"), F.sum("area_cells")]
    stacked = [stage(df, n, s) for df, n, s in zip((support, labelled, table, parts, units), names, sums, strict=True)]
    every = stacked[0]
    for x in stacked[1:]:
        every = every.unionByName(x)
    return every.groupBy(*KEYS).agg(*[(F.coalesce(F.sum(F.when(F.col("stage") == n, F.col("cells"))), F.lit(0)) * F.lit(cell_ha)).alias(f"{n}_ha") for n in names])
