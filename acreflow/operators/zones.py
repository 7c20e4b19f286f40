"""Production zones: complete-linkage clusters of units, their sums, and the merging of floor-yield zones."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreflow.operators import stars
from acreflow.sources.tables import settled

KEYS = ("county_id", "yr")
#: Decimals to which distances are compared, so that ties don't hang on their last bits.
DECIMALS = 6


def _hull(x: np.ndarray, y: np.ndarray, at: list[int]) -> list[int]:
    """Corners of the convex hull of the points ``at``: the farthest point of a set from anywhere is one of them."""
    points = sorted({(x[i], y[i]): i for i in reversed(at)}.items())
    if len(points) < 3:
        return [i for _, i in points]
    out: list[int] = []
    for side in (points, points[::-1]):
        chain: list = []
        for p, i in side:
            while len(chain) > 1 and (chain[-1][0][0] - chain[-2][0][0]) * (p[1] - chain[-2][0][1]) - (chain[-1][0][1] - chain[-2][0][1]) * (p[0] - chain[-2][0][0]) <= 0:
                chain.pop()
            chain.append((p, i))
        out += [i for _, i in chain[:-1]]
    return out


class _Near:
    """Points in squares, which are merged into larger ones as points go: those around a place without a look at others."""

    def __init__(self, x: np.ndarray, y: np.ndarray, height: float):
        self.x, self.y, self.height = x - x.min(), y - y.min(), max(height, 1e-9)
        self.build(np.arange(len(x)))

    def build(self, at: np.ndarray) -> None:
        span = max(float(self.x[at].max(initial=0.0)), float(self.y[at].max(initial=0.0)), 1e-9)
        # About two points a square, but none larger than the height or too small to number.
        self.size = min(self.height, max(span / max(1.0, (len(at) / 2) ** 0.5), span / 1e6))
        self.across = int(span / self.size) + 2
        code = (self.x[at] / self.size).astype(np.int64) * self.across + (self.y[at] / self.size).astype(np.int64)
        order = np.argsort(code, kind="stable")
        self.at, self.code = at[order], code[order]

    def around(self, i: int, radius: float) -> np.ndarray:
        """The points of all squares that a circle around point ``i`` may meet."""
        low = np.maximum(((self.x[i] - radius) / self.size, (self.y[i] - radius) / self.size), 0).astype(np.int64)
        high = np.minimum(((self.x[i] + radius) / self.size, (self.y[i] + radius) / self.size), self.across - 1).astype(np.int64)
        columns = np.arange(low[0], high[0] + 1) * self.across
        first, last = np.searchsorted(self.code, columns + low[1]), np.searchsorted(self.code, columns + high[1], "right")
        held = last - first
        if not (n := int(held.sum())):
            return self.at[:0]
        return self.at[np.arange(n) + np.repeat(first - (np.cumsum(held) - held), held)]


def complete_linkage(x: np.ndarray, y: np.ndarray, height: float) -> np.ndarray:
    """Zone numbers from 1, by first appearance: the two clusters with the least largest distance merge as long as it is
    at most ``height``; of equal ones those with the lowest first units.

    Distances between clusters are taken between the corners of their hulls when they are needed; known ones only grow,
    so a heap of them gives the order. A cluster's nearest is sought in growing circles, whose points come from a grid:
    all corners of a cluster at a distance d lie within d of each other's. Memory is linear in the units, of which there
    may be any number."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    label = np.arange(n)  # of corners: their cluster, named by its first unit; -1 within a hull
    corners: dict[int, list[int]] = {i: [i] for i in range(n)}
    sizes = np.ones(n, np.int64)  # corners of each cluster
    parent, version = np.arange(n), [0] * n
    slack, live, stale = height + 10.0**-DECIMALS, n, 0
    index = _Near(x, y, height)

    def near(a: int) -> tuple[float, int] | None:
        """The nearest cluster behind ``a`` in order, if within the height."""
        own = corners[a]
        radius = min(slack, 2 * index.size)
        while True:
            some = index.around(own[0], radius)
            some = some[label[some] > a]
            d = np.hypot(x[some] - x[own[0]], y[some] - y[own[0]])
            for i in own[1:]:
                keep = d <= radius
                some, d = some[keep], d[keep]
                if not len(some):
                    break
                d = np.maximum(d, np.hypot(x[some] - x[i], y[some] - y[i]))
            keep = d <= radius
            some, d = some[keep], np.round(d[keep], DECIMALS)
            if len(some):
                groups, place, held = np.unique(label[some], return_inverse=True, return_counts=True)
                far = np.zeros(len(groups))
                np.maximum.at(far, place, d)
                far[held != sizes[groups]] = np.inf
                best = int(np.argmin(far))
                # Others may lie as near only if their distance rounds to the circle's edge.
                if far[best] <= min(height, radius - 10.0**-DECIMALS if radius < slack else height):
                    return float(far[best]), int(groups[best])
            if radius >= slack:
                return None
            radius = min(slack, 2 * radius)

    heap: list[tuple[float, int, int, int, int]] = []

    def look(a: int) -> None:
        if (found := near(a)) is not None:
            heapq.heappush(heap, (found[0], a, found[1], version[a], version[found[1]]))

    for i in range(n):
        look(i)
    while heap:
        _, a, b, mine, theirs = heapq.heappop(heap)
        if parent[a] != a or version[a] != mine:
            continue
        if parent[b] != b or version[b] != theirs:
            look(a)
            continue
        both = _hull(x, y, corners[a] + corners[b])
        gone = set(corners[a] + corners.pop(b)).difference(both)
        corners[a], parent[b], sizes[a] = both, a, len(both)
        label[both], label[list(gone)] = a, -1
        version[a] += 1
        stale += len(gone)
        if stale * 2 > live:
            left = np.flatnonzero(label >= 0)
            index.build(left)
            live, stale = len(left), 0
        look(a)
    for i in range(n):  # parents come before their children
        parent[i] = parent[parent[i]]
    return np.unique(parent, return_inverse=True)[1] + 1


#: Units of a county from which on it is split into parts that no zone joins, where it has such.
SPLIT = 20_000


def _parts(units: DataFrame, height: float, x: str, y: str, keys: tuple[str, ...]) -> DataFrame:
    """``units`` with _part: two units within the height of each other are in one part. Squares of the height that hold units
    are joined with their neighbours, so what moves is a row a square."""
    at = lambda c: F.floor(F.col(c) / F.lit(float(height))).cast("long")
    placed = units.withColumns({"_gx": at(x), "_gy": at(y)})
    squares = settled(placed.select(*keys, "_gx", "_gy").distinct())
    node = lambda: F.struct(*keys, "_gx", "_gy")
    beside = F.array(*[F.struct((F.col("_gx") + i).alias("_gx"), (F.col("_gy") + j).alias("_gy")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    moved = squares.select(*keys, node().alias("u"), F.inline(beside))
    roots = stars.components(moved.join(squares.select(*keys, "_gx", "_gy", node().alias("v")), [*keys, "_gx", "_gy"]).select("u", "v"))
    named = roots.select("u.*", F.col("root").alias("_root"))
    return placed.join(named, [*keys, "_gx", "_gy"], "left").withColumn("_part", F.coalesce("_root", node())).drop("_gx", "_gy", "_root")


def zoned(units: DataFrame, height: float = 10_000.0, x: str = "x", y: str = "y", keys: tuple[str, ...] = KEYS, order: str = "rn", split: bool = False) -> DataFrame:
    """``units`` with cluster_id: one group a county and year, independent of beta. Units come in their weight order.

    With ``split`` a group is a part of a county: units further apart than the height, directly and through others, never
    share a zone. The zones are the same; they are numbered over the whole county by their first units."""
    names = units.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(order, "ascending"), ("unit_id", "ascending")])
        zone = complete_linkage(group.column(x).to_numpy(), group.column(y).to_numpy(), height)
        if split:
            _, first = np.unique(zone, return_index=True)  # zones are named by their first units until all are known
            lead = group.select([order, "unit_id"]).take(pa.array(first[zone - 1]))
            return group.select(names).append_column("_order", lead.column(0)).append_column("_unit", lead.column(1))
        return group.append_column("cluster_id", pa.array(zone, pa.int64()))

    types = dict(units.dtypes)
    schema = ", ".join(f"`{n}` {t}" for n, t in units.dtypes)
    if not split:
        return units.groupBy(*keys).applyInArrow(run, f"{schema}, cluster_id long").select(*names, "cluster_id")
    parts = _parts(units, height, x, y, keys)
    led = settled(parts.groupBy(*keys, "_part").applyInArrow(run, f"{schema}, _order {types[order]}, _unit {types['unit_id']}"))
    # One row a zone, which are far fewer than units.
    number = led.select(*keys, "_order", "_unit").distinct().withColumn("cluster_id", F.row_number().over(Window.partitionBy(*keys).orderBy("_order", "_unit")).cast("long"))
    return led.join(number, [*keys, "_order", "_unit"]).select(*names, "cluster_id")


def aggregate(units: DataFrame, keys: tuple[str, ...] = ("county_id", "yr", "beta"), x: str = "x", y: str = "y") -> DataFrame:
    """(keys, cluster_id, x, y, cluster_area_ha, cluster_prod_kg, cluster_yield_kg_ha, n_units).

    The centre is the area-weighted mean of the units' centres, on the plane; degrees come after."""
    by_area = lambda c: F.try_divide(F.sum(F.col(c) * F.col("area_ha_scaled")), F.sum("area_ha_scaled"))
    t = units.groupBy(*keys, "cluster_id").agg(by_area(x).alias("x"), by_area(y).alias("y"), F.sum("area_ha_scaled").alias("cluster_area_ha"), F.sum("prod_kg").alias("cluster_prod_kg"), F.count("*").alias("n_units"))
    return t.withColumn("cluster_yield_kg_ha", F.try_divide(F.col("cluster_prod_kg"), F.col("cluster_area_ha")))


def dynamic_floor(county_yield: Column) -> Column:
    return F.greatest(F.lit(80.0), 0.2 * county_yield)


def floor_counts(zones: DataFrame, keys: tuple[str, ...], floor: str = "floor") -> DataFrame:
    at_floor = F.round("cluster_yield_kg_ha", 6) <= F.round(F.col(floor), 6) + 1e-6
    return zones.groupBy(*keys).agg(F.count_if(at_floor).alias("n_floor"), F.count("*").alias("n_zones"))


def floor_assignments(zones: DataFrame, keep: int = 1, keys: tuple[str, ...] = ("county_id", "yr", "beta"), floor: str = "floor", prefer_other: bool = True) -> DataFrame:
    """(keys, cluster_id, target_id, distance) of the floor zones beyond the ``keep`` largest: each goes to the nearest
    zone above the floor, or to the nearest kept floor zone if none is above. Ties go to the lower id."""
    is_floor = F.col("cluster_yield_kg_ha") <= F.col(floor) + 1e-6
    flagged = zones.withColumn("_floor", is_floor)
    rank = F.row_number().over(Window.partitionBy(*keys, "_floor").orderBy(F.col("cluster_area_ha").desc_nulls_last(), "cluster_id"))
    others = F.count_if(~F.col("_floor")).over(Window.partitionBy(*keys))
    flagged = flagged.withColumns({"_rank": rank, "_others": others})
    extra = flagged.where(F.col("_floor") & (F.col("_rank") > keep)).select(*keys, "cluster_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    kept_floor = F.col("_floor") & (F.col("_rank") <= keep) & ((F.col("_others") == 0) if prefer_other else F.lit(True))
    target = flagged.where(~F.col("_floor") | kept_floor).select(*keys, F.col("cluster_id").alias("target_id"), "x", "y")
    # An equality join within a county, year and beta; the least (distance, id) combines before the shuffle.
    near = F.min(F.struct(F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y")).alias("distance"), "target_id")).alias("_near")
    return extra.join(target, list(keys)).groupBy(*keys, "cluster_id").agg(near).select(*keys, "cluster_id", "_near.target_id", "_near.distance")


def merged_floors(zones: DataFrame, keep: int = 1, keys: tuple[str, ...] = ("county_id", "yr", "beta"), floor: str = "floor", prefer_other: bool = True) -> DataFrame:
    """``zones`` after the merge: targets' area and production grow, their yield is recomputed, n_units stays as it was,
    n_units_merged counts all. Targets' centres are those before the merge."""
    moves = floor_assignments(zones, keep, keys, floor, prefer_other)
    sums = zones.join(moves, [*keys, "cluster_id"]).groupBy(*keys, "target_id").agg(F.sum("cluster_area_ha").alias("_a"), F.sum("cluster_prod_kg").alias("_p"), F.sum("n_units").alias("_n"))
    stay = zones.join(moves.select(*keys, "cluster_id"), [*keys, "cluster_id"], "left_anti")
    t = stay.join(sums.withColumnRenamed("target_id", "cluster_id"), [*keys, "cluster_id"], "left")
    more = lambda c, add: F.col(c) + F.coalesce(add, F.lit(0))
    t = t.withColumns({"cluster_area_ha": more("cluster_area_ha", "_a"), "cluster_prod_kg": more("cluster_prod_kg", "_p"), "n_units_merged": more("n_units", "_n")})
    redone = F.when(F.col("_a").isNotNull(), F.try_divide(F.col("cluster_prod_kg"), F.col("cluster_area_ha"))).otherwise(F.col("cluster_yield_kg_ha"))
    return t.withColumn("cluster_yield_kg_ha", redone).drop("_a", "_p", "_n")


def by_yield(zones: DataFrame, keys: tuple[str, ...] = ("county_id", "yr", "beta")) -> DataFrame:
    """The order of presentation: within county, year and beta by falling yield. A range-partitioned sort."""
    return zones.orderBy(*keys, F.col("cluster_yield_kg_ha").desc_nulls_last(), "cluster_id")


def numbered(ordered: DataFrame, out: str) -> DataFrame:
    """``ordered`` with the place of each row from 1: rows are numbered within their range, and each range adds the rows
    before it, a row a range."""
    ranges = settled(ordered.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)}))
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranges.join(before, "_range").select(*ordered.columns, (F.col("_before") + F.col("_place") + 1).alias(out))
