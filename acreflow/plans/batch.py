"""Whole runs: weights and disaggregation of all counties and years as one plan each.

What doesn't depend on beta (segments, selection, zones) is made once, settled as a table, and joined with the betas
afterwards. Rules that skip a county and year become a table with reasons, never an abort."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.functions.columns import finite, is_finite
from acreflow.operators import allocate, cropmask, geo, segment, selection, weights, zones
from acreflow.schemas import require_columns, require_positive
from acreflow.sources.tables import exists, settled

KEYS = ("county_id", "yr")


@dataclass(frozen=True)
class WeightOptions:
    """Defaults of the batch; a single run uses lower 0.6, upper 2.0 and buffer 0.05."""

    code: int = 1
    lower: float = 0.5
    upper: float = 3.5
    buffer: float = 0.2
    a_ndvi: float = 0.7
    a_et: float = 0.3
    first: int = 2008
    cell_ha: float = 0.09
    screen_level: float = 0.05


@dataclass(frozen=True)
class DisaggOptions:
    """Sizes in cells; at 0.09 ha a cell 3333 cells are 300 ha and a side of 47 cells is that of a 200 ha tile."""

    width: int | None = None  # of the raster; by default from each county's cells
    least_patch: int = 50
    most_field: int = 3333
    side: int = 47
    least_unit: int = 55
    most_unit: int = 5555
    cluster_dist_m: float = 10_000.0
    betas: tuple[float, ...] = allocate.BETAS
    crop: str = "cotton"
    keep_weight: float = 0.95
    min_units: int = 2
    keep_floor: int = 1
    cell_ha: float = 0.09
    cell_m: float = 30.0
    min_frac: float | None = None
    max_frac: float | None = None


def skipped(targets: DataFrame, stats: DataFrame, rasters: DataFrame, areas: DataFrame | None = None, cached: DataFrame | None = None) -> DataFrame:
    """(county_id, yr, reason) of targets that can't or needn't run; the first reason that holds."""
    flag = lambda df, name: df.select(*KEYS).distinct().withColumn(name, F.lit(True))
    t = targets.select(*KEYS).join(stats.select(*KEYS, F.col("harvested_cells").cast("double").alias("_h"), F.col("yield_kg_ha").cast("double").alias("_y"), F.lit(True).alias("_stats")), list(KEYS), "left")
    t = t.join(flag(rasters, "_raster"), list(KEYS), "left")
    t = t.join(F.broadcast(areas.select("county_id").distinct().withColumn("_area", F.lit(True))), "county_id", "left") if areas is not None else t.withColumn("_area", F.lit(True))
    t = t.join(flag(cached, "_cached"), list(KEYS), "left") if cached is not None else t.withColumn("_cached", F.lit(None).cast("boolean"))
    reason = (
        F.when(F.col("_raster").isNull(), "no raster").when(F.col("_cached").isNotNull(), "already cached").when(F.col("_stats").isNull(), "no statistics")
        .when(~is_finite(F.col("_h")) | (F.col("_h") <= 0), "no harvested area").when(~is_finite(F.col("_y")) | (F.col("_y") <= 0), "no yield").when(F.col("_area").isNull(), "no county area")
    )
    return t.withColumn("reason", reason).where("reason is not null").select(*KEYS, "reason")


class Outputs(Mapping):
    """Named results of a batch, each made when it is asked for first: what isn't asked for costs nothing."""

    def __init__(self, **make):
        self._make, self._made = make, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make[name](self)
        return self._made[name]

    def __iter__(self):
        return iter(self._make)

    def __len__(self) -> int:
        return len(self._make)


def weights_batch(pixels: DataFrame, stats: DataFrame, options: WeightOptions = WeightOptions(), cached: DataFrame | None = None) -> Outputs:
    """{weights, mask, decisions, eligibility, diagnostics, skipped} for every county and year with statistics, made as they
    are asked for.

    pixels: (county_id, yr, cx, cy, ndvi, et, cdl); stats: (county_id, yr, harvested_cells, yield_kg_ha[, planted_cells]);
    cached: the keys that a cache has already, which are skipped. The cells of the mask are settled once, since
    thresholds, ranges and sums read them; tables of a row a county and year are as well."""
    require_columns(pixels, [*KEYS, "cx", "cy", "ndvi", "et", "cdl"], "pixels")
    require_columns(stats, [*KEYS, "harvested_cells", "yield_kg_ha"], "statistics")
    out = skipped(pixels.select(*KEYS).distinct().unionByName(stats.select(*KEYS)).distinct(), stats, pixels, cached=cached)
    planted = "planted_cells" if "planted_cells" in stats.columns else "harvested_cells"
    targets = stats.join(out, list(KEYS), "left_anti").select(*KEYS, "harvested_cells", F.col(planted).alias("planted_cells"))

    def screens(o: Outputs) -> DataFrame:
        own = pixels.join(targets.select(*KEYS), list(KEYS), "left_semi")
        q = [weights.quantile(own, c, options.screen_level).withColumnRenamed(f"{c}_q", f"q_{c}") for c in ("ndvi", "et")]
        return settled(q[0].join(q[1], list(KEYS), "full"))

    def surface(o: Outputs) -> DataFrame:
        signal = lambda c: finite(F.col(c).cast("double"))
        fit = weights.eligible(o["_inside"], o["eligibility"]).join(o["_screens"], list(KEYS)).where((signal("ndvi") > F.col("q_ndvi")) & (F.col("q_et").isNull() | (signal("et") > F.col("q_et"))))
        return weights.surface(settled(fit.select(*KEYS, "cx", "cy", "ndvi", "et")), options.a_et, options.a_ndvi, F.col("yr") <= 1999 if options.first == 2008 else None)

    return Outputs(
        _targets=lambda o: targets.select(*KEYS),
        _masks=lambda o: cropmask.masks(targets, pixels, options.code, options.lower, options.upper, first=options.first),
        _inside=lambda o: settled(pixels.join(o["_masks"][0].where("chosen").select(*KEYS, "cx", "cy"), [*KEYS, "cx", "cy"]).select(*KEYS, "cx", "cy", "ndvi", "et")),
        _screens=screens,
        weights=surface,
        mask=lambda o: o["_inside"].select(*KEYS, "cx", "cy"),
        decisions=lambda o: settled(o["_masks"][1]),
        eligibility=lambda o: settled(weights.eligibility(o["_inside"], targets, buffer=options.buffer)),
        diagnostics=lambda o: weights.diagnostics(o["decisions"], o["eligibility"], o["_screens"], targets, options.cell_ha),
        skipped=lambda o: out,
    )


# The batch that writes, skips and resumes -----------------------------------------------------------------------


def _stored(spark: SparkSession, path: str, crop: str, sensor: str) -> DataFrame | None:
    """What is stored of a crop and sensor, if anything is. A folder that was written without rows holds no partition, and
    no schema either."""
    if not exists(spark, path, "crop=*"):
        return None
    # An empty name of a partition comes back as null.
    return spark.read.parquet(path).where((F.col("crop") == crop) & (F.coalesce("sensor", F.lit("")) == sensor)).drop("crop", "sensor")


def finished(spark: SparkSession, path: str, crop: str, sensor: str = "") -> DataFrame:
    """(county_id, yr, n_cells) of the counties and years that the cache at ``path`` has whole: marked as finished, and
    their weights there, where there are any."""
    marks, held = _stored(spark, f"{path}/finished", crop, sensor), _stored(spark, f"{path}/weights", crop, sensor)
    if marks is None:
        return spark.createDataFrame([], "county_id long, yr int, n_cells long")
    there = F.lit(False) if held is None else F.col("_there")
    joined = marks if held is None else marks.join(held.select(*KEYS).distinct().withColumn("_there", F.lit(True)), list(KEYS), "left")
    return joined.where((F.col("n_cells") == 0) | there).select(F.col("county_id").cast("long").alias("county_id"), F.col("yr").cast("int").alias("yr"), "n_cells")


def read_weights(spark: SparkSession, path: str, crop: str, sensor: str = "") -> DataFrame | None:
    """(county_id, yr, cx, cy, ndvi, et, weight, w_norm) of the finished counties and years; None if none is stored."""
    held = _stored(spark, f"{path}/weights", crop, sensor)
    return held if held is None else held.join(finished(spark, path, crop, sensor).select(*KEYS), list(KEYS), "left_semi")


def resume_weights(pixels: DataFrame, stats: DataFrame, path: str, crop: str, sensor: str = "", options: WeightOptions = WeightOptions()) -> DataFrame:
    """Computes and stores the weights of every county and year that the cache at ``path`` lacks, and returns what was skipped
    (county_id, yr, reason), finished ones included.

    Weights are written first, each county and year over its own partition; then their marks. A run that dies in between
    leaves unmarked partitions, which the next run replaces, so it takes up where the last one ended. Nothing is
    computed where nothing is lacking; where a partition or its mark was deleted, that county and year alone is. A county and
    year without eligible cells is marked with none."""
    spark = pixels.sparkSession
    out = weights_batch(pixels, stats, options, settled(finished(spark, path, crop, sensor).select(*KEYS)))
    skips = settled(out["skipped"])
    targets = settled(out["_targets"])
    if targets.isEmpty():
        return skips
    parts = ("crop", "sensor", "yr", "county_id")

    def store(rows: DataFrame, name: str) -> None:
        named = rows.withColumns({"crop": F.lit(crop), "sensor": F.lit(sensor)})
        named.repartition(*KEYS).sortWithinPartitions(*KEYS, *(c for c in ("cy", "cx") if c in rows.columns)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/{name}")

    kept = out["weights"].select(*KEYS, "cx", "cy", "ndvi", "et", "weight", "w_norm")
    store(kept, "weights")
    held = _stored(spark, f"{path}/weights", crop, sensor)
    counts = targets.withColumn("n_cells", F.lit(0).cast("long"))
    if held is not None:
        counts = targets.join(held.groupBy(*KEYS).agg(F.count("*").alias("n_cells")), list(KEYS), "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))
    store(counts, "finished")
    return skips


def county_units(support: DataFrame, stats: DataFrame, options: DisaggOptions, weight: str = "w", grids: DataFrame | None = None) -> Outputs:
    """The beta-free part: segments, harvest prefix, pruning, centres and zones of units. With ``grids`` (see
    ``geo.on_plane``) units have their place on the ground; without, one on their own raster, and no degrees."""

    def placed(o: Outputs) -> DataFrame:
        members = segment.membership(o["labelled"], o["tiles"], o["pseudo_units"])
        own = members.join(o["pruned"].select(*KEYS, "unit_id"), [*KEYS, "unit_id"], "left_semi")
        if grids is None:
            local = own.withColumns({"_x": (F.col("cx") + 0.5) * options.cell_m, "_y": -(F.col("cy") + 0.5) * options.cell_m})
            centres = geo.unit_centres(local, [*KEYS, "unit_id"], F.col("_x"), F.col("_y")).withColumns({"lon": F.lit(None).cast("double"), "lat": F.lit(None).cast("double")})
        else:
            centres = geo.unit_centres(geo.on_plane(own, grids, list(KEYS)), [*KEYS, "unit_id"], F.col("_x"), F.col("_y"))
        most = o["pruned"].groupBy(*KEYS).count().agg(F.max("count")).first()[0]
        return settled(zones.zoned(o["pruned"].join(centres, [*KEYS, "unit_id"]), options.cluster_dist_m, split=(most or 0) > zones.SPLIT))

    def part(name: str):
        return lambda o: o["_parts"][name]

    return Outputs(
        labelled=lambda o: settled(segment.sieve(segment.components(support, options.width), options.least_patch)),
        _parts=lambda o: segment.units_of(o["labelled"], options.most_field, options.side, options.least_unit, options.most_unit, weight),
        fields=part("fields"), tiles=part("tiles"), pseudo_units=part("pseudo_units"), all_units=part("units"),
        harvest=lambda o: selection.harvest_prefix(o["all_units"].join(stats.select(*KEYS, "harvested_cells", "yield_kg_ha"), list(KEYS))),
        pruned=lambda o: settled(selection.prune(o["harvest"], options.keep_weight, options.min_units)),
        placed=placed,
    )


def disagg_batch(support: DataFrame, stats: DataFrame, options: DisaggOptions = DisaggOptions(), grids: DataFrame | None = None) -> Outputs:
    """{yields, units, check, zones, merged, qa, skipped, ...} for all counties, years and betas, made as they are asked for.

    support: weight cells (county_id, yr, cx, cy, w). grids: where each raster lies (county_id[, yr], crs, x_min, y_max,
    res); without them lon and lat are null, since a cell's number tells no place; a county that they lack has its
    reason in skipped. yields are the units without their places and zones, which need no geometry; units have both.
    Units are settled once, since check, zones and merge read them."""
    require_columns(support, [*KEYS, "cx", "cy", "w"], "weights")
    require_positive(cluster_dist_m=options.cluster_dist_m, cell_ha=options.cell_ha)
    out = skipped(stats, stats, support)
    if grids is not None:
        require_columns(grids, ["county_id", *geo.GRID], "grids")
        own = [k for k in KEYS if k in grids.columns]
        lost = stats.join(grids, own, "left_anti").select(*KEYS, F.lit("no grid").alias("reason"))
        out = out.unionByName(lost.join(out, list(KEYS), "left_anti"))
    stats = stats.join(out, list(KEYS), "left_anti")
    parts = county_units(support, stats, options, grids=grids)
    degrees = geo.zone_degrees if grids is not None else lambda z: z.withColumns({"lon": F.lit(None).cast("double"), "lat": F.lit(None).cast("double")})
    group = (*KEYS, "beta")

    def allocated(units: DataFrame) -> DataFrame:
        betas = F.broadcast(support.sparkSession.createDataFrame([(float(b),) for b in options.betas], "beta double"))  # a handful
        rows = units.withColumns({"area_ha": F.col("area_cells") * F.lit(options.cell_ha), "county_area_ha": F.col("harvested_cells") * F.lit(options.cell_ha), "county_yield": F.col("yield_kg_ha").cast("double")}).drop("yield_kg_ha")
        return allocate.allocate(allocate.with_caps(rows.crossJoin(betas), F.lit(options.crop)), min_frac=options.min_frac, max_frac=options.max_frac)

    def zone(o: Outputs) -> DataFrame:
        floors = o["units"].groupBy(*group).agg(zones.dynamic_floor(F.first("county_yield")).alias("floor"))
        return settled(degrees(zones.aggregate(o["units"], group)).join(floors, list(group)))

    def qa(o: Outputs) -> DataFrame:
        before, after = zones.floor_counts(o["zones"], group), zones.floor_counts(o["merged"], group)
        return before.withColumnsRenamed({"n_floor": "floor_before", "n_zones": "zones_before"}).join(after.withColumnsRenamed({"n_floor": "floor_after", "n_zones": "zones_after"}), list(group))

    return Outputs(
        **{name: lambda o, name=name: parts[name] for name in parts},
        skipped=lambda o: out,
        yields=lambda o: allocated(parts["pruned"]),
        units=lambda o: settled(allocated(parts["placed"])),
        check=lambda o: allocate.check(o["units"], group),
        zones=zone,
        merged=lambda o: degrees(zones.merged_floors(o["zones"], options.keep_floor, group)),
        qa=qa,
    )
