"""County yield to units: shares to a power, capped, recentred, capped again; and the check of what came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acreflow.functions.columns import clamp, is_finite, power_weight, weighted_mean_over

# Crop aliases and their caps (y_min, y_max, min_abs) in kg/ha.
CAPS = (
    (("cotton", "lint", "upland cotton"), (100.0, 4000.0, 80.0)),
    (("winter wheat", "wheat"), (500.0, 9000.0, 400.0)),
    (("corn", "maize"), (700.0, 16000.0, 600.0)),
)
OTHER_CAPS = (100.0, 10000.0, 50.0)
BETAS = (0.8, 1.0, 1.2, 1.4, 1.6, 1.8)


def crop_caps(spark: SparkSession) -> DataFrame:
    """(alias, y_min, y_max, min_abs): a table of fixed size."""
    return spark.createDataFrame([(a, *caps) for aliases, caps in CAPS for a in aliases], "alias string, y_min double, y_max double, min_abs double")


def with_caps(df: DataFrame, crop: Column) -> DataFrame:
    """Adds the crop's caps, the general ones for other crops."""
    known = F.broadcast(crop_caps(df.sparkSession))
    names = ("y_min", "y_max", "min_abs")
    return df.join(known, F.lower(crop) == F.col("alias"), "left").withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip(names, OTHER_CAPS, strict=True)}).drop("alias")


def bounds(county_yield: Column, y_min: Column, y_max: Column, min_abs: Column, min_frac: float | None = None, max_frac: float | None = None) -> tuple[Column, Column]:
    """(floor, ceiling): a floor above the ceiling gives way to it."""
    floors = [y_min, min_abs] + ([county_yield * min_frac] if min_frac is not None else [])
    ceilings = [y_max] + ([county_yield * max_frac] if max_frac is not None else [])
    ceiling = F.least(*ceilings) if len(ceilings) > 1 else ceilings[0]
    floor = F.greatest(*floors)
    return F.when(floor > ceiling, ceiling).otherwise(floor), ceiling


def allocate(
    units: DataFrame, group: tuple[str, ...] = ("county_id", "yr", "beta"), area: str = "area_ha", weight: str = "w_share", county_area: str = "county_area_ha",
    county_yield: str = "county_yield", beta: Column | None = None, min_frac: float | None = None, max_frac: float | None = None,
) -> DataFrame:
    """Adds area_ha_scaled, yield_kg_ha, prod_kg, y_floor, y_ceiling and factor.

    units: rows with group, area, weight, the county's area and yield, and y_min, y_max, min_abs. All windows are
    unordered and share one partitioning, so Spark plans a single exchange."""
    w = Window.partitionBy(*group)
    target = F.col(county_yield).cast("double")
    floor, ceiling = bounds(target, F.col("y_min"), F.col("y_max"), F.col("min_abs"), min_frac, max_frac)
    t = units.withColumn("area_ha_scaled", F.col(area) * F.try_divide(F.col(county_area).cast("double"), F.sum(area).over(w)))
    t = t.withColumns({"y_floor": floor, "y_ceiling": ceiling, "_wb": power_weight(F.col(weight).cast("double"), beta if beta is not None else F.col("beta"))})
    t = t.withColumn("_raw", target * F.try_divide(F.col("_wb"), weighted_mean_over(F.col("_wb"), F.col("area_ha_scaled"), w)))
    t = t.withColumn("_capped", clamp(F.col("_raw"), F.col("y_floor"), F.col("y_ceiling")))
    mean = weighted_mean_over(F.col("_capped"), F.col("area_ha_scaled"), w)
    t = t.withColumn("_mean", mean).withColumn("factor", F.when(is_finite(F.col("_mean")) & (F.col("_mean") > 0), target / F.col("_mean")).otherwise(F.lit(1.0)))
    t = t.withColumn("yield_kg_ha", clamp(F.col("_capped") * F.col("factor"), F.col("y_floor"), F.col("y_ceiling")))
    return t.withColumn("prod_kg", F.col("yield_kg_ha") * F.col("area_ha_scaled")).drop("_wb", "_raw", "_capped", "_mean")


def check(allocated: DataFrame, group: tuple[str, ...] = ("county_id", "yr", "beta"), county_area: str = "county_area_ha", county_yield: str = "county_yield") -> DataFrame:
    """One row a group: totals, area-weighted mean and its deviation from the county's yield in per cent."""
    first = lambda c: F.first(c).cast("double")  # noqa: E731  the same in all rows of a group
    t = allocated.groupBy(*group).agg(
        first(county_area).alias("nass_area_ha"), F.sum("area_ha_scaled").alias("units_total_area_scaled_ha"), first(county_yield).alias("nass_yield_kg_ha"),
        F.sum("prod_kg").alias("units_total_prod_kg"), first("y_floor").alias("y_floor_used_kg_ha"), first("y_ceiling").alias("y_ceiling_used_kg_ha"), first("factor").alias("adj_factor_applied"),
    )
    mean = F.try_divide(F.col("units_total_prod_kg"), F.col("units_total_area_scaled_ha"))
    t = t.withColumn("area_weighted_mean_yield", mean).withColumn("expected_prod_kg", F.col("nass_area_ha") * F.col("nass_yield_kg_ha"))
    return t.withColumn("nass_deviation_pct", F.try_divide(F.col("area_weighted_mean_yield") - F.col("nass_yield_kg_ha"), F.col("nass_yield_kg_ha")) * 100)
