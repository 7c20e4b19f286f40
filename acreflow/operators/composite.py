"""Seasonal composites of scenes: quality masks, indices, per-pixel percentiles, medians and sums.

Scenes are rows (pixel, ts, sensor, bands...). Season and quality filters come before the one grouping by pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreflow.functions.columns import clamp, landsat_clear, landsat_reflectance, normalized_difference, scaled_1e4, sentinel2_clear

#: Native metres of a pixel by sensor.
SCALES = {"MODIS": 250, "LANDSAT": 30, "SENTINEL2": 10}
ET_SCALE = 30
LANDSAT_SENSORS = ("LT05", "LE07", "LC08", "LC09")
#: (red, near infrared) bands: older sensors number them one lower.
LANDSAT_BANDS = {"LT05": ("SR_B3", "SR_B4"), "LE07": ("SR_B3", "SR_B4"), "LC08": ("SR_B4", "SR_B5"), "LC09": ("SR_B4", "SR_B5")}


def sensor_name(sensor: str) -> str:
    """MODIS, LANDSAT or SENTINEL2 of any spelling of them."""
    name = "".join(c for c in sensor.upper() if c.isalnum())
    if name not in SCALES:
        raise ValueError(f"sensor must be one of {', '.join(SCALES)}, not {sensor}")
    return name


def in_season(scenes: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """start <= ts < end; pushed to the scan."""
    return scenes.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def in_area(scenes: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Only pixels of the area."""
    return scenes.join(cells.select(*keys).distinct(), keys, "left_semi")


def landsat_index(scenes: DataFrame, qa: str = "QA_PIXEL") -> DataFrame:
    """Adds ndvi of clear Landsat pixels, the bands chosen by sensor."""
    pick = lambda i: F.coalesce(*[F.when(F.col("sensor") == s, F.col(b[i])) for s, b in LANDSAT_BANDS.items()])
    red, nir = landsat_reflectance(pick(0)), landsat_reflectance(pick(1))
    return scenes.where(F.col("sensor").isin(*LANDSAT_SENSORS)).withColumn("ndvi", F.when(landsat_clear(F.col(qa)), normalized_difference(nir, red)))


def sentinel2_index(scenes: DataFrame, qa: str = "QA60", cloudy: str = "CLOUDY_PIXEL_PERCENTAGE", most: float = 70) -> DataFrame:
    """Adds ndvi of clear Sentinel-2 pixels of scenes that aren't too cloudy."""
    red, nir = scaled_1e4(F.col("B4")), scaled_1e4(F.col("B8"))
    return scenes.where(F.col(cloudy) < most).withColumn("ndvi", F.when(sentinel2_clear(F.col(qa)), normalized_difference(nir, red)))


def modis_collection(year: Column) -> Column:
    """Which vegetation product a year uses."""
    return F.when(year >= 2023, "MYD13Q1").otherwise("MOD13Q1")


def p90(indexed: DataFrame, keys: list[str], value: str = "ndvi") -> DataFrame:
    """Per pixel the 90th percentile within [0, 1], and how many observations it had. Exact percentiles, whose state
    is one pixel's season."""
    return indexed.groupBy(*keys).agg(F.percentile(value, F.lit(0.9)).alias(value), F.count(value).alias("n_obs")).withColumn(value, clamp(F.col(value), 0.0, 1.0))


def modis_median(scenes: DataFrame, keys: list[str], value: str = "NDVI") -> DataFrame:
    return scenes.groupBy(*keys).agg((F.median(value) * 1e-4).alias("ndvi"))


def season_sum(scenes: DataFrame, keys: list[str], value: str = "et", factor: str = "scale_factor_et") -> DataFrame:
    """Sum of monthly rasters, each by its own scale factor."""
    return scenes.groupBy(*keys).agg(F.sum(F.col(value) * F.col(factor)).alias("et"))


def on_grid(composite: DataFrame, cells: DataFrame, keys: list[str], value: str = "ndvi", empty_as_zero: bool = True) -> DataFrame:
    """The composite on all cells of a grid; a season without any scene is a constant 0 if so wanted."""
    joined = cells.select(*keys).distinct().join(composite, keys, "left")
    return joined.withColumn(value, F.coalesce(value, F.lit(0.0))) if empty_as_zero else joined.where(F.col(value).isNotNull())


def ndvi_composite(scenes: DataFrame, sensor: str, start, end, keys: list[str]) -> tuple[DataFrame, int]:
    """(composite, native metres) of a sensor's season."""
    name, season = sensor_name(sensor), in_season(scenes, start, end)
    if name == "MODIS":
        wanted = F.col("collection") == modis_collection(F.year("ts"))
        return modis_median(season.where(wanted), keys), SCALES[name]
    return p90((landsat_index if name == "LANDSAT" else sentinel2_index)(season), keys), SCALES[name]


def et_composite(scenes: DataFrame, start, end, keys: list[str]) -> tuple[DataFrame, int]:
    return season_sum(in_season(scenes, start, end), keys), ET_SCALE


def with_scale(df: DataFrame, name: Column) -> DataFrame:
    """``df`` with sensor (MODIS, LANDSAT or SENTINEL2 of any spelling; null for others) and scale_m, its native metres."""
    plain = F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")
    known = F.when(plain.isin(*SCALES), plain)
    metres = F.create_map(*(F.lit(x) for item in SCALES.items() for x in item))
    return df.withColumns({"sensor": known, "scale_m": F.when(known.isNotNull(), metres[known])})
