"""Registered queries over the driver's tables, each with the SQL of its twin.

Sums of doubles are rounded at the end, areas stay in whole cells until then, integers are cast alike."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acreflow.functions import columns as C
from acreflow.operators import allocate, composite, cropmask, geo, segment, selection, weights, zones
from acreflow.plans import batch
from acreflow.sources import fixtures as X
from acreflow.sources import tables

KEYS = ["county_id", "yr"]
CELL = ["cx", "cy"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts[:-1]) + "\n" + parts[-1]


PX, ST, SC = X.PX_SQL, X.ST_SQL, X.SC_SQL


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Names, formats, dates ------------------------------------------------------------------------------------------

_NAMES = "(SELECT n_nationkey id, n_name || ' County' raw FROM nation UNION ALL SELECT n_nationkey + 100, '  ' || lower(n_name) || '  county' FROM nation UNION ALL SELECT n_nationkey + 200, n_name || ' County ' FROM nation)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.table(spark, sf_dir, "nation")
    forms = F.array(
        F.struct(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(" County")).alias("raw")),
        F.struct((F.col("n_nationkey") + 100).alias("id"), F.concat(F.lit("  "), F.lower("n_name"), F.lit("  county")).alias("raw")),
        F.struct((F.col("n_nationkey") + 200).alias("id"), F.concat("n_name", F.lit(" County ")).alias("raw")),
    )
    return n.select(F.inline(forms))


@query(f"SELECT id, trim(regexp_replace(upper(raw), '\\s+COUNTY$', '')) county FROM {_NAMES}")
def norm_county(spark, sf_dir):
    return _names(spark, sf_dir).select("id", C.norm_county(F.col("raw")).alias("county"))


@query(f"SELECT id, regexp_replace(regexp_replace(upper(raw), '[^A-Z0-9]+', '_', 'g'), '^_|_$', '', 'g') tag FROM {_NAMES}")
def sanitize_id(spark, sf_dir):
    return _names(spark, sf_dir).select("id", C.sanitize_id(F.col("raw")).alias("tag"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NA' ELSE format('{:,.1f}', (c_custkey * 137) / 2e0) END ha,
  CASE WHEN c_custkey % 7 = 0 THEN 'NA' ELSE printf('%.1f%%', c_custkey / 2e0) END pct FROM customer""")
def number_formats(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    known = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey"))
    return c.select("c_custkey", C.fmt_ha(known * 137 / 2).alias("ha"), C.fmt_pct(known / 2).alias("pct"))


@query(_with(ST, """SELECT DISTINCT yr, CASE WHEN yr >= 2008 THEN 'FULL' WHEN yr >= 2000 THEN 'ET_NDVI_2008mask' ELSE 'NDVI_ONLY_2008mask' END AS mode,
  greatest(yr, 2008) class_year, CAST(make_date(yr, 6, 1) AS VARCHAR) season_start, CAST(make_date(yr, 9, 30) AS VARCHAR) season_end FROM st"""))
def year_mode(spark, sf_dir):
    y = F.col("yr")
    return X.stats(spark, sf_dir).select("yr").distinct().select("yr", C.sensing_mode(y).alias("mode"), C.class_year(y).alias("class_year"), C.season_date(y, "06-01").cast("string").alias("season_start"), C.season_date(y, "09-30").cast("string").alias("season_end"))


@query(_with(ST, """SELECT county_id, yr, 'weight/COTTON/weight_' || regexp_replace(regexp_replace(upper(n_name || ' #1'), '[^A-Z0-9]+', '_', 'g'), '^_|_$', '', 'g') || '_' || yr || CASE WHEN yr % 2 = 0 THEN '_landsat' ELSE '' END || '.tif' AS key
  FROM st JOIN nation ON county_id = n_nationkey"""))
def cache_key(spark, sf_dir):
    n = X.table(spark, sf_dir, "nation")
    t = X.stats(spark, sf_dir).join(F.broadcast(n), F.col("county_id") == F.col("n_nationkey"))
    sensor = F.when(F.col("yr") % 2 == 0, "Landsat").otherwise("")
    return t.select(*KEYS, tables.cache_key("weight", F.lit("cotton"), F.concat("n_name", F.lit(" #1")), F.col("yr"), sensor).alias("key"))


@query(_with(ST, "SELECT yr + 10 AS year, CASE WHEN greatest(yr + 10, 2008) <= 2009 THEN greatest(yr + 10, 2008) ELSE -1 END file_year FROM (SELECT DISTINCT yr FROM st)"))
def class_file_year(spark, sf_dir):
    years = X.stats(spark, sf_dir).select((F.col("yr") + 10).alias("year")).distinct()
    found = tables.with_available(years, spark.createDataFrame([(2008,), (2009,)], "file_year int"))
    return found.withColumn("file_year", F.coalesce("file_year", F.lit(-1)))


# Coordinates ------------------------------------------------------------------------------------------------------


def _q_sql(sine: str) -> str:
    """The equal-area function of a latitude's sine on the ellipsoid of which ``e2`` is the squared eccentricity."""
    return f"((1 - e2) * (({sine}) / (1 - e2 * ({sine}) * ({sine})) - ln((1 - sqrt(e2) * ({sine})) / (1 + sqrt(e2) * ({sine}))) / (2 * sqrt(e2))))"


# EPSG:5070: GRS80, parallels 29.5 and 45.5, origin 23 N 96 W.
_ALBERS_SQL = f"""el0 AS (SELECT 0.00669438002290e0 e2),
el1 AS (SELECT e2, (1 - pow(sin(radians(29.5e0)), 2)) / (1 - e2 * pow(sin(radians(29.5e0)), 2)) m1, (1 - pow(sin(radians(45.5e0)), 2)) / (1 - e2 * pow(sin(radians(45.5e0)), 2)) m2,
  {_q_sql("sin(radians(29.5e0))")} q1, {_q_sql("sin(radians(45.5e0))")} q2, {_q_sql("sin(radians(23e0))")} q0, {_q_sql("1e0")} qp FROM el0),
alb AS (SELECT e2, qp, (m1 - m2) / (q2 - q1) n, m1 + (m1 - m2) / (q2 - q1) * q1 c, sqrt(m1 + (m1 - m2) / (q2 - q1) * (q1 - q0)) / ((m1 - m2) / (q2 - q1)) r0 FROM el1)"""


def _forward_sql(lon: str, lat: str) -> tuple[str, str]:
    """x and y on the equal-area plane, beside a row of ``alb``."""
    rho, theta = f"(sqrt(c - n * {_q_sql(f'sin(radians({lat}))')}) / n)", f"(radians({lon} + 96) * n)"
    return f"{rho} * sin({theta}) * 6378137e0", f"(r0 - {rho} * cos({theta})) * 6378137e0"


def _degrees_sql(source: str, name: str) -> str:
    """``name``: the rows of ``source`` with lon and lat of their x and yy, by the series of the authalic latitude and two
    Newton steps."""
    step = lambda k: f"{name}{k + 1} AS (SELECT * EXCLUDE (_f), _f + pow(1 - _e * sin(_f) * sin(_f), 2) * (_q - {_q_sql('sin(_f)').replace('e2', '_e')}) / (2 * cos(_f) * (1 - _e)) _f FROM {name}{k})"
    return f"""{name}0 AS (SELECT s.*, atan2(x / 6378137e0, alb.r0 - yy / 6378137e0) / alb.n _l, (alb.c - (pow(x / 6378137e0, 2) + pow(alb.r0 - yy / 6378137e0, 2)) * alb.n * alb.n) / alb.n _q, alb.e2 _e, alb.qp _p FROM {source} s, alb),
{name}1 AS (SELECT *, asin(_q / _p) + (_e / 3 + 31 * _e * _e / 180) * sin(2 * asin(_q / _p)) _f FROM {name}0),
{step(1)},
{step(2)},
{name} AS (SELECT * EXCLUDE (_l, _q, _e, _p, _f), degrees(_l) - 96 lon, degrees(_f) lat FROM {name}3)"""


_X0, _Y0 = _forward_sql("lon0", "lat0")
_GRIDS_SQL = f"""co AS (SELECT n_nationkey county_id, n_name || ' County' "COUNTY", n_nationkey * 0.5e0 - 104 lon0, 44e0 - n_nationkey * 0.375e0 lat0 FROM nation),
gd AS (SELECT co.*, round(({_X0}) / 30) * 30 x_min, round(({_Y0}) / 30) * 30 y_max FROM co, alb)"""


# Scenes and composites ------------------------------------------------------------------------------------------


@query(_with(SC, """SELECT event_id, (k * 4) & 184 = 0 clear, CASE WHEN (k * 4) & 184 = 0 THEN round(value * 100 * 2.75e-5 - 0.2, 9) END reflectance FROM sc"""))
def qa_mask_landsat(spark, sf_dir):
    clear = C.landsat_clear(F.col("k") * 4)
    return X.scenes(spark, sf_dir).select("event_id", clear.alias("clear"), F.when(clear, F.round(C.landsat_reflectance(F.col("value") * 100), 9)).alias("reflectance"))


@query(_with(SC, """SELECT event_id, (k * 64) & 3072 = 0 clear, CASE WHEN (k * 64) & 3072 = 0 THEN round(value * 100 * 1e-4, 9) END reflectance FROM sc"""))
def qa_mask_sentinel2(spark, sf_dir):
    clear = C.sentinel2_clear(F.col("k") * 64)
    return X.scenes(spark, sf_dir).select("event_id", clear.alias("clear"), F.when(clear, F.round(C.scaled_1e4(F.col("value") * 100), 9)).alias("reflectance"))


_SENSORS = "CASE event_id % 4 WHEN 0 THEN 'LT05' WHEN 1 THEN 'LE07' WHEN 2 THEN 'LC08' ELSE 'LC09' END"


def _landsat(spark, sf_dir) -> DataFrame:
    s = X.scenes(spark, sf_dir)
    band = lambda n: (F.floor(F.col("value") * 10) + 100 * F.col("k") + 7500 + 37 * n).cast("double")
    return s.select("event_id", "pixel", "ts", F.element_at(F.array(*map(F.lit, composite.LANDSAT_SENSORS)), (F.col("event_id") % 4 + 1).cast("int")).alias("sensor"), (F.col("k") * 4).alias("QA_PIXEL"), *[band(n).alias(f"SR_B{n}") for n in (3, 4, 5)])


_NDVI_SQL = f"""ls AS (SELECT *, {_SENSORS} sensor, floor(value * 10) + 100 * k + 7500 base FROM sc WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25'),
rn AS (SELECT *, (base + 37 * CASE WHEN sensor < 'LD' AND sensor >= 'LC' THEN 4 ELSE 3 END) * 2.75e-5 - 0.2 red, (base + 37 * CASE WHEN sensor < 'LD' AND sensor >= 'LC' THEN 5 ELSE 4 END) * 2.75e-5 - 0.2 nir FROM ls),
nd AS (SELECT *, CASE WHEN (k * 4) & 184 = 0 THEN (nir - red) / nullif(nir + red, 0) END ndvi FROM rn)"""


@query(_with(SC, _NDVI_SQL, "SELECT pixel, CASE WHEN count(ndvi) > 0 THEN round(least(greatest(quantile_cont(ndvi, 0.9), 0), 1), 9) END ndvi, count(ndvi) n_obs FROM nd GROUP BY pixel"))
def ndvi_p90(spark, sf_dir):
    found, _ = composite.ndvi_composite(_landsat(spark, sf_dir), "Landsat", "2024-01-03", "2024-01-25", ["pixel"])
    return _round(found, "ndvi", digits=9)


@query(_with(SC, "nd AS (SELECT pixel, CASE WHEN (k * 64) & 3072 = 0 THEN (b8 - b4) / nullif(b8 + b4, 0) END ndvi FROM (SELECT *, (floor(value) + 10 * k) * 1e-4 b8, (floor(value) + 100) * 1e-4 b4 FROM sc) WHERE k < 70)",
             "SELECT pixel, CASE WHEN count(ndvi) > 0 THEN round(least(greatest(quantile_cont(ndvi, 0.9), 0), 1), 9) END ndvi, count(ndvi) n_obs FROM nd GROUP BY pixel"))
def sentinel2_p90(spark, sf_dir):
    s = X.scenes(spark, sf_dir).withColumns({"B8": (F.floor("value") + 10 * F.col("k")).cast("double"), "B4": (F.floor("value") + 100).cast("double"), "QA60": F.col("k") * 64, "CLOUDY_PIXEL_PERCENTAGE": F.col("k")})
    return _round(composite.p90(composite.sentinel2_index(s), ["pixel"]), "ndvi", digits=9)


@query(_with(SC, "SELECT pixel, round(median(value) * 1e-4, 9) ndvi FROM sc WHERE kind <> 'error' GROUP BY pixel"))
def modis_median(spark, sf_dir):
    s = X.scenes(spark, sf_dir).withColumn("collection", F.when(F.col("kind") == "error", "MOD13Q1").otherwise("MYD13Q1")).withColumn("NDVI", F.col("value"))
    found, _ = composite.ndvi_composite(s, "modis", "2024-01-01", "2024-12-31", ["pixel"])
    return _round(found, "ndvi", digits=9)


@query(_with(ST, "SELECT DISTINCT yr + 28 AS year, CASE WHEN yr + 28 >= 2023 THEN 'MYD13Q1' ELSE 'MOD13Q1' END product FROM st"))
def modis_product(spark, sf_dir):
    return X.stats(spark, sf_dir).select((F.col("yr") + 28).alias("year")).distinct().withColumn("product", composite.modis_collection(F.col("year")))


@query(_with(SC, "SELECT pixel, round(sum(floor(value) * CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.25 END), 6) et FROM sc WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY pixel"))
def et_season_sum(spark, sf_dir):
    s = X.scenes(spark, sf_dir).withColumns({"et": F.floor("value").cast("double"), "scale_factor_et": F.when(F.col("k") % 2 == 0, 0.5).otherwise(0.25)})
    found, _ = composite.et_composite(s, "2024-01-05", "2024-01-20", ["pixel"])
    return _round(found, "et")


@query(_with(SC, "SELECT pixel, round(coalesce(max(value) FILTER (ts >= TIMESTAMP '2024-01-30 20:00:00'), 0), 6) ndvi FROM sc GROUP BY pixel"))
def empty_season_zero(spark, sf_dir):
    """A short season: pixels without a scene in it get zero."""
    s = X.scenes(spark, sf_dir)
    some = s.where(F.col("ts") >= F.to_timestamp(F.lit("2024-01-30 20:00:00"))).groupBy("pixel").agg(F.max("value").alias("ndvi"))
    return _round(composite.on_grid(some, s, ["pixel"]), "ndvi")


@query(_with(SC, "SELECT pixel, count(*) n_scenes, round(max(value), 6) top FROM sc WHERE pixel IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND ts >= TIMESTAMP '2024-01-10' GROUP BY pixel"))
def scenes_in_area(spark, sf_dir):
    s = X.scenes(spark, sf_dir)
    area = s.where("kind = 'purchase'").select("pixel")
    inside = composite.in_area(composite.in_season(s, "2024-01-10", "2024-12-31"), area, ["pixel"])
    return _round(inside.groupBy("pixel").agg(F.count("*").alias("n_scenes"), F.max("value").alias("top")), "top")


@query(_with(SC, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'LANDSAT' WHEN 1 THEN 'MODIS' ELSE 'SENTINEL2' END sensor, CASE event_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 250 ELSE 10 END scale_m FROM sc"))
def sensor_scales(spark, sf_dir):
    """The sensor of each scene, named in many ways, and its scale."""
    names = ["Landsat", "modis", "Sentinel-2"]
    s = X.scenes(spark, sf_dir).select("event_id", F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 3 + 1).cast("int")).alias("_name"))
    return composite.with_scale(s, F.col("_name")).drop("_name")


# Crop masks -----------------------------------------------------------------------------------------------------

_FIRST = 1996
def _crop_sql(lower: str, upper: str) -> str:
    return f"""cr AS (SELECT county_id, yr f, cx, cy FROM px WHERE cdl = 1),
fl AS (SELECT DISTINCT yr f FROM px),
wn AS (SELECT DISTINCT county_id, yr, greatest(w, {_FIRST}) f FROM (SELECT county_id, yr, unnest(CASE WHEN yr < {_FIRST} THEN [{_FIRST}, {_FIRST + 1}, {_FIRST + 2}] ELSE [yr - 1, yr, yr + 1] END) w FROM st)),
av AS (SELECT county_id, yr, count(*) n_files, bool_or(wn.f = yr AND yr >= {_FIRST}) has_exact FROM wn JOIN fl ON wn.f = fl.f GROUP BY 1, 2),
cl AS (SELECT wn.county_id, wn.yr, cx, cy, bool_or(wn.f = wn.yr AND wn.yr >= {_FIRST}) exact, count(DISTINCT wn.f) n_years FROM wn JOIN cr ON cr.county_id = wn.county_id AND cr.f = wn.f GROUP BY 1, 2, 3, 4),
ar AS (SELECT county_id, yr, count(*) FILTER (exact) e, count(*) u, count(*) FILTER (n_years = n_files) b FROM cl JOIN av USING (county_id, yr) GROUP BY 1, 2),
de AS (SELECT st.county_id, st.yr, harvested_cells planted, coalesce(e, 0) e, coalesce(u, 0) u, coalesce(b, 0) b, coalesce(n_files, 0) n_files, coalesce(has_exact, FALSE) has_exact,
  CASE WHEN has_exact THEN coalesce(e, 0) / CAST(harvested_cells AS DOUBLE) END ratio FROM st LEFT JOIN av USING (county_id, yr) LEFT JOIN ar USING (county_id, yr)),
kd AS (SELECT *, CASE WHEN n_files = 0 THEN 'failed' WHEN NOT has_exact THEN 'union' WHEN ratio < {lower} THEN 'union' WHEN ratio >= {upper} THEN 'intersect' ELSE 'exact' END kind FROM de),
mk AS (SELECT cl.* FROM cl JOIN kd USING (county_id, yr) WHERE kind = 'union' OR kind = 'exact' AND exact OR kind = 'intersect' AND n_years = n_files)"""


_CROP = _crop_sql("0.6", "2.0")


def _masks(spark, sf_dir):
    return cropmask.masks(X.stats(spark, sf_dir).withColumn("planted_cells", F.col("harvested_cells")), X.pixels(spark, sf_dir), 1, first=_FIRST)


@query(_with(PX, "SELECT county_id, yr, cx, cy FROM px WHERE cdl = 1"))
def crop_mask_exact(spark, sf_dir):
    return cropmask.crop_cells(X.pixels(spark, sf_dir), 1)


@query(_with(PX, ST, _CROP, "SELECT county_id, yr, cx, cy FROM cl"))
def crop_mask_union3(spark, sf_dir):
    return _masks(spark, sf_dir)[0].select(*KEYS, *CELL)


@query(_with(PX, ST, _CROP, "SELECT cl.county_id, cl.yr, cx, cy FROM cl JOIN av USING (county_id, yr) WHERE n_years = n_files"))
def crop_mask_intersect3(spark, sf_dir):
    return _masks(spark, sf_dir)[0].where("n_years = n_files").select(*KEYS, *CELL)


@query(_with(PX, ST, _CROP, f"""SELECT county_id, yr, e exact_cells, u union_cells, b both_cells, round(ratio, 9) ratio, kind,
  CASE kind WHEN 'failed' THEN 'failed_to_build_mask' WHEN 'exact' THEN 'exact_' || yr ELSE kind || '_' || CASE WHEN yr < {_FIRST} THEN '{_FIRST}_{_FIRST + 1}_{_FIRST + 2}' ELSE (yr - 1) || '_' || yr || '_' || (yr + 1) END END strategy,
  CASE kind WHEN 'exact' THEN e WHEN 'union' THEN u WHEN 'intersect' THEN b END mask_cells FROM kd"""))
def crop_mask_strategy(spark, sf_dir):
    return _round(_masks(spark, sf_dir)[1].drop("planted_cells"), "ratio", digits=9)


@query(_with(PX, ST, _CROP, "SELECT county_id, yr, count(*) n_cells, round(count(*) * 0.09e0, 6) area_ha FROM mk GROUP BY 1, 2"))
def mask_area(spark, sf_dir):
    return _round(cropmask.mask_area(_masks(spark, sf_dir)[0].where("chosen"), X.CELL_HA), "area_ha")


# Eligibility and weights ----------------------------------------------------------------------------------------


@query(_with(PX, "t AS (SELECT county_id, yr, round(quantile_cont(et, 0.05), 9) t FROM px GROUP BY 1, 2)", "SELECT county_id, yr, cx, cy, et, t et_q FROM px JOIN t USING (county_id, yr) WHERE et > t"))
def q05_screen(spark, sf_dir):
    return weights.screen(X.pixels(spark, sf_dir), "et").select(*KEYS, *CELL, "et", "et_q")


def _eligible_sql(cells: str, buffer: str, step: int = 1) -> str:
    levels = range(90, 9, -step)
    return f"""lv AS (SELECT unnest(range(0, {len(levels)})) i),
qs AS (SELECT county_id, yr, quantile_cont(ndvi, [{', '.join(str(v / 100) for v in levels)}]) q FROM {cells} GROUP BY 1, 2),
th AS (SELECT county_id, yr, i, round(q[i + 1], 9) threshold FROM qs CROSS JOIN lv),
ct AS (SELECT t.county_id, t.yr, i, threshold, count(*) n FROM th t JOIN {cells} c ON c.county_id = t.county_id AND c.yr = t.yr AND c.ndvi >= threshold GROUP BY 1, 2, 3, 4),
el AS (SELECT c.county_id, c.yr, min(i) i, arg_min(threshold, i) threshold, arg_min(n, i) eligible_cells FROM ct c JOIN st USING (county_id, yr) WHERE n >= harvested_cells * {buffer} OR i = {len(levels) - 1} GROUP BY 1, 2)"""


@query(_with(PX, ST, _eligible_sql("px", "1"), "SELECT county_id, yr, round(0.9 - i / 100, 2) AS level, threshold, eligible_cells FROM el"))
def ndvi_eligibility(spark, sf_dir):
    px, st = X.pixels(spark, sf_dir), X.stats(spark, sf_dir)
    return weights.eligibility(px.join(st.select(*KEYS), KEYS, "left_semi"), st)


@query(_with(PX, ST, _eligible_sql("px", "1.05e0", 2), "SELECT county_id, yr, round(0.9 - i * 2 / 100, 2) AS level, threshold, eligible_cells FROM el"))
def ndvi_eligibility_41(spark, sf_dir):
    """The search's own default: 41 levels, by two per cent."""
    px, st = X.pixels(spark, sf_dir), X.stats(spark, sf_dir)
    return weights.eligibility(px.join(st.select(*KEYS), KEYS, "left_semi"), st, buffer=0.05, step=2)


@query(_with(PX, "m AS (SELECT *, min(et) OVER w a, max(et) OVER w b FROM px WINDOW w AS (PARTITION BY county_id, yr))", "SELECT county_id, yr, cx, cy, CASE WHEN b > a THEN round(0.01e0 + (et - a) / (b - a) * (1e0 - 0.01e0), 9) END w_et FROM m"))
def minmax_weight(spark, sf_dir):
    w = Window.partitionBy(*KEYS)
    return X.pixels(spark, sf_dir).select(*KEYS, *CELL, F.round(C.minmax_over(F.col("et"), w), 9).alias("w_et"))


@query(_with(PX, """m AS (SELECT *, min(et) OVER w a, max(et) OVER w b, min(ndvi) OVER w c, max(ndvi) OVER w d FROM px WINDOW w AS (PARTITION BY county_id, yr)),
s AS (SELECT county_id, yr, cx, cy, 0.3e0 * (0.01e0 + (et - a) / nullif(b - a, 0) * 0.99e0) + 0.7e0 * (0.01e0 + (ndvi - c) / nullif(d - c, 0) * 0.99e0) weight FROM m WHERE b > a AND d > c)""",
    "SELECT county_id, yr, cx, cy, round(weight, 8) weight, round(weight / sum(weight) OVER (PARTITION BY county_id, yr), 8) w_norm FROM s"))
def blend_weight(spark, sf_dir):
    return _round(weights.surface(X.pixels(spark, sf_dir)).select(*KEYS, *CELL, "weight", "w_norm"), "weight", "w_norm", digits=8)


# Cells without a number: NaN where 7 divides 5 cx + cy, infinite where 11 divides cx + cy; none of them counts.
_GAPS = "gp AS (SELECT county_id, yr, cx, cy, CASE WHEN (5 * cx + cy) % 7 > 0 THEN ndvi END ndvi, CASE WHEN (cx + cy) % 11 > 0 THEN et END et FROM px)"


def _gaps(spark, sf_dir) -> DataFrame:
    nan, infinite = (5 * F.col("cx") + F.col("cy")) % 7 == 0, (F.col("cx") + F.col("cy")) % 11 == 0
    sign = F.when(F.col("cx") % 2 == 0, float("inf")).otherwise(float("-inf"))
    return X.pixels(spark, sf_dir).withColumns({"ndvi": F.when(nan, float("nan")).otherwise(F.col("ndvi")), "et": F.when(infinite, sign).otherwise(F.col("et"))})


@query(_with(PX, ST, _GAPS, _eligible_sql("gp", "1"), "SELECT county_id, yr, round(0.9 - i / 100, 2) AS level, threshold, eligible_cells FROM el"))
def eligibility_with_gaps(spark, sf_dir):
    st = X.stats(spark, sf_dir)
    return weights.eligibility(_gaps(spark, sf_dir).join(st.select(*KEYS), KEYS, "left_semi"), st)


@query(_with(PX, _GAPS, "t AS (SELECT county_id, yr, round(quantile_cont(et, 0.05), 9) t FROM gp GROUP BY 1, 2)", """m AS (SELECT gp.*, min(et) OVER w a, max(et) OVER w b, min(ndvi) OVER w c, max(ndvi) OVER w d FROM gp JOIN t USING (county_id, yr) WHERE et > t WINDOW w AS (PARTITION BY county_id, yr)),
s AS (SELECT county_id, yr, cx, cy, 0.3e0 * (0.01e0 + (et - a) / nullif(b - a, 0) * 0.99e0) + 0.7e0 * (0.01e0 + (ndvi - c) / nullif(d - c, 0) * 0.99e0) weight FROM m WHERE b > a AND d > c)""",
    "SELECT county_id, yr, cx, cy, round(weight, 8) weight, round(weight / sum(weight) OVER (PARTITION BY county_id, yr), 8) w_norm FROM s WHERE weight IS NOT NULL"))
def surface_with_gaps(spark, sf_dir):
    """Screened and weighed."""
    screened = weights.screen(_gaps(spark, sf_dir), "et").select(*KEYS, *CELL, "ndvi", "et")
    return _round(weights.surface(screened).select(*KEYS, *CELL, "weight", "w_norm"), "weight", "w_norm", digits=8)


_SURFACE = """q AS (SELECT county_id, yr, round(quantile_cont(ndvi, 0.05), 9) qn, round(quantile_cont(et, 0.05), 9) qe FROM px GROUP BY 1, 2),
fit AS (SELECT ins.* FROM ins JOIN el USING (county_id, yr) JOIN q USING (county_id, yr) WHERE ndvi >= threshold AND ndvi > qn AND et > qe),
m AS (SELECT *, min(et) OVER w a, max(et) OVER w b, min(ndvi) OVER w c, max(ndvi) OVER w d FROM fit WINDOW w AS (PARTITION BY county_id, yr)),
s AS (SELECT county_id, yr, cx, cy, CASE WHEN NOT d > c THEN 0.01e0 + (et - a) / (b - a) * 0.99e0 ELSE 0.3e0 * (0.01e0 + (et - a) / nullif(b - a, 0) * 0.99e0) + 0.7e0 * (0.01e0 + (ndvi - c) / (d - c) * 0.99e0) END weight FROM m WHERE b > a)"""
_INSIDE = "ins AS (SELECT px.* FROM px JOIN mk USING (county_id, yr, cx, cy))"
_WEIGHTS = [PX, ST, _CROP, _INSIDE, _eligible_sql("ins", "1.05e0"), _SURFACE]
_BATCH_WEIGHTS = [PX, ST, _crop_sql("0.5", "3.5"), _INSIDE, _eligible_sql("ins", "1.2e0"), _SURFACE]
_SINGLE = batch.WeightOptions(lower=0.6, upper=2.0, buffer=0.05, first=_FIRST)


def _rasters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Derived once, as the tables that a run would read."""
    return tables.settled(X.pixels(spark, sf_dir)), tables.settled(X.stats(spark, sf_dir))


@query(_with(*_WEIGHTS, "SELECT county_id, yr, cx, cy, round(weight, 8) weight, round(weight / sum(weight) OVER (PARTITION BY county_id, yr), 8) w_norm FROM s"))
def weight_surface(spark, sf_dir):
    out = batch.weights_batch(*_rasters(spark, sf_dir), _SINGLE)["weights"]
    return _round(out.select(*KEYS, *CELL, "weight", "w_norm"), "weight", "w_norm", digits=8)


@query(_with(*_BATCH_WEIGHTS, "SELECT county_id, yr, cx, cy, round(weight, 8) weight, round(weight / sum(weight) OVER (PARTITION BY county_id, yr), 8) w_norm FROM s"))
def weight_surface_batch(spark, sf_dir):
    """With the batch's own thresholds."""
    out = batch.weights_batch(*_rasters(spark, sf_dir), batch.WeightOptions(first=_FIRST))["weights"]
    return _round(out.select(*KEYS, *CELL, "weight", "w_norm"), "weight", "w_norm", digits=8)


@query(_with(*_BATCH_WEIGHTS, "SELECT county_id, yr, cx, cy, round(weight / sum(weight) OVER (PARTITION BY county_id, yr), 8) w_norm FROM s"))
def weights_resumed(spark, sf_dir):
    """A batch that stops after the early years and is taken up again."""
    px, st = _rasters(spark, sf_dir)
    path, options = f"{tables.shared_folder(spark)}/weights-{uuid.uuid4().hex}", batch.WeightOptions(first=_FIRST)
    batch.resume_weights(px, st.where("yr < 1996"), path, "cotton", options=options)
    batch.resume_weights(px, st, path, "cotton", options=options)
    out = batch.read_weights(spark, path, "cotton")
    if out is None:  # no county has an eligible cell
        out = px.select(*KEYS, *CELL, F.lit(None).cast("double").alias("w_norm")).limit(0)
    out = out.select(*[F.col(c).cast(t).alias(c) for c, t in px.select(*KEYS).dtypes], *CELL, "w_norm")
    return _round(out, "w_norm", digits=8)


@query(_with(*_WEIGHTS, """SELECT kd.county_id, kd.yr, CASE kind WHEN 'failed' THEN 'failed_to_build_mask' WHEN 'exact' THEN 'exact_' || kd.yr ELSE kind || '_' || CASE WHEN kd.yr < 1996 THEN '1996_1997_1998' ELSE (kd.yr - 1) || '_' || kd.yr || '_' || (kd.yr + 1) END END strategy,
  round(planted * 0.09e0, 6) harvest_area_ha, round(CASE kind WHEN 'exact' THEN e WHEN 'union' THEN u ELSE b END * 0.09e0, 6) mask_area_ha, round(eligible_cells * 0.09e0, 6) eligible_area_ha,
  round(CASE kind WHEN 'exact' THEN e WHEN 'union' THEN u ELSE b END / CAST(planted AS DOUBLE), 9) mask_over_harvest, round(eligible_cells / CAST(planted AS DOUBLE), 9) eligible_over_harvest, threshold ndvi_threshold, qn q_ndvi, qe q_et
  FROM kd LEFT JOIN el ON el.county_id = kd.county_id AND el.yr = kd.yr LEFT JOIN q ON q.county_id = kd.county_id AND q.yr = kd.yr WHERE (kd.county_id, kd.yr) IN (SELECT county_id, yr FROM px)"""))
def weight_diagnostics(spark, sf_dir):
    out = batch.weights_batch(*_rasters(spark, sf_dir), _SINGLE)["diagnostics"]
    return _round(_round(out, "harvest_area_ha", "mask_area_ha", "eligible_area_ha"), "mask_over_harvest", "eligible_over_harvest", digits=9)


# Segmentation ---------------------------------------------------------------------------------------------------

_SIEVE, _FIELD, _SIDE, _LEAST, _MOST = 2, 12, 3, 2, 40
_SUPPORT = "sp AS (SELECT px.* FROM px JOIN (SELECT county_id, yr, round(quantile_cont(ndvi, 0.4), 9) t FROM px GROUP BY 1, 2) USING (county_id, yr) WHERE ndvi >= t)"
_LABELS = f"""lab(county_id, yr, cx, cy, root) AS (
  SELECT county_id, yr, cx, cy, cx * {X.WIDTH} + cy FROM sp
  UNION
  SELECT b.county_id, b.yr, b.cx, b.cy, l.root FROM lab l JOIN sp b ON b.county_id = l.county_id AND b.yr = l.yr AND abs(b.cx - l.cx) + abs(b.cy - l.cy) = 1 WHERE l.root < b.cx * {X.WIDTH} + b.cy),
lb AS (SELECT county_id, yr, cx, cy, CAST(min(root) AS BIGINT) patch FROM lab GROUP BY ALL),
sv AS (SELECT * FROM (SELECT lb.*, q, count(*) OVER (PARTITION BY lb.county_id, lb.yr, patch) n FROM lb JOIN sp USING (county_id, yr, cx, cy)) WHERE n >= {_SIEVE})"""
_UNITS = f"""fd AS (SELECT county_id, yr, patch, count(*) area_cells, CAST(sum(q) AS BIGINT) w_sum FROM sv GROUP BY 1, 2, 3),
bx AS (SELECT *, min(cx) OVER w x0, min(cy) OVER w y0, max(cx) OVER w x1, max(cy) OVER w y1 FROM sv WINDOW w AS (PARTITION BY county_id, yr, patch)),
tl AS (SELECT county_id, yr, patch, CAST((cx - x0) // {_SIDE} AS INT) tile_i, CAST((cy - y0) // {_SIDE} AS INT) tile_j, count(*) area_cells, CAST(sum(q) AS BIGINT) w_sum FROM bx
  WHERE n > {_FIELD} AND (cx - x0) // {_SIDE} < (x1 - x0 + 1) // {_SIDE} AND (cy - y0) // {_SIDE} < (y1 - y0 + 1) // {_SIDE} GROUP BY 1, 2, 3, 4, 5),
tu AS (SELECT county_id, yr, patch, patch || '_' || row_number() OVER (PARTITION BY county_id, yr, patch ORDER BY tile_i, tile_j) unit_id, area_cells, w_sum, tile_i, tile_j FROM tl),
un AS (SELECT * FROM (SELECT county_id, yr, CAST(patch AS VARCHAR) unit_id, area_cells, w_sum FROM fd WHERE area_cells <= {_FIELD} UNION ALL SELECT county_id, yr, unit_id, area_cells, w_sum FROM tu) WHERE area_cells BETWEEN {_LEAST} AND {_MOST})"""
_OPTIONS = batch.DisaggOptions(width=X.WIDTH, least_patch=_SIEVE, most_field=_FIELD, side=_SIDE, least_unit=_LEAST, most_unit=_MOST, cluster_dist_m=200.0)


def _support(spark, sf_dir) -> DataFrame:
    px = X.pixels(spark, sf_dir)
    t = px.groupBy(*KEYS).agg(F.round(F.percentile("ndvi", F.lit(0.4)), 9).alias("t"))
    return px.join(t, KEYS).where("ndvi >= t").select(*KEYS, *CELL, F.col("q").alias("w"))


def _segmented(spark, sf_dir) -> dict[str, DataFrame]:
    o = _OPTIONS
    return segment.segmented(_support(spark, sf_dir), o.width, o.least_patch, o.most_field, o.side, o.least_unit, o.most_unit)


@query(_with(PX, _SUPPORT, _LABELS, "SELECT county_id, yr, cx, cy, patch FROM lb", recursive=True))
def components(spark, sf_dir):
    return segment.components(_support(spark, sf_dir), X.WIDTH).select(*KEYS, *CELL, "patch")


@query(_with(PX, _SUPPORT, _LABELS, "SELECT county_id, yr, cx, cy, patch FROM sv", recursive=True))
def sieve(spark, sf_dir):
    return _segmented(spark, sf_dir)["labelled"].select(*KEYS, *CELL, "patch")


@query(_with(PX, _SUPPORT, _LABELS, _UNITS, "SELECT *, round(w_sum / CAST(area_cells AS DOUBLE), 9) w_density FROM fd", recursive=True))
def zonal_fields(spark, sf_dir):
    return _round(_segmented(spark, sf_dir)["fields"], "w_density", digits=9)


@query(_with(PX, _SUPPORT, _LABELS, _UNITS, f"SELECT county_id, yr, count(*) FILTER (area_cells <= {_FIELD}) n_small, count(*) FILTER (area_cells > {_FIELD}) n_giant, CAST(coalesce(sum(area_cells) FILTER (area_cells > {_FIELD}), 0) AS BIGINT) giant_cells FROM fd GROUP BY 1, 2", recursive=True))
def split_fields(spark, sf_dir):
    f = _segmented(spark, sf_dir)["fields"]
    giant = F.col("area_cells") > _FIELD
    return f.groupBy(*KEYS).agg(F.count_if(~giant).alias("n_small"), F.count_if(giant).alias("n_giant"), F.coalesce(F.sum(F.when(giant, F.col("area_cells"))), F.lit(0)).alias("giant_cells"))


@query(_with(PX, _SUPPORT, _LABELS, _UNITS, "SELECT county_id, yr, patch patch_parent, unit_id, area_cells, w_sum, tile_i, tile_j, CAST(split_part(unit_id, '_', 2) AS BIGINT) tile_id FROM tu", recursive=True))
def fishnet_tiles(spark, sf_dir):
    return _segmented(spark, sf_dir)["pseudo_units"]


@query(_with(PX, _SUPPORT, _LABELS, "SELECT county_id, yr, patch, CAST(min(cx) AS DOUBLE) x_min, CAST(min(cy) AS DOUBLE) y_min, CAST(max(cx) + 1 AS DOUBLE) x_max, CAST(max(cy) + 1 AS DOUBLE) y_max FROM sv GROUP BY 1, 2, 3", recursive=True))
def field_boxes(spark, sf_dir):
    return geo.boxes(_segmented(spark, sf_dir)["labelled"], [*KEYS, "patch"])


@query(_with(PX, _SUPPORT, _LABELS, _UNITS, """SELECT *, round(w_sum / CAST(area_cells AS DOUBLE), 9) w_density, CAST(sum(area_cells) OVER (PARTITION BY county_id, yr ORDER BY w_sum DESC, unit_id ROWS UNBOUNDED PRECEDING) AS BIGINT) cum_cells FROM un""", recursive=True))
def all_units_ranked(spark, sf_dir):
    return _round(_segmented(spark, sf_dir)["units"], "w_density", digits=9)


@query(_with(PX, _SUPPORT, _LABELS, _UNITS, """SELECT p.county_id, p.yr, round(a * 0.09e0, 6) support_ha, round(coalesce(b, 0) * 0.09e0, 6) components_ha, round(coalesce(c, 0) * 0.09e0, 6) fields_ha, round(coalesce(d, 0) * 0.09e0, 6) tiles_ha, round(coalesce(e, 0) * 0.09e0, 6) units_ha
  FROM (SELECT county_id, yr, count(*) a FROM sp GROUP BY 1, 2) p LEFT JOIN (SELECT county_id, yr, count(*) b FROM sv GROUP BY 1, 2) q USING (county_id, yr) LEFT JOIN (SELECT county_id, yr, sum(area_cells) c FROM fd GROUP BY 1, 2) r USING (county_id, yr)
  LEFT JOIN (SELECT county_id, yr, sum(area_cells) d FROM tu GROUP BY 1, 2) t USING (county_id, yr) LEFT JOIN (SELECT county_id, yr, sum(area_cells) e FROM un GROUP BY 1, 2) v USING (county_id, yr)""", recursive=True))
def segment_areas(spark, sf_dir):
    support, parts = _support(spark, sf_dir), _segmented(spark, sf_dir)
    out = segment.area_report(support, parts["labelled"], parts["fields"], parts["pseudo_units"], parts["units"], X.CELL_HA)
    return _round(out, *(f"{n}_ha" for n in ("support", "components", "fields", "tiles", "units")))


# Regions of equal class, sieved into their largest neighbour.
_REGIONS = f"""rg(county_id, yr, cx, cy, cdl, root) AS (
  SELECT county_id, yr, cx, cy, cdl, cx * {X.WIDTH} + cy FROM px
  UNION
  SELECT b.county_id, b.yr, b.cx, b.cy, b.cdl, l.root FROM rg l JOIN px b ON b.county_id = l.county_id AND b.yr = l.yr AND b.cdl = l.cdl AND abs(b.cx - l.cx) + abs(b.cy - l.cy) = 1 WHERE l.root < b.cx * {X.WIDTH} + b.cy),
rr AS (SELECT county_id, yr, cx, cy, cdl, CAST(min(root) AS BIGINT) patch FROM rg GROUP BY ALL),
rz AS (SELECT county_id, yr, patch, any_value(cdl) cdl, count(*) n FROM rr GROUP BY 1, 2, 3),
ra AS (SELECT a.county_id, a.yr, a.patch, b.patch other, count(*) border FROM rr a JOIN rr b ON b.county_id = a.county_id AND b.yr = a.yr AND abs(b.cx - a.cx) + abs(b.cy - a.cy) = 1 AND b.patch <> a.patch GROUP BY 1, 2, 3, 4)"""
_SIEVED = f"""rb AS (SELECT ra.county_id, ra.yr, ra.patch, other, z.n >= {_SIEVE + 1} ends FROM ra JOIN rz z ON z.county_id = ra.county_id AND z.yr = ra.yr AND z.patch = other
  QUALIFY row_number() OVER (PARTITION BY ra.county_id, ra.yr, ra.patch ORDER BY z.n DESC, other) = 1),
rc(county_id, yr, patch, reach, ends, step) AS (
  SELECT rb.county_id, rb.yr, rb.patch, other, ends, 1 FROM rb JOIN rz USING (county_id, yr, patch) WHERE n < {_SIEVE + 1}
  UNION ALL
  SELECT rc.county_id, rc.yr, rc.patch, rb.other, rb.ends, step + 1 FROM rc JOIN rb ON rb.county_id = rc.county_id AND rb.yr = rc.yr AND rb.patch = rc.reach WHERE NOT rc.ends AND step < 60)"""


def _regions(spark, sf_dir) -> DataFrame:
    return segment.components(X.pixels(spark, sf_dir).select(*KEYS, *CELL, "cdl"), X.WIDTH, by="cdl")


@query(_with(PX, _REGIONS, "SELECT * FROM ra", recursive=True))
def region_borders(spark, sf_dir):
    """Which regions of a class raster touch, and along how many cells."""
    return segment.adjacency(_regions(spark, sf_dir))


@query(_with(PX, _REGIONS, _SIEVED, """SELECT rr.county_id, rr.yr, cx, cy, coalesce(z.cdl, rr.cdl) cdl, coalesce(reach, rr.patch) patch
  FROM rr LEFT JOIN rc ON rc.county_id = rr.county_id AND rc.yr = rr.yr AND rc.patch = rr.patch AND rc.ends LEFT JOIN rz z ON z.county_id = rr.county_id AND z.yr = rr.yr AND z.patch = reach""", recursive=True))  # fmt: skip
def sieve_merged(spark, sf_dir):
    """Regions of three cells or fewer join their largest neighbour."""
    return segment.sieve_into(tables.settled(_regions(spark, sf_dir)), "cdl", _SIEVE + 1)


@query(_with(PX, _SUPPORT, _LABELS, "SELECT county_id, yr, patch, cx, cy FROM sv", recursive=True))
def field_outlines(spark, sf_dir):
    """Fields dissolved to polygons, and the cells of those polygons again."""
    rings = segment.outlines(_segmented(spark, sf_dir)["labelled"], [*KEYS, "patch"], 5000.0, 9000.0, X.CELL_M)
    cells = geo.polygon_cells(rings, [*KEYS, "patch"], 5000.0, 9000.0, X.CELL_M, X.WIDTH, X.WIDTH)
    return cells.withColumnsRenamed({"row": "cy", "col": "cx"})


@query(_with(PX, _SUPPORT, _LABELS, """pr AS (SELECT a.county_id, a.yr, a.patch, count(*) n FROM sv a JOIN sv b ON b.county_id = a.county_id AND b.yr = a.yr AND b.patch = a.patch AND (b.cx - a.cx, b.cy - a.cy) IN ((1, 0), (0, 1)) GROUP BY 1, 2, 3)""",
    """SELECT county_id, yr, patch, round(any_value(sv.n) * 0.09e0, 6) area_ha, CAST((4 * any_value(sv.n) - 2 * coalesce(any_value(pr.n), 0)) * 30 AS DOUBLE) border_m FROM sv LEFT JOIN pr USING (county_id, yr, patch) GROUP BY 1, 2, 3""", recursive=True))  # fmt: skip
def field_polygons(spark, sf_dir):
    """Area and length of border of each field's polygon."""
    rings = segment.outlines(_segmented(spark, sf_dir)["labelled"], [*KEYS, "patch"], res=X.CELL_M)
    area, border = geo.measures(F.col("geom"))
    return rings.select(*KEYS, "patch", F.round(area / 1e4, 6).alias("area_ha"), F.round(border, 6).alias("border_m"))


# Selection ------------------------------------------------------------------------------------------------------

_PLAIN = "u AS (SELECT county_id, yr, CAST(cx AS VARCHAR) unit_id, count(*) a, CAST(sum(q) AS BIGINT) w FROM px GROUP BY 1, 2, 3)"
_PREFIX = """r AS (SELECT u.*, harvested_cells h, yield_kg_ha y, CAST(sum(a) OVER o AS BIGINT) cum, sum(a) OVER (PARTITION BY u.county_id, u.yr) tot, row_number() OVER o rn
  FROM u JOIN st ON st.county_id = u.county_id AND st.yr = u.yr WINDOW o AS (PARTITION BY u.county_id, u.yr ORDER BY w DESC, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT r.*, min(CASE WHEN cum >= least(h, tot) THEN rn END) OVER (PARTITION BY county_id, yr) k FROM r),
s AS (SELECT * FROM k WHERE k IS NULL OR rn < k OR (k = 1 AND rn = 1))"""
_PRUNE = """pr AS (SELECT s.*, sum(w) OVER o / CAST(sum(w) OVER (PARTITION BY county_id, yr) AS DOUBLE) cumw, row_number() OVER o n FROM s WINDOW o AS (PARTITION BY county_id, yr ORDER BY w DESC, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pk AS (SELECT pr.*, min(CASE WHEN cumw >= 0.95 THEN n END) OVER (PARTITION BY county_id, yr) kk FROM pr),
pn AS (SELECT *, w / CAST(sum(w) OVER (PARTITION BY county_id, yr) AS DOUBLE) sh FROM pk WHERE kk IS NULL OR n <= greatest(kk, 2))"""


def _plain_units(spark, sf_dir) -> DataFrame:
    u = X.pixels(spark, sf_dir).groupBy(*KEYS, F.col("cx").cast("string").alias("unit_id")).agg(F.count("*").alias("area_cells"), F.sum("q").alias("w_sum"))
    return u.join(X.stats(spark, sf_dir), KEYS)


@query(_with(PX, ST, _PLAIN, _PREFIX, "SELECT county_id, yr, unit_id, a area_cells, w w_sum, cum cum_cells, CAST(rn AS INT) rn FROM s"))
def harvest_prefix(spark, sf_dir):
    return selection.harvest_prefix(_plain_units(spark, sf_dir)).select(*KEYS, "unit_id", "area_cells", "w_sum", "cum_cells", "rn")


@query(_with(PX, ST, _PLAIN, _PREFIX, "SELECT county_id, yr, unit_id, round(w / CAST(sum(w) OVER (PARTITION BY county_id, yr) AS DOUBLE), 9) w_share FROM s"))
def harvest_renorm(spark, sf_dir):
    out = selection.renormalized(selection.harvest_prefix(_plain_units(spark, sf_dir)))
    return _round(out.select(*KEYS, "unit_id", "w_share"), "w_share", digits=9)


@query(_with(PX, ST, _PLAIN, _PREFIX, """mc AS (SELECT DISTINCT px.county_id, px.yr, px.cx + d cx, px.cy + e cy FROM px JOIN s ON s.county_id = px.county_id AND s.yr = px.yr AND unit_id = CAST(px.cx AS VARCHAR) CROSS JOIN (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) v(d, e))""",
    "SELECT county_id, yr, cx, cy, round(q / sum(q) OVER (PARTITION BY county_id, yr), 9) w_cap FROM px JOIN mc USING (county_id, yr, cx, cy)"))
def capped_surface(spark, sf_dir):
    """The weights under the harvested units and along their sides."""
    units = selection.harvest_prefix(_plain_units(spark, sf_dir)).select(*KEYS, F.col("unit_id").cast("int").alias("cx"))
    px = X.pixels(spark, sf_dir).select(*KEYS, *CELL, "q")
    members = px.join(units, [*KEYS, "cx"], "left_semi")
    return _round(selection.capped_surface(px, members, "q"), "w_cap", digits=9)


@query(_with(PX, ST, _PLAIN, _PREFIX, _PRUNE, "SELECT county_id, yr, unit_id, round(cumw, 9) cumw, round(sh, 9) w_share FROM pn"))
def prune_cumw(spark, sf_dir):
    out = selection.prune(selection.harvest_prefix(_plain_units(spark, sf_dir)))
    return _round(out.select(*KEYS, "unit_id", "cumw", "w_share"), "cumw", "w_share", digits=9)


# Allocation -----------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN c IN ('cotton', 'lint', 'upland cotton', 'winter wheat', 'wheat', 'corn', 'maize') THEN c ELSE 'other' END crop,
  CASE WHEN c IN ('cotton', 'lint', 'upland cotton') THEN 100e0 WHEN c IN ('winter wheat', 'wheat') THEN 500e0 WHEN c IN ('corn', 'maize') THEN 700e0 ELSE 100e0 END y_min,
  CASE WHEN c IN ('cotton', 'lint', 'upland cotton') THEN 4000e0 WHEN c IN ('winter wheat', 'wheat') THEN 9000e0 WHEN c IN ('corn', 'maize') THEN 16000e0 ELSE 10000e0 END y_max,
  CASE WHEN c IN ('cotton', 'lint', 'upland cotton') THEN 80e0 WHEN c IN ('winter wheat', 'wheat') THEN 400e0 WHEN c IN ('corn', 'maize') THEN 600e0 ELSE 50e0 END min_abs
  FROM (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'cotton' WHEN 1 THEN 'lint' WHEN 2 THEN 'upland cotton' WHEN 3 THEN 'winter wheat' WHEN 4 THEN 'wheat' WHEN 5 THEN 'corn' WHEN 6 THEN 'maize' ELSE 'oats' END c FROM part)""")
def crop_caps(spark, sf_dir):
    names = ["Cotton", "LINT", "Upland Cotton", "winter wheat", "Wheat", "CORN", "maize", "oats", "oats"]
    t = X.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 9 + 1).cast("int")).alias("_crop"))
    out = allocate.with_caps(t, F.col("_crop"))
    low = F.lower("_crop")
    return out.select("p_partkey", F.when(low == "oats", "other").otherwise(low).alias("crop"), "y_min", "y_max", "min_abs")


def _ready(units: DataFrame, weight: str = "w_sum") -> DataFrame:
    ha = lambda c: F.col(c) * F.lit(X.CELL_HA)
    t = units.select(*KEYS, "unit_id", ha("area_cells").alias("area_ha"), F.col(weight).alias("w_share"), ha("harvested_cells").alias("county_area_ha"), F.col("yield_kg_ha").cast("double").alias("county_yield"))
    return allocate.with_caps(t, F.lit("cotton"))


def _allocated_sql(source: str, betas: str, keys: str = "county_id, yr, beta", caps: tuple[str, str] = ("100e0", "4000e0")) -> str:
    low, high = caps
    return f"""b AS (SELECT t.*, beta, a * 0.09e0 * h / sum(a) OVER g sa, pow(CAST(w AS DOUBLE) / sum(w) OVER g, beta) wb FROM {source} t CROSS JOIN (SELECT unnest({betas}) beta) WINDOW g AS (PARTITION BY county_id, yr, beta)),
m AS (SELECT b.*, sum(wb * sa) OVER g / sum(sa) OVER g wm FROM b WINDOW g AS (PARTITION BY {keys})),
c AS (SELECT m.*, least(greatest(y * wb / wm, {low}), {high}) yc FROM m),
d AS (SELECT c.*, y / (sum(yc * sa) OVER g / sum(sa) OVER g) f FROM c WINDOW g AS (PARTITION BY {keys})),
al AS (SELECT d.*, least(greatest(yc * f, {low}), {high}) yl FROM d)"""


@query(_with(PX, ST, _PLAIN, _PREFIX, _allocated_sql("s", "[1.2e0]"), "SELECT county_id, yr, unit_id, round(sa, 6) area_ha_scaled, round(yl, 6) yield_kg_ha, round(yl * sa, 5) prod_kg FROM al"))
def yield_disagg(spark, sf_dir):
    t = _ready(selection.harvest_prefix(_plain_units(spark, sf_dir)))
    out = allocate.allocate(t, tuple(KEYS), beta=F.lit(1.2))
    return _round(_round(out.select(*KEYS, "unit_id", "area_ha_scaled", "yield_kg_ha", "prod_kg"), "area_ha_scaled", "yield_kg_ha"), "prod_kg", digits=5)


@query(_with(PX, ST, _PLAIN, _PREFIX, _allocated_sql("s", "[1.2e0]"), """SELECT county_id, yr, round(max(h) * 0.09e0, 6) nass_area_ha, round(sum(sa), 6) units_total_area_scaled_ha, CAST(max(y) AS DOUBLE) nass_yield_kg_ha, round(sum(yl * sa), 4) units_total_prod_kg,
  100e0 y_floor_used_kg_ha, 4000e0 y_ceiling_used_kg_ha, round(max(f), 8) adj_factor_applied, round(sum(yl * sa) / sum(sa), 6) area_weighted_mean_yield, round(max(h) * 0.09e0 * max(y), 4) expected_prod_kg,
  round((sum(yl * sa) / sum(sa) - max(y)) / max(y) * 100, 6) nass_deviation_pct FROM al GROUP BY 1, 2"""))
def yield_check(spark, sf_dir):
    t = _ready(selection.harvest_prefix(_plain_units(spark, sf_dir)))
    out = allocate.check(allocate.allocate(t, tuple(KEYS), beta=F.lit(1.2)), tuple(KEYS))
    out = _round(out, "nass_area_ha", "units_total_area_scaled_ha", "area_weighted_mean_yield", "nass_deviation_pct")
    return _round(_round(out, "units_total_prod_kg", "expected_prod_kg", digits=4), "adj_factor_applied", digits=8)


def _swept(spark, sf_dir, **options) -> DataFrame:
    units = selection.prune(selection.harvest_prefix(_plain_units(spark, sf_dir)))
    betas = spark.createDataFrame([(b,) for b in allocate.BETAS], "beta double")
    return allocate.allocate(_ready(units).crossJoin(F.broadcast(betas)), **options)


_BETAS = "[0.8e0, 1e0, 1.2e0, 1.4e0, 1.6e0, 1.8e0]"


@query(_with(PX, ST, _PLAIN, _PREFIX, _PRUNE, _allocated_sql("pn", _BETAS), "SELECT county_id, yr, beta, unit_id, round(yl, 6) yield_kg_ha FROM al"))
def beta_sweep(spark, sf_dir):
    return _round(_swept(spark, sf_dir).select(*KEYS, "beta", "unit_id", "yield_kg_ha"), "yield_kg_ha")


@query(_with(PX, ST, _PLAIN, _PREFIX, _PRUNE, _allocated_sql("pn", _BETAS, caps=("greatest(100e0, 0.5e0 * y)", "least(4000e0, 1.5e0 * y)")), "SELECT county_id, yr, beta, unit_id, round(yl, 6) yield_kg_ha FROM al"))
def relative_bounds(spark, sf_dir):
    out = _swept(spark, sf_dir, min_frac=0.5, max_frac=1.5)
    return _round(out.select(*KEYS, "beta", "unit_id", "yield_kg_ha"), "yield_kg_ha")


# Zones ----------------------------------------------------------------------------------------------------------

_ZONES = """zu AS (SELECT *, CAST(CAST(unit_id AS INT) // 3 AS BIGINT) cluster_id, (CAST(unit_id AS INT) + 0.5e0) * 30 x, (a + 0.5e0) * 30 yy FROM al),
zn AS (SELECT county_id, yr, beta, cluster_id, sum(x * sa) / sum(sa) x, sum(yy * sa) / sum(sa) yy, sum(sa) area, sum(yl * sa) prod, count(*) n, sum(yl * sa) / sum(sa) zy, max(y) * 0.9e0 fl FROM zu GROUP BY 1, 2, 3, 4)"""
_RANKED = _ZONES.replace("sum(x * sa) / sum(sa) x, sum(yy * sa) / sum(sa) yy, sum(sa) area", "round(sum(x * sa) / sum(sa), 6) x, round(sum(yy * sa) / sum(sa), 6) yy, round(sum(sa), 6) area")
_MERGE = """zf AS (SELECT *, zy <= fl + 1e-6 isf FROM zn),
zr AS (SELECT *, row_number() OVER (PARTITION BY county_id, yr, beta, isf ORDER BY round(area, 6) DESC, cluster_id) rk, count(*) FILTER (NOT isf) OVER (PARTITION BY county_id, yr, beta) nf FROM zf),
mv AS (SELECT county_id, yr, beta, cluster_id, target_id, distance FROM (SELECT e.*, t.cluster_id target_id, round(sqrt((e.x - t.x) * (e.x - t.x) + (e.yy - t.yy) * (e.yy - t.yy)), 6) distance,
  row_number() OVER (PARTITION BY e.county_id, e.yr, e.beta, e.cluster_id ORDER BY round(sqrt((e.x - t.x) * (e.x - t.x) + (e.yy - t.yy) * (e.yy - t.yy)), 6), t.cluster_id) o
  FROM zr e JOIN zr t ON t.county_id = e.county_id AND t.yr = e.yr AND t.beta = e.beta AND (NOT t.isf OR (t.rk <= 1 AND t.nf = 0)) WHERE e.isf AND e.rk > 1) WHERE o = 1),
sm AS (SELECT mv.county_id, mv.yr, mv.beta, target_id, sum(area) a, sum(prod) p, sum(n) n FROM mv JOIN zn ON zn.county_id = mv.county_id AND zn.yr = mv.yr AND zn.beta = mv.beta AND zn.cluster_id = mv.cluster_id GROUP BY 1, 2, 3, 4),
mg AS (SELECT zn.county_id, zn.yr, zn.beta, zn.cluster_id, area + coalesce(a, 0) area, prod + coalesce(p, 0) prod, zn.n n_units, CAST(zn.n + coalesce(sm.n, 0) AS BIGINT) n_merged, CASE WHEN a IS NULL THEN zy ELSE (prod + p) / (area + a) END zy, fl
  FROM zn LEFT JOIN sm ON sm.county_id = zn.county_id AND sm.yr = zn.yr AND sm.beta = zn.beta AND sm.target_id = zn.cluster_id WHERE (zn.county_id, zn.yr, zn.beta, zn.cluster_id) NOT IN (SELECT (county_id, yr, beta, cluster_id) FROM mv))"""


def _zones(spark, sf_dir) -> DataFrame:
    u = _swept(spark, sf_dir)
    column = F.col("unit_id").cast("int")
    cells = F.round(F.col("area_ha") / X.CELL_HA)
    u = u.withColumns({"cluster_id": F.floor(column / 3), "x": (column + 0.5) * 30, "y": (cells + 0.5) * 30})
    floors = u.groupBy(*KEYS, "beta").agg((F.max("county_yield") * 0.9).alias("floor"))
    return zones.aggregate(u).join(floors, [*KEYS, "beta"])


@query(_with(PX, ST, _PLAIN, _PREFIX, _PRUNE, _allocated_sql("pn", _BETAS), _ZONES, "SELECT county_id, yr, beta, cluster_id, round(x, 4) x, round(yy, 4) y, round(area, 8) cluster_area_ha, round(prod, 4) cluster_prod_kg, round(zy, 6) cluster_yield_kg_ha, n n_units FROM zn"))
def zone_aggregate(spark, sf_dir):
    z = _zones(spark, sf_dir).drop("floor")
    return _round(_round(_round(z, "x", "y", "cluster_prod_kg", digits=4), "cluster_area_ha", digits=8), "cluster_yield_kg_ha")


def _rankable(z: DataFrame) -> DataFrame:
    """Areas and centres that differ in their last bits would rank at random."""
    return z.withColumns({"cluster_area_ha": F.round("cluster_area_ha", 6), "x": F.round("x", 6), "y": F.round("y", 6)})


@query(_with(PX, ST, _PLAIN, _PREFIX, _PRUNE, _allocated_sql("pn", _BETAS), _RANKED, _MERGE, "SELECT county_id, yr, beta, cluster_id, target_id, round(distance, 4) distance FROM mv"))
def nearest_target(spark, sf_dir):
    return _round(zones.floor_assignments(_rankable(_zones(spark, sf_dir))), "distance", digits=4)


@query(_with(PX, ST, _PLAIN, _PREFIX, _PRUNE, _allocated_sql("pn", _BETAS), _RANKED, _MERGE,
    "SELECT county_id, yr, beta, cluster_id, round(area, 4) cluster_area_ha, round(prod, 4) cluster_prod_kg, round(zy, 5) cluster_yield_kg_ha, n_units, n_merged n_units_merged FROM mg"))
def floor_merge(spark, sf_dir):
    out = zones.merged_floors(_rankable(_zones(spark, sf_dir))).select(*KEYS, "beta", "cluster_id", "cluster_area_ha", "cluster_prod_kg", "cluster_yield_kg_ha", "n_units", "n_units_merged")
    return _round(_round(out, "cluster_area_ha", "cluster_prod_kg", digits=4), "cluster_yield_kg_ha", digits=5)


@query(_with(PX, ST, _PLAIN, _PREFIX, _PRUNE, _allocated_sql("pn", _BETAS), _ZONES, "SELECT county_id, yr, beta, count(*) FILTER (round(zy, 6) <= round(fl, 6) + 1e-6) n_floor, count(*) n_zones FROM zn GROUP BY 1, 2, 3"))
def floor_counts(spark, sf_dir):
    return zones.floor_counts(_zones(spark, sf_dir), (*KEYS, "beta"))


_LINKED = f"""u AS (SELECT county_id, yr, unit_id, area_cells a, w_sum w FROM un),
{_PREFIX},
{_PRUNE},
mem AS (SELECT county_id, yr, CAST(patch AS VARCHAR) unit_id, cx, cy FROM sv UNION ALL
  SELECT bx.county_id, bx.yr, unit_id, cx, cy FROM bx JOIN tu ON tu.county_id = bx.county_id AND tu.yr = bx.yr AND tu.patch = bx.patch AND tile_i = (cx - x0) // {_SIDE} AND tile_j = (cy - y0) // {_SIDE}),
pl AS (SELECT pn.*, x, yy FROM pn JOIN (SELECT county_id, yr, unit_id, avg((cx + 0.5e0) * 30) x, avg((cy + 0.5e0) * 30) yy FROM mem GROUP BY 1, 2, 3) USING (county_id, yr, unit_id)),
hc(step, county_id, yr, rn, x, yy, cl) AS (
  SELECT 0, county_id, yr, rn, x, yy, rn FROM pl
  UNION ALL
  SELECT step + 1, hc.county_id, hc.yr, rn, x, yy, CASE WHEN cl = c2 THEN c1 ELSE cl END FROM hc JOIN (
    SELECT county_id, yr, c1, c2 FROM (
      SELECT county_id, yr, c1, c2, row_number() OVER (PARTITION BY county_id, yr ORDER BY d, c1, c2) o FROM (
        SELECT p.county_id, p.yr, p.cl c1, q.cl c2, max(round(sqrt((p.x - q.x) * (p.x - q.x) + (p.yy - q.yy) * (p.yy - q.yy)), 6)) d
        FROM hc p JOIN hc q ON p.county_id = q.county_id AND p.yr = q.yr AND p.cl < q.cl GROUP BY 1, 2, 3, 4) WHERE d <= {_OPTIONS.cluster_dist_m!r}e0)
    WHERE o = 1) m ON m.county_id = hc.county_id AND m.yr = hc.yr),
lk AS (SELECT pl.*, CAST(dense_rank() OVER (PARTITION BY county_id, yr ORDER BY cl) AS BIGINT) cluster_id FROM pl JOIN (SELECT county_id, yr, rn, arg_max(cl, step) cl FROM hc GROUP BY 1, 2, 3) USING (county_id, yr, rn))"""


@query(_with(PX, ST, _SUPPORT, _LABELS, _UNITS, _LINKED, "SELECT county_id, yr, unit_id, a area_cells, cluster_id FROM lk", recursive=True))
def zone_linkage(spark, sf_dir):
    """Complete linkage; the SQL merges one pair of clusters of each county and year in each step."""
    o = _OPTIONS
    return batch.county_units(_support(spark, sf_dir), X.stats(spark, sf_dir), o)["placed"].select(*KEYS, "unit_id", "area_cells", "cluster_id")


# Batches, reports, geometry -------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT c_nationkey county_id, CAST(year(o_orderdate) AS INT) yr, o_orderpriority report, count(*) harvested_cells, max(o_orderkey) last_key FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY county_id, yr ORDER BY harvested_cells DESC, last_key) n FROM r) WHERE n = 1""")
def stats_argmax(spark, sf_dir):
    return tables.largest_harvest(X.stats_rows(spark, sf_dir), tuple(KEYS), "harvested_cells", "last_key")


@query(_with(PX, ST, """tg AS (SELECT DISTINCT county_id, yr + d yr FROM st CROSS JOIN (VALUES (0), (1)) v(d)),
s2 AS (SELECT county_id, yr, CASE WHEN (county_id + yr) % 5 = 0 THEN 0 ELSE harvested_cells END h, CASE WHEN (county_id + yr) % 7 = 0 THEN NULL ELSE yield_kg_ha END y FROM st WHERE (county_id + yr) % 11 <> 0)""",
    """SELECT * FROM (SELECT tg.county_id, tg.yr, CASE WHEN p.county_id IS NULL THEN 'no raster' WHEN tg.yr = 1997 AND tg.county_id < 5 THEN 'already cached' WHEN s2.county_id IS NULL THEN 'no statistics' WHEN h <= 0 OR h IS NULL THEN 'no harvested area' WHEN y IS NULL OR y <= 0 THEN 'no yield' WHEN tg.county_id % 6 = 0 THEN 'no county area' END reason
  FROM tg LEFT JOIN (SELECT DISTINCT county_id, yr FROM px) p ON p.county_id = tg.county_id AND p.yr = tg.yr LEFT JOIN s2 ON s2.county_id = tg.county_id AND s2.yr = tg.yr) WHERE reason IS NOT NULL"""))
def skip_report(spark, sf_dir):
    st, px = X.stats(spark, sf_dir), X.pixels(spark, sf_dir)
    targets = st.select("county_id", F.explode(F.array("yr", F.col("yr") + 1)).alias("yr")).distinct()
    code = F.col("county_id") + F.col("yr")
    given = st.where(code % 11 != 0).select(*KEYS, F.when(code % 5 == 0, 0).otherwise(F.col("harvested_cells")).alias("harvested_cells"), F.when(code % 7 != 0, F.col("yield_kg_ha")).alias("yield_kg_ha"))
    areas = X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("county_id")).where("county_id % 6 <> 0")
    cached = st.where("yr = 1997 and county_id < 5")
    return batch.skipped(targets, given, px, areas, cached)


@query(_with(PX, "SELECT DISTINCT cy, round(30e0 * 30e0 / 1e4, 9) flat_ha, round(30e0 * 30e0 / 1e4 / pow(cosh(cy * 200000e0 / 6378137e0), 2), 9) mercator_ha FROM px"))
def cell_area(spark, sf_dir):
    y = F.col("cy") * 200000.0
    return X.pixels(spark, sf_dir).select("cy").distinct().select("cy", F.round(C.cell_ha(30.0), 9).alias("flat_ha"), F.round(C.cell_ha(30.0, 3857, y), 9).alias("mercator_ha"))


@query(_with(PX, "SELECT DISTINCT cx, cy, round(radians(cx - 100e0) * 6378137e0, 3) x, round(ln(tan(pi() / 4 + radians(cy + 20e0) / 2)) * 6378137e0, 3) y FROM px"))
def mercator_points(spark, sf_dir):
    x, y = C.mercator(F.col("cx") - 100.0, F.col("cy") + 20.0)
    return X.pixels(spark, sf_dir).select(*CELL).distinct().select(*CELL, F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(_with(PX, _ALBERS_SQL, f"""SELECT DISTINCT cx, cy, round(sqrt(c - n * {_q_sql("sin(radians(cy + 20e0))")}) / n * sin(radians(cx - 100e0 + 96) * n) * 6378137e0, 3) x,
  round((r0 - sqrt(c - n * {_q_sql("sin(radians(cy + 20e0))")}) / n * cos(radians(cx - 100e0 + 96) * n)) * 6378137e0, 3) y, cx - 100e0 lon, cy + 20e0 lat FROM px, alb"""))
def albers_points(spark, sf_dir):
    x, y = C.albers(F.col("cx") - 100.0, F.col("cy") + 20.0)
    lon, lat = C.from_albers(F.col("_x"), F.col("_y"))
    t = X.pixels(spark, sf_dir).select(*CELL).distinct().withColumns({"_x": x, "_y": y})
    return t.select(*CELL, F.round("_x", 3).alias("x"), F.round("_y", 3).alias("y"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(_with(PX, "g AS (SELECT DISTINCT county_id, yr, x.i tx, y.i ty FROM (SELECT DISTINCT county_id, yr FROM px) CROSS JOIN (SELECT unnest(range(0, 12)) i) x CROSS JOIN (SELECT unnest(range(0, 12)) i) y)",
    "SELECT g.county_id, g.yr, CAST(tx AS INT) tx, CAST(ty AS INT) ty, ndvi FROM g JOIN px ON px.county_id = g.county_id AND px.yr = g.yr AND px.cx = tx * 2 AND px.cy = ty * 2"))
def reproject_nearest(spark, sf_dir):
    px = X.pixels(spark, sf_dir)
    source = px.select(*KEYS, F.col("cx").alias("row"), F.col("cy").alias("col"), "ndvi")
    return geo.nearest(_coarse(px), source, F.col("tx") * 2 + 0.25, F.col("ty") * 2 + 0.25, KEYS, "ndvi")


def _coarse(px: DataFrame) -> DataFrame:
    steps = lambda: F.explode(F.sequence(F.lit(0), F.lit(11)))
    return px.select(*KEYS).distinct().withColumn("tx", steps()).withColumn("ty", steps())


@query(_with(PX, """g AS (SELECT county_id, yr, CAST(x.i AS INT) tx, CAST(y.i AS INT) ty FROM (SELECT DISTINCT county_id, yr FROM px) CROSS JOIN (SELECT unnest(range(0, 12)) i) x CROSS JOIN (SELECT unnest(range(0, 12)) i) y),
k AS (SELECT g.*, tx * 2 + a r, ty * 2 + b c, CASE WHEN a = 0 THEN 0.5e0 ELSE 0.5e0 END * CASE WHEN b = 0 THEN 0.5e0 ELSE 0.5e0 END w FROM g CROSS JOIN (VALUES (0), (1)) p(a) CROSS JOIN (VALUES (0), (1)) q(b))""",
    "SELECT k.county_id, k.yr, tx, ty, round(sum(px.q * w) / sum(w), 9) q FROM k JOIN px ON px.county_id = k.county_id AND px.yr = k.yr AND px.cx = r AND px.cy = c GROUP BY 1, 2, 3, 4"))
def reproject_bilinear(spark, sf_dir):
    px = X.pixels(spark, sf_dir)
    source = px.select(*KEYS, F.col("cx").alias("row"), F.col("cy").alias("col"), F.col("q").cast("double").alias("q"))
    return _round(geo.bilinear(_coarse(px), source, F.col("tx") * 2 + 0.5, F.col("ty") * 2 + 0.5, KEYS, ["tx", "ty"], "q"), "q", digits=9)


@query(_with(PX, _SUPPORT, _LABELS, "SELECT county_id, yr, patch, round(avg((cx + 0.5e0) * 30), 4) x, round(avg((cy + 0.5e0) * 30), 4) y FROM sv GROUP BY 1, 2, 3", recursive=True))
def unit_centres(spark, sf_dir):
    cells = _segmented(spark, sf_dir)["labelled"]
    out = geo.unit_centres(cells, [*KEYS, "patch"], (F.col("cx") + 0.5) * 30, (F.col("cy") + 0.5) * 30)
    return _round(out.select(*KEYS, "patch", "x", "y"), "x", "y", digits=4)


@query("""WITH p AS (SELECT s_suppkey point_id, s_nationkey county_id, s_acctbal x, (s_suppkey * 37) % 1000 * 1e0 y FROM supplier), t AS (SELECT c_custkey site_id, c_nationkey county_id, c_acctbal sx, (c_custkey * 91) % 1000 * 1e0 sy FROM customer)
  SELECT point_id, site_id, round(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), 4) distance FROM p JOIN t USING (county_id) WHERE sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 400""")
def trial_sites_within(spark, sf_dir):
    p = X.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), F.col("s_nationkey").alias("county_id"), F.col("s_acctbal").alias("x"), ((F.col("s_suppkey") * 37) % 1000 * 1.0).alias("y"))
    t = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_nationkey").alias("county_id"), F.col("c_acctbal").alias("sx"), ((F.col("c_custkey") * 91) % 1000 * 1.0).alias("sy"))
    return _round(geo.within(p, t, 400.0, ["county_id"]).select("point_id", "site_id", "distance"), "distance", digits=4)


@query(_with(PX, ST, _SUPPORT, _LABELS, _UNITS, "u AS (SELECT county_id, yr, unit_id, area_cells a, w_sum w FROM un)", _PREFIX, _PRUNE, _allocated_sql("pn", _BETAS),
    """SELECT county_id, yr, beta, count(*) n_units, round(sum(sa), 5) area_ha, round(sum(yl * sa) / sum(sa), 5) mean_yield_kg_ha, round(max(yl), 5) top_yield_kg_ha FROM al GROUP BY 1, 2, 3""", recursive=True))  # fmt: skip
def pipeline_summary(spark, sf_dir):
    out = batch.disagg_batch(_support(spark, sf_dir), X.stats(spark, sf_dir), _OPTIONS)["yields"]
    t = out.groupBy(*KEYS, "beta").agg(F.count("*").alias("n_units"), F.sum("area_ha_scaled").alias("area_ha"), F.try_divide(F.sum("prod_kg"), F.sum("area_ha_scaled")).alias("mean_yield_kg_ha"), F.max("yield_kg_ha").alias("top_yield_kg_ha"))
    return _round(t, "area_ha", "mean_yield_kg_ha", "top_yield_kg_ha", digits=5)


_BATCH_ZONES = """zu AS (SELECT al.*, cluster_id, x, yy FROM al JOIN (SELECT county_id, yr, unit_id, cluster_id, x, yy FROM lk) USING (county_id, yr, unit_id)),
zn AS (SELECT county_id, yr, beta, cluster_id, sum(x * sa) / sum(sa) x, sum(yy * sa) / sum(sa) yy, sum(sa) area, sum(yl * sa) prod, count(*) n, sum(yl * sa) / sum(sa) zy, greatest(80e0, 0.2e0 * max(y)) fl FROM zu GROUP BY 1, 2, 3, 4)"""
# Zones' centres on their county's grid: x grows to the right from its left edge, y falls from its top.
_BACK_SQL = "zp AS (SELECT mg.*, x_min + zn.x x, y_max - zn.yy yy FROM mg JOIN zn USING (county_id, yr, beta, cluster_id) JOIN gd USING (county_id)),\n" + _degrees_sql("zp", "g")
_BATCH_SQL = (PX, ST, _SUPPORT, _LABELS, _UNITS, _LINKED, _allocated_sql("pn", _BETAS), _BATCH_ZONES, _MERGE)


@query(_with(*_BATCH_SQL, _ALBERS_SQL, _GRIDS_SQL, _BACK_SQL, """SELECT g.county_id, g.yr, beta, cluster_id, round(lon, 7) lon, round(lat, 7) lat, round(area, 8) cluster_area_ha, round(prod, 3) cluster_prod_kg, round(zy, 5) cluster_yield_kg_ha, n_units,
  round(harvested_cells * 0.09e0, 6) nass_area_ha, CAST(yield_kg_ha AS DOUBLE) nass_yield_kg_ha FROM g JOIN st ON st.county_id = g.county_id AND st.yr = g.yr""", recursive=True))
def pipeline_zones(spark, sf_dir):
    """The batch's table: zones of every county, year and beta after the floor merge, at their place on the ground."""
    out = batch.disagg_batch(_support(spark, sf_dir), X.stats(spark, sf_dir), _OPTIONS, X.grids(spark, sf_dir))
    county = out["check"].select(*KEYS, "beta", "nass_area_ha", "nass_yield_kg_ha")
    t = out["merged"].join(county, [*KEYS, "beta"])
    t = t.select(*KEYS, "beta", "cluster_id", "lon", "lat", "cluster_area_ha", "cluster_prod_kg", "cluster_yield_kg_ha", "n_units", "nass_area_ha", "nass_yield_kg_ha")
    return _round(_round(_round(_round(_round(t, "lon", "lat", digits=7), "cluster_area_ha", digits=8), "cluster_yield_kg_ha", digits=5), "cluster_prod_kg", digits=3), "nass_area_ha")


@query(_with(*_BATCH_SQL, """fc AS (SELECT county_id, yr, beta, count(*) FILTER (round(zy, 6) <= round(fl, 6) + 1e-6) floor_before, count(*) zones_before FROM zn GROUP BY 1, 2, 3),
fa AS (SELECT county_id, yr, beta, count(*) FILTER (round(zy, 6) <= round(fl, 6) + 1e-6) floor_after, count(*) zones_after FROM mg GROUP BY 1, 2, 3)""", "SELECT * FROM fc JOIN fa USING (county_id, yr, beta)", recursive=True))
def pipeline_floor_counts(spark, sf_dir):
    """Zones at the floor before and after the merge."""
    return batch.disagg_batch(_support(spark, sf_dir), X.stats(spark, sf_dir), _OPTIONS)["qa"]


# Polygons, extents, first rows ----------------------------------------------------------------------------------


def _triangles(spark, sf_dir) -> DataFrame:
    """A triangle for each nation, as WKB: (1.13, 1.31), (22.27, 2.43 + k mod 5), (3.37 + k mod 7, 21.19) from the upper left
    corner, which is (0, 24). No centre of a cell lies on an edge."""
    ring = lambda k: ((1.13, 22.69), (22.27, 21.57 - k % 5), (3.37 + k % 7, 2.81), (1.13, 22.69))
    keys = [r.n_nationkey for r in X.table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # a layer of counties
    return spark.createDataFrame([(k, struct.pack("<BIII8d", 1, 3, 1, 4, *(v for p in ring(k) for v in p))) for k in keys], "county_id long, geom binary")


_TRIANGLE_SQL = """t AS (SELECT n_nationkey county_id, n_nationkey % 5 p, n_nationkey % 7 s FROM nation),
e AS (SELECT county_id, unnest([struct_pack(ax := 1.13e0, ay := 1.31e0, bx := 22.27e0, bt := 2.43e0 + p), struct_pack(ax := 22.27e0, ay := 2.43e0 + p, bx := 3.37e0 + s, bt := 21.19e0), struct_pack(ax := 3.37e0 + s, ay := 21.19e0, bx := 1.13e0, bt := 1.31e0)]) g FROM t),
c AS (SELECT x.i row, y.i col FROM range(0, 24) x(i), range(0, 24) y(i))"""


@query(_with(_TRIANGLE_SQL, "SELECT county_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM e, c GROUP BY ALL HAVING bool_and((g.bx - g.ax) * (row + 0.5 - g.ay) - (g.bt - g.ay) * (col + 0.5 - g.ax) > 0)"))
def polygon_cells(spark, sf_dir):
    return geo.polygon_cells(_triangles(spark, sf_dir), ["county_id"], 0.0, 24.0, 1.0, 24, 24)


@query(_with(PX, _TRIANGLE_SQL, "m AS (SELECT county_id, row, col FROM e, c GROUP BY ALL HAVING bool_and((g.bx - g.ax) * (row + 0.5 - g.ay) - (g.bt - g.ay) * (col + 0.5 - g.ax) > 0))", "SELECT px.county_id, yr, cx, cy, ndvi FROM px JOIN m ON m.county_id = px.county_id AND row = cx AND col = cy"))
def pixels_in_polygons(spark, sf_dir):
    """The raster of each county masked by its polygon."""
    members = geo.polygon_cells(_triangles(spark, sf_dir), ["county_id"], 0.0, 24.0, 1.0, 24, 24).withColumnsRenamed({"row": "cx", "col": "cy"})
    return geo.in_polygon(X.pixels(spark, sf_dir), members, ["county_id", *CELL]).select(*KEYS, *CELL, "ndvi")


# Layers and rasters in degrees ----------------------------------------------------------------------------------

# A triangle in degrees for each county, in rings of (right, down) from its corner, in 1e-4 degrees.
_CORNERS = ((4, 3, 0, 1), (68, 12, 5, 1), (20, 61, 7, 3))  # right, down, modulus, step: right grows by step * (id mod modulus)


def _county_layer(spark, sf_dir) -> DataFrame:
    """(COUNTY, geom): the counties' triangles as WKB, packed where their rows are."""

    def packed(it):
        for batch in it:
            out = []
            for k, lon, lat in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
                ring = [(lon + 1e-4 * (right + step * (k % mod if mod else 0)), lat - 1e-4 * down) for right, down, mod, step in _CORNERS]
                out.append(struct.pack("<BIII8d", 1, 3, 1, 4, *(v for p in (*ring, ring[0]) for v in p)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["COUNTY", "geom"])

    return X.corners(spark, sf_dir).select("COUNTY", "county_id", "lon0", "lat0").mapInArrow(packed, "COUNTY string, geom binary")


# The straight sides in degrees, as ends (ax, ay), (bx, bt); which cells' centres lie to the same side of all three.
_LAYER_SQL = """cn AS (SELECT county_id, """ + ", ".join(f"lon0 + 1e-4 * ({r} + {s} * {f'(county_id % {m})' if m else '0'}) p{i}, lat0 - 1e-4 * {d} q{i}" for i, (r, d, m, s) in enumerate(_CORNERS)) + """ FROM gd),
lc AS (SELECT gd.county_id, r.i row, c.i col, x_min + (c.i + 0.5e0) * 30 x, y_max - (r.i + 0.5e0) * 30 yy FROM gd, range(0, 24) r(i), range(0, 24) c(i)),
""" + _degrees_sql("lc", "ld") + """,
lm AS (SELECT county_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM ld JOIN cn USING (county_id)
  WHERE (p1 - p0) * (lat - q0) < (q1 - q0) * (lon - p0) AND (p2 - p1) * (lat - q1) < (q2 - q1) * (lon - p1) AND (p0 - p2) * (lat - q2) < (q0 - q2) * (lon - p2))"""


@query(_with(_ALBERS_SQL, _GRIDS_SQL, _LAYER_SQL, "SELECT * FROM lm"))
def layer_in_degrees(spark, sf_dir):
    """Counties given in degrees, found by name, as cells of their metric grids; the SQL brings the cells to degrees."""
    g = X.grids(spark, sf_dir).select("county_id", F.regexp_replace("COUNTY", " County", "").alias("county"), "crs", "x_min", "y_max", "res", "n_rows", "n_cols")
    return geo.county_cells(_county_layer(spark, sf_dir), g, ["county_id"], 4326, touches=False, longest=0.001)


@query(_with(PX, _ALBERS_SQL, _GRIDS_SQL, _LAYER_SQL, "SELECT px.county_id, yr, cx, cy, ndvi FROM px JOIN lm ON lm.county_id = px.county_id AND col = cx AND row = cy"))
def pixels_in_layer(spark, sf_dir):
    """Every raster cut to its county, whose polygon comes in degrees."""
    members = layer_in_degrees(spark, sf_dir).select("county_id", F.col("col").alias("cx"), F.col("row").alias("cy"))
    return geo.in_polygon(X.pixels(spark, sf_dir), members, ["county_id", *CELL]).select(*KEYS, *CELL, "ndvi")


# The rasters of signals as if in degrees: cells of 0.0004 degrees from 0.0002 beyond each county's corner.
_IN_DEGREES = """tc AS (SELECT DISTINCT px.county_id, yr, r.i row, c.i col, x_min + (c.i + 0.5e0) * 30 x, y_max - (r.i + 0.5e0) * 30 yy, lon0 - 0.0002e0 sx, lat0 + 0.0002e0 sy FROM px JOIN gd USING (county_id), range(0, 24, 3) r(i), range(0, 24, 3) c(i)),
""" + _degrees_sql("tc", "td") + """,
tp AS (SELECT county_id, yr, CAST(row AS INT) AS row, CAST(col AS INT) AS col, (sy - lat) / 0.0004e0 - 0.5e0 fr, (lon - sx) / 0.0004e0 - 0.5e0 fc FROM td)"""


def _resampled(spark, sf_dir, value: str, method: str) -> DataFrame:
    """Each raster, in degrees, on every third cell each way of its county's metric template."""
    px, g = X.pixels(spark, sf_dir), X.grids(spark, sf_dir).select("county_id", "x_min", "y_max", "lon0", "lat0")
    steps = lambda: F.explode(F.sequence(F.lit(0), F.lit(X.WIDTH - 1), F.lit(3)))
    template = px.select(*KEYS).distinct().withColumn("row", steps()).withColumn("col", steps()).join(g, "county_id")
    source = px.select(*KEYS, F.col("cy").alias("row"), F.col("cx").alias("col"), F.col(value).cast("double").alias(value))
    to = geo.Grid(5070, F.col("x_min"), F.col("y_max"), X.CELL_M)
    of = geo.Grid(4326, F.col("lon0") - 0.0002, F.col("lat0") + 0.0002, 0.0004)
    return geo.resampled(template, source, to, of, KEYS, value, method)


@query(_with(PX, _ALBERS_SQL, _GRIDS_SQL, _IN_DEGREES, """SELECT tp.county_id, tp.yr, tp.row, tp.col, round(sum(q * w) / sum(w), 3) q FROM (
  SELECT county_id, yr, row, col, floor(fr) + a r, floor(fc) + b c, (CASE a WHEN 0 THEN 1 - (fr - floor(fr)) ELSE fr - floor(fr) END) * (CASE b WHEN 0 THEN 1 - (fc - floor(fc)) ELSE fc - floor(fc) END) w
  FROM tp CROSS JOIN (VALUES (0), (1)) p(a) CROSS JOIN (VALUES (0), (1)) q(b)) tp JOIN px ON px.county_id = tp.county_id AND px.yr = tp.yr AND cy = r AND cx = c WHERE w > 0 GROUP BY ALL"""))
def raster_in_degrees(spark, sf_dir):
    """Bilinear, through the inverse projection of every target cell."""
    return _round(_resampled(spark, sf_dir, "q", "bilinear"), "q", digits=3)


@query(_with(PX, _ALBERS_SQL, _GRIDS_SQL, _IN_DEGREES, "SELECT tp.county_id, tp.yr, tp.row, tp.col, cdl FROM tp JOIN px ON px.county_id = tp.county_id AND px.yr = tp.yr AND cy = floor(fr + 0.5) AND cx = floor(fc + 0.5)"))
def classes_in_degrees(spark, sf_dir):
    """Nearest, as crop classes need it."""
    return _resampled(spark, sf_dir, "cdl", "near").withColumn("cdl", F.col("cdl").cast("int"))


@query(_with(PX, _SUPPORT, _LABELS, _ALBERS_SQL, _GRIDS_SQL, "up AS (SELECT sv.*, x_min + (cx + 0.5e0) * 30 x, y_max - (cy + 0.5e0) * 30 yy FROM sv JOIN gd USING (county_id))", _degrees_sql("up", "ud"),
    "SELECT county_id, yr, patch, round(avg(x), 4) x, round(avg(yy), 4) y, round(avg(lon), 8) lon, round(avg(lat), 8) lat FROM ud GROUP BY 1, 2, 3", recursive=True))
def unit_places(spark, sf_dir):
    """Fields' centres on the ground, both ways: on the plane, and as means of their cells' degrees."""
    cells = geo.on_plane(_segmented(spark, sf_dir)["labelled"], X.grids(spark, sf_dir), KEYS)
    out = geo.unit_centres(cells, [*KEYS, "patch"], F.col("_x"), F.col("_y"))
    return _round(_round(out, "x", "y", digits=4), "lon", "lat", digits=8)


@query(_with(PX, "SELECT county_id, yr, cx, cy, ndvi FROM px WHERE cx BETWEEN 3 AND 9 AND cy BETWEEN 5 AND 20"))
def cells_in_extent(spark, sf_dir):
    return geo.in_box(X.pixels(spark, sf_dir), (3, 9), (5, 20), "cx", "cy").select(*KEYS, *CELL, "ndvi")


@query("""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY county_id, yr ORDER BY report) n FROM (
  SELECT c_nationkey county_id, CAST(year(o_orderdate) AS INT) yr, o_orderpriority report, count(*) harvested_cells, max(o_orderkey) last_key FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)) WHERE n = 1""")
def first_report(spark, sf_dir):
    return geo.first_of(X.stats_rows(spark, sf_dir), KEYS, ["report"])


@query(_with(PX, ST, _PLAIN, _PREFIX, _PRUNE, _allocated_sql("pn", _BETAS), _ZONES, "SELECT county_id, yr, beta, cluster_id, CAST(row_number() OVER (ORDER BY county_id, yr, beta, round(zy, 6) DESC, cluster_id) AS BIGINT) place FROM zn"))
def zones_in_order(spark, sf_dir):
    """Zones by falling yield, numbered as they come."""
    ordered = zones.by_yield(_round(_zones(spark, sf_dir), "cluster_yield_kg_ha"))
    return zones.numbered(ordered.select(*KEYS, "beta", "cluster_id"), "place")
