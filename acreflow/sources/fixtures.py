"""Rasters, statistics and scenes derived from the driver's tables, in Spark and as the SQL of their twins.

One 24 x 24 raster a county and year comes from line items, statistics from orders, scenes from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.functions.columns import albers

WIDTH = 24
CELL_HA = 0.09
CELL_M = 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(county_id, yr, cx, cy, ndvi, et, cdl, q)."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_partkey", "l_orderkey", "l_quantity", "l_discount", "l_linenumber")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    keys = [F.col("s_nationkey").alias("county_id"), F.year("l_shipdate").alias("yr"), (F.col("l_partkey") % WIDTH).cast("int").alias("cx"), (F.col("l_orderkey") % WIDTH).cast("int").alias("cy")]
    return items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(*keys).agg(
        (F.max("l_quantity") / 50).alias("ndvi"), F.max("l_discount").alias("et"), (F.min("l_linenumber") % 3).cast("int").alias("cdl"), F.max("l_quantity").cast("long").alias("q")
    )


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(county_id, yr, harvested_cells, yield_kg_ha)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("county_id"), F.year("o_orderdate").alias("yr")).agg(
        F.count("*").alias("harvested_cells"), (500 + 10 * (F.max("o_orderkey") % 300)).alias("yield_kg_ha")
    )


def stats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows a county and year, one for each order priority, as reports have them."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    keys = [F.col("c_nationkey").alias("county_id"), F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("report")]
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(*keys).agg(F.count("*").alias("harvested_cells"), F.max("o_orderkey").alias("last_key"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, pixel, ts, kind, value, k): k from the properties stands in for quality bits and a second band."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", F.col("user_id").alias("pixel"), "ts", F.col("event_type").alias("kind"), "value", k.alias("k"))


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(county_id, COUNTY, lon0, lat0): a name and a place for each nation's county."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    return n.select(k.alias("county_id"), F.concat("n_name", F.lit(" County")).alias("COUNTY"), (k * 0.5 - 104.0).alias("lon0"), (F.lit(44.0) - k * 0.375).alias("lat0"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(county_id, COUNTY, lon0, lat0, crs, x_min, y_max, res, n_rows, n_cols): each county's raster lies at its place."""
    x, y = albers(F.col("lon0"), F.col("lat0"))
    snapped = lambda v: F.round(v / CELL_M) * CELL_M
    return corners(spark, sf_dir).withColumns({"crs": F.lit(5070), "x_min": snapped(x), "y_max": snapped(y), "res": F.lit(CELL_M), "n_rows": F.lit(WIDTH), "n_cols": F.lit(WIDTH)})


PX_SQL = f"""px AS (
  SELECT s_nationkey county_id, CAST(year(l_shipdate) AS INT) yr, CAST(l_partkey % {WIDTH} AS INT) cx, CAST(l_orderkey % {WIDTH} AS INT) cy,
    max(l_quantity) / 50e0 ndvi, max(l_discount) et, CAST(min(l_linenumber) % 3 AS INT) cdl, CAST(max(l_quantity) AS BIGINT) q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4)"""
ST_SQL = """st AS (
  SELECT c_nationkey county_id, CAST(year(o_orderdate) AS INT) yr, count(*) harvested_cells, 500 + 10 * (max(o_orderkey) % 300) yield_kg_ha
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
SC_SQL = """sc AS (
  SELECT event_id, user_id pixel, ts, event_type kind, value, CAST(json_extract_string(props, '$.k') AS INT) k FROM events)"""
