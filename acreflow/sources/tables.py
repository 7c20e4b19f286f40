"""Readers and writers: statistics, county layers, crop-class and signal rasters as pixel tables, the weight cache."""

from __future__ import annotations

import sqlite3
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.functions.columns import FIRST_CLASS_YEAR, class_year, norm_county, sanitize_id
from acreflow.schemas import STATS, require_columns

KINDS = ("ndvi", "et", "weight")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Official statistics from CSV, county names normalised. No schema inference."""
    return spark.read.schema(STATS).csv(path, header=True).withColumn("county", norm_county(F.col("county")))


def largest_harvest(stats: DataFrame, keys: tuple[str, ...] = ("county", "year"), area: str = "area_harvested_ha", tie: str | None = None) -> DataFrame:
    """The row of the largest area of each key; of equal ones the first by ``tie`` (an ordinal), else by all columns.

    A struct maximum instead of a window: it combines before the shuffle and needs no sort."""
    rest = [c for c in stats.columns if c not in keys]
    order = [F.coalesce(F.when(~F.isnan(F.col(area).cast("double")), F.col(area)).cast("double"), F.lit(float("-inf"))).alias("_area")]
    order += [(-F.col(tie)).alias("_tie")] if tie else []
    best = F.max(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_best")
    return stats.groupBy(*keys).agg(best).select(*keys, "_best._row.*").select(stats.columns)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """A pixel table; filters on its partition columns and cells are pushed down by Parquet."""
    return spark.read.parquet(path)


def decode_tiffs(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """Pixel rows of raster files that ``decode(bytes)`` turns into Arrow batches, as ``geotiff.pixels`` does."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for content in batch.column(0).to_pylist():
                yield from decode(content)

    return files.mapInArrow(run, schema)


def read_geopackage(spark: SparkSession, path: str, layer: str, columns: list[str]) -> DataFrame:
    """A local GeoPackage layer (an SQLite table), its geometries as WKB. Layers of counties are small by nature: one row
    a county."""
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute(f"SELECT {', '.join(map(quoted, columns))}, geom FROM {quoted(layer)}").fetchall()
    rows = [(*r[:-1], _wkb(r[-1])) for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns) + ", geom binary")


def _wkb(blob: bytes | None) -> bytes | None:
    """A GeoPackage geometry without its header; other blobs stay."""
    if blob is None or len(blob) < 8 or blob[:2] != b"GP":
        return blob
    return bytes(blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :])


def county_layer(df: DataFrame) -> DataFrame:
    """A layer with COUNTY as given, and county normalised."""
    return require_columns(df, ["COUNTY"], "the county layer").withColumn("county_name", norm_county(F.col("COUNTY")))


def class_file(directory: str, year: Column, first: int = FIRST_CLASS_YEAR) -> Column:
    """Name of the crop-class raster that a year reads."""
    return F.format_string(f"{directory.rstrip('/')}/CDL_%d_48.tif", class_year(year, first))


def with_available(targets: DataFrame, files: DataFrame, year: str = "year", check: bool = True, first: int = FIRST_CLASS_YEAR) -> DataFrame:
    """targets and the crop-class year they read (file_year); null where ``files`` (file_year) lacks it and it is checked."""
    asked = targets.withColumn("_file", class_year(F.col(year), first))
    if not check:
        return asked.withColumnRenamed("_file", "file_year")
    known = files.select("file_year").distinct()
    return asked.join(known, F.col("_file") == F.col("file_year"), "left").drop("_file")


# The cache: partition columns take the place of a directory tree


def cache_key(kind: str, crop: Column, county: Column, year: Column, sensor: Column | None = None) -> Column:
    """kind/CROP/kind_COUNTY_year[_sensor].tif, the cache's file name, for messages and for exchange."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}, not {kind}")
    tag = F.lit("") if sensor is None else F.when(F.length(sensor) > 0, F.concat(F.lit("_"), F.lower(sensor))).otherwise("")
    crop, county = sanitize_id(crop), sanitize_id(county)
    return F.concat(F.lit(f"{kind}/"), crop, F.lit(f"/{kind}_"), county, F.lit("_"), year.cast("string"), tag, F.lit(".tif"))


def write_cache(pixels: DataFrame, path: str, kind: str, value: str = "value") -> None:
    """Writes a signal or weight table as float, by kind, crop, year and county; only touched partitions are replaced."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}, not {kind}")
    require_columns(pixels, ["crop", "county", "year", "row", "col", value], "the cache")
    out = pixels.select("crop", "county", "year", "row", "col", F.col(value).cast("float").alias("value")).withColumn("kind", F.lit(kind))
    (out.repartition("crop", "year", "county").sortWithinPartitions("row", "col").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("kind", "crop", "year", "county").parquet(path))


def read_cache(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The cached table of a kind, its values as double again."""
    return spark.read.parquet(path).where(F.col("kind") == kind).withColumn("value", F.col("value").cast("double"))


def not_cached(targets: DataFrame, cached: DataFrame, keys: tuple[str, ...] = ("county", "year")) -> DataFrame:
    """Targets without a cached raster."""
    return targets.join(cached.select(*keys).distinct(), list(keys), "left_anti")


# Results that are read more than once: tables in the shared folder


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster gets
    an error, since a folder of one machine is lost to the others."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="acreflow-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str, inside: str | None = None) -> bool:
    """Whether there is a file or folder, in any store that Spark reads; with ``inside``, one that holds such names."""
    system, there = _file_system(spark, path)
    if not inside or not system.exists(there):
        return system.exists(there)
    return len(system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(there, inside))) > 0


#: Tables made within ``released``, innermost last.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def released() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within, ``settled`` tables are noted; at the end they are deleted, but for those that the given function kept, which
    are the caller's from then on. For steps whose result is settled: what they stored on the way goes with them."""
    kept: list[DataFrame] = []
    _OPEN.append([])

    def keep(df: DataFrame) -> DataFrame:
        out = df if hasattr(df, "_settled_at") else settled(df)
        kept.append(out)
        return out

    try:
        yield keep
    finally:
        places = {df._settled_at for df in kept}
        dropped(*(df for df in _OPEN.pop() if df._settled_at not in places))
        if _OPEN:
            _OPEN[-1].extend(kept)


def settled(df: DataFrame) -> DataFrame:
    """Writes a result that is read several times, once, as a table in the shared folder, and reads it back.

    Plans stay small, nothing is computed twice, and lost executors take nothing with them. The table goes with
    ``dropped`` or ``released``, or else when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, there = _file_system(spark, path)
    system.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the tables of ``frames``, which ``settled`` returned and nothing reads any more. Twice is once."""
    for df in frames:
        system, there = _file_system(df.sparkSession, df._settled_at)
        system.delete(there, True)
        system.cancelDeleteOnExit(there)
