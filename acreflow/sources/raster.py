"""The data source ``geotiff``: rasters as pixel rows, read by blocks and written a file a key.

    raster.register(spark)
    spark.read.format("geotiff").option("extent", "-320000 740000 -290000 770000").load("/rasters/CDL_2020_48.tif")
    raster.write_rasters(weights, grids, "/cache", "weight")

Reading: a task gets about ``partitionBytes`` of blocks of one file, and reads just those. Blocks outside the extent (in
the file's coordinates) are never read, nor are those outside the bounds of row and col that a query's filters give: the
option ``pushFilters``, with which the session setting spark.sql.python.filterPushdown.enabled must be on. Files may lie in any store that pyarrow opens;
``tables.decode_tiffs`` reads whole files through Spark's own readers instead.

Writing: tasks write into a staging folder, and the driver moves the files of a job that succeeded; a failed job, task
or second attempt leaves nothing. Memory: a strip of rows, and a file's compressed strips."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from acreflow.schemas import require_columns
from acreflow.sources import geotiff
from acreflow.sources.tables import KINDS, cache_key

SCHEMA = "path string, row int, col int, value double"
#: Columns that a raster's cells bring to the writer: the file, its frame, the cell.
FILE = ("path", "epsg", "x_min", "y_max", "res", "n_rows", "n_cols")
#: Files up to which the driver reads the headers; of more, each is a task that reads its own.
HEADERS = 256


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    """The rasters of a path: itself, or those below it, without the staging folders of writers."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"no raster at {path}")
    below = store.get_file_info(fs.FileSelector(at, recursive=True))
    return [path.rstrip("/") + x.path[len(at.rstrip("/")) :] for x in sorted(below, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.lower().endswith((".tif", ".tiff")) and "/_staging-" not in x.path]


@dataclass(frozen=True)
class Bounds:
    """Rows and columns, ends included, and a box (x_min, y_min, x_max, y_max); None is open."""

    row: tuple[float, float] = (-math.inf, math.inf)
    col: tuple[float, float] = (-math.inf, math.inf)
    box: tuple[float, float, float, float] | None = None

    def of(self, h: geotiff.Header) -> Bounds:
        """With the box as rows and columns of a file: those of the cells that it overlaps."""
        if self.box is None:
            return self
        x0, y0, x1, y1 = self.box
        rows = (math.floor((h.y_max - y1) / h.res), math.ceil((h.y_max - y0) / h.res) - 1)
        cols = (math.floor((x0 - h.x_min) / h.res), math.ceil((x1 - h.x_min) / h.res) - 1)
        both = lambda a, b: (max(a[0], b[0]), min(a[1], b[1]))
        return replace(self, row=both(self.row, rows), col=both(self.col, cols), box=None)

    def meets(self, first: int, last: int, left: int, right: int) -> bool:
        return first <= self.row[1] and last >= self.row[0] and left <= self.col[1] and right >= self.col[0]


@dataclass
class Blocks(InputPartition):
    """Some blocks of a file; without a header, all of the file's that the bounds meet."""

    path: str
    header: geotiff.Header | None
    blocks: tuple[int, ...]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("partitionBytes", 4 << 20))
        box = options.get("extent")
        self.bounds = Bounds(box=tuple(map(float, box.replace(",", " ").split())) if box else None)
        if self.bounds.box and len(self.bounds.box) != 4:
            raise ValueError("extent must be x_min y_min x_max y_max")

    def _parts(self, path: str, h: geotiff.Header) -> Iterator[Blocks]:
        bounds = self.bounds.of(h)
        wanted = [k for k in range(len(h.offsets)) if bounds.meets(*h.extent(k))]
        bare = replace(h, offsets=(), sizes=())
        cell = np.dtype(h.kind).itemsize
        step = max(1, self.size // max(1, cell * h.block[0] * h.block[1]))
        for i in range(0, len(wanted), step):
            some = tuple(wanted[i : i + step])
            yield Blocks(path, bare, some, tuple(h.offsets[k] for k in some), tuple(h.sizes[k] for k in some))

    def partitions(self) -> Sequence[InputPartition]:
        files = _files(self.path)
        if len(files) > HEADERS:
            return [Blocks(f, None, (), (), ()) for f in files]
        out: list[InputPartition] = []
        for path in files:
            store, at = _store(path)
            with store.open_input_file(at) as f:
                out += self._parts(path, geotiff.header(f))
        return out or [Blocks("", None, (), (), ())]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, at = _store(partition.path)
        with store.open_input_file(at) as f:
            parts = [partition] if partition.header else list(self._parts(partition.path, geotiff.header(f)))
            for part in parts:
                bounds = self.bounds.of(part.header)
                for k, offset, size in zip(part.blocks, part.offsets, part.sizes, strict=True):
                    first, _, left, _ = part.header.extent(k)
                    row, col, value = geotiff.held(geotiff.block_of(f, part.header, k, offset, size), part.header.nodata, first, left)
                    own = (row >= bounds.row[0]) & (row <= bounds.row[1]) & (col >= bounds.col[0]) & (col <= bounds.col[1])
                    row, col, value = row[own], col[own], value[own]
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(row), pa.string()), pa.array(row), pa.array(col), pa.array(value)], ["path", "row", "col", "value"])


class PruningReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of row and col prune blocks; every filter is also left to Spark, which knows about cells."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in ("row", "col") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                low, high = getattr(self.bounds, name)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = min(high, f.value - isinstance(f, LessThan))
                self.bounds = replace(self.bounds, **{name: (low, high)})
            yield f


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: where they are staged, and their place."""

    files: tuple[tuple[str, str], ...]


class _Strips:
    """Encodes one raster from cells that come by rows."""

    def __init__(self, head: tuple):
        self.path, self.epsg, self.x_min, self.y_max, self.res, self.n_rows, self.n_cols = head
        self.done: list[bytes] = []
        self.rows = self._empty()

    def _empty(self) -> np.ndarray:
        return np.full((max(0, min(geotiff.STRIP, self.n_rows - len(self.done) * geotiff.STRIP)), self.n_cols), np.nan, np.float32)

    def _close(self) -> None:
        self.done.append(geotiff.encoded(self.rows, 5, 2))
        self.rows = self._empty()

    def add(self, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> None:
        if len(row) and (row.min() < 0 or row.max() >= self.n_rows or col.min() < 0 or col.max() >= self.n_cols):
            raise ValueError(f"{self.path} has cells outside its {self.n_rows} rows and {self.n_cols} columns")
        strip = row // geotiff.STRIP
        for k in np.unique(strip).tolist():
            while len(self.done) < k:
                self._close()
            if k < len(self.done):
                raise ValueError("cells must come by rows")
            own = strip == k
            self.rows[row[own] - k * geotiff.STRIP, col[own]] = value[own]

    def bytes(self) -> bytes:
        while len(self.done) * geotiff.STRIP < self.n_rows:
            self._close()
        return geotiff.assembled(self.done, self.n_cols, self.n_rows, self.x_min, self.y_max, self.res, self.epsg, None, 5, 2)


class Writer(DataSourceArrowWriter):
    """Of rows (FILE, row, col, value) in which a file's cells stand together and by rows, as ``write_rasters`` deals them."""

    def __init__(self, options, schema: StructType):
        if missing := sorted({*FILE, "row", "col", "value"} - set(schema.names)):
            raise ValueError(f"rasters lack the columns {', '.join(missing)}")
        self.path = options["path"].rstrip("/")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _store(self.staging)
        store.create_dir(at, recursive=True)
        files: list[tuple[str, str]] = []
        open_: _Strips | None = None
        seen: set[str] = set()

        def close() -> None:
            name = f"{uuid.uuid4().hex}.tif"
            with store.open_output_stream(f"{at}/{name}") as f:
                f.write(open_.bytes())
            files.append((name, open_.path))

        for batch in iterator:
            paths = batch.column("path").to_pylist()
            starts = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(paths)], strict=True):
                if open_ is None or open_.path != paths[a]:
                    if open_ is not None:
                        close()
                    if paths[a] in seen:
                        raise ValueError("a file's cells must stand together")
                    seen.add(paths[a])
                    open_ = _Strips(tuple(batch.column(c)[a].as_py() for c in FILE))
                part = batch.slice(a, b - a)
                open_.add(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "value")))
        if open_ is not None:
            close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        staged = _store(self.staging)[1]
        for name, path in (f for m in messages if m for f in m.files):
            store.create_dir(f"{at}/{path}".rsplit("/", 1)[0], recursive=True)
            store.move(f"{staged}/{name}", f"{at}/{path}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, staged = _store(self.staging)
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return (PruningReader if self.options.get("pushFilters", "false").lower() == "true" else Reader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)


def read_rasters(spark: SparkSession, path: str, extent: tuple[float, float, float, float] | None = None, partition_bytes: int = 4 << 20) -> DataFrame:
    """(path, row, col, value): the cells with data of a raster, or of all below a folder, or of those that an extent
    overlaps. Filters on row and col prune where the session lets them through."""
    register(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("geotiff").option("partitionBytes", partition_bytes).option("pushFilters", pushed)
    return (reader.option("extent", " ".join(map(repr, map(float, extent)))) if extent else reader).load(path)


def write_rasters(pixels: DataFrame, grids: DataFrame, path: str, kind: str, value: str = "value", sensor: Column | None = None, keys: tuple[str, ...] = ("crop", "county", "year")) -> None:
    """A float32 file with LZW and differences of words for each crop, county and year, named as the cache names it.

    pixels: (keys, row, col, value); grids: (some of the keys, crs, x_min, y_max, res, n_rows, n_cols). Files of the same
    name are replaced, others stay. One shuffle brings a file's cells together; a task holds a strip of them."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}, not {kind}")
    require_columns(pixels, [*keys, "row", "col", value], "rasters")
    own = [k for k in keys if k in grids.columns]
    register(pixels.sparkSession)
    frame = grids.select(*own, F.col("crs").cast("int").alias("epsg"), "x_min", "y_max", "res", F.col("n_rows").cast("int").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"))
    named = pixels.join(frame, own).withColumn("path", cache_key(kind, F.col("crop"), F.col("county"), F.col("year"), sensor))
    rows = named.select(*FILE, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("float").alias("value"))
    rows.repartition("path").sortWithinPartitions("path", "row", "col").write.format("geotiff").mode("append").save(path)
