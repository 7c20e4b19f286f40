"""GeoTIFF rasters in numpy: strips and tiles, plain, deflate or LZW, with differences of words or of float bytes; classic
and large files. One band, north up, square cells.

A file is read a block at a time from anything that seeks and reads, so that a part of a raster costs that part: the
data source in ``raster`` deals blocks out to tasks. Rows are encoded as they come, for its writer."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa

# Tag numbers, bytes of field types, sample types of the format.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PREDICTOR, _TILE_W, _TILE_H, _TILE_AT, _TILE_N, _FORMAT, _SCALE, _TIE, _KEYS, _NODATA = (
    256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113,
)
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Raster:
    """values by row and column; the upper left corner, the cell size, and the value that stands for no data."""

    values: np.ndarray
    x_min: float
    y_max: float
    res: float
    nodata: float | None = None
    epsg: int | None = None


# LZW as TIFF has it: codes of 9 to 12 bits, high bit first, 256 clears, 257 ends. The width of a code depends only on how
# many codes came since the last clear, so the codes up to the next one lie at known places.
_CLEAR, _END, _RUN = 256, 257, 4096
_ENTRIES = 258 + np.maximum(np.arange(_RUN) - 1, 0)  # of the reader's table before the code that is the i-th since a clear
_WIDTHS = np.minimum(9 + (_ENTRIES >= 511) + (_ENTRIES >= 1023) + (_ENTRIES >= 2047), 12).astype(np.int64)
_PLACES = np.concatenate([[0], np.cumsum(_WIDTHS)])


def unlzw(data: bytes) -> bytes:
    """The bytes of an LZW stream. Codes are cut out a run at a time, without a step for each bit."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    out: list[bytes] = []
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    start, bits = 0, 8 * len(data)
    while start < bits:
        n = int(np.searchsorted(_PLACES, bits - start, "right")) - 1
        n = min(n, _RUN)
        if n <= 0:
            break
        at, width = start + _PLACES[:n], _WIDTHS[:n]
        byte = at >> 3
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (at & 7) - width) & (1 << width) - 1
        stops = np.flatnonzero((codes == _CLEAR) | (codes == _END))
        end = int(stops[0]) if len(stops) else n
        table, last = single.copy(), b""
        for code in codes[:end].tolist():
            if code < len(table):
                entry = table[code]
            elif last and code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("a damaged LZW stream")
            if last:
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
        if end == n:
            if n == _RUN:
                raise ValueError("an LZW stream that never clears its table")
            break
        if codes[end] == _END:
            break
        start += int(_PLACES[end + 1])
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """An LZW stream of the bytes, as other readers expect it."""
    runs: list[list[int]] = [[_CLEAR]]
    table: dict[tuple[int, int], int] = {}
    run: list[int] = []
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
        elif (known := table.get((prefix, byte))) is not None:
            prefix = known
        else:
            run.append(prefix)
            table[prefix, byte] = 258 + len(table)
            prefix = byte
            if len(table) >= 4094 - 258:
                runs.append([*run, prefix, _CLEAR])
                run, table, prefix = [], {}, -1
    runs.append([*run, *([prefix] if prefix >= 0 else []), _END])
    bits = []
    for codes in runs:
        some, width = np.array(codes, np.int64), _WIDTHS[: len(codes)]
        shift = width[:, None] - 1 - np.arange(12)
        bits.append(((some[:, None] >> np.maximum(shift, 0)) & 1)[shift >= 0])
    return np.packbits(np.concatenate(bits).astype(np.uint8)).tobytes()


@dataclass(frozen=True)
class Header:
    """What a reader needs of a file besides its blocks."""

    order: str
    width: int
    height: int
    kind: str
    compression: int
    predictor: int
    block: tuple[int, int]  # rows, columns
    tiled: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    x_min: float
    y_max: float
    res: float
    nodata: float | None
    epsg: int | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    def extent(self, k: int) -> tuple[int, int, int, int]:
        """First and last row, first and last column of block ``k``."""
        row, col = k // self.across * self.block[0], k % self.across * self.block[1]
        return row, min(row + self.block[0], self.height) - 1, col, min(col + self.block[1], self.width) - 1


def header(f: BinaryIO) -> Header:
    """The header of a file that seeks and reads."""

    def part(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    head = part(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else None
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    large = version == 43
    at = struct.unpack_from(order + ("Q" if large else "I"), head, 8 if large else 4)[0]
    count, entry, room, wide = ("Q", 20, 8, "Q") if large else ("H", 12, 4, "I")
    n = struct.unpack(order + count, part(at, struct.calcsize(count)))[0]
    raw = part(at + struct.calcsize(count), n * entry)
    t: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, items = struct.unpack_from(f"{order}HH{wide}", raw, entry * i)
        code = _TYPES.get(kind)
        if code is None:
            continue
        form = f"{order}{items}s" if code == "s" else f"{order}{items * len(code)}{code[0]}"
        size, place = struct.calcsize(form), entry * (i + 1) - room
        t[tag] = struct.unpack(form, raw[place : place + size] if size <= room else part(struct.unpack_from(order + wide, raw, place)[0], size))
    one = lambda tag, default=None: t.get(tag, (default,))[0]
    if one(_SAMPLES, 1) != 1:
        raise ValueError("only rasters of one band are read")
    width, height, compression, predictor = one(_WIDTH), one(_HEIGHT), one(_COMPRESSION, 1), one(_PREDICTOR, 1)
    kind = np.dtype(f"{order}{_KINDS[one(_FORMAT, 1)]}{one(_BITS, 1) // 8}")
    if compression not in (1, 5, 8, 32946) or predictor not in (1, 2, 3) or predictor == 3 and kind.kind != "f":
        raise ValueError(f"compression {compression} with predictor {predictor} isn't read for {kind}")
    tiled = _TILE_W in t
    block = (one(_TILE_H), one(_TILE_W)) if tiled else (min(one(_ROWS, height), height), width)
    scale, tie, keys = t.get(_SCALE, (1.0, 1.0, 0.0)), t.get(_TIE, (0.0,) * 6), t.get(_KEYS, ())
    if scale[0] != scale[1]:
        raise ValueError("only square cells are read")
    epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (2048, 3072)), None)
    nodata = float(one(_NODATA).rstrip(b"\0").decode()) if _NODATA in t else None
    offsets, sizes = t[_TILE_AT if tiled else _OFFSETS], t[_TILE_N if tiled else _COUNTS]
    return Header(order, width, height, kind.str, compression, predictor, block, tiled, offsets, sizes, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], nodata, epsg)


def undo_differences(block: np.ndarray, predictor: int) -> np.ndarray:
    """The samples of a block. Predictor 2 holds differences of words, floats' included; predictor 3 those of bytes, the
    highest of all samples of a row first."""
    if predictor == 2:
        words = block.astype(block.dtype.newbyteorder("=")).view(f"u{block.dtype.itemsize}")
        return np.cumsum(words, axis=1, dtype=words.dtype).view(block.dtype.newbyteorder("="))
    if predictor == 3:
        size = block.dtype.itemsize
        planes = np.cumsum(np.ascontiguousarray(block).view(np.uint8).reshape(len(block), -1), axis=1, dtype=np.uint8)
        high_first = planes.reshape(len(block), size, -1).transpose(0, 2, 1)
        return np.ascontiguousarray(high_first).view(f">f{size}")[..., 0]
    return block


def block_of(f: BinaryIO, h: Header, k: int, offset: int | None = None, size: int | None = None) -> np.ndarray:
    """The samples of block ``k``, without what a tile has beyond the raster's edge."""
    first, last, left, right = h.extent(k)
    rows = h.block[0] if h.tiled else last - first + 1
    size = h.sizes[k] if size is None else size
    kind = np.dtype(h.kind)
    if not size:  # a block that isn't there has no data
        return np.full((last - first + 1, right - left + 1), np.nan if h.nodata is None and kind.kind == "f" else h.nodata or 0, kind.newbyteorder("="))
    f.seek(h.offsets[k] if offset is None else offset)
    raw = f.read(size)
    open_ = {1: bytes, 5: unlzw}.get(h.compression, zlib.decompress)
    block = undo_differences(np.frombuffer(open_(raw), kind, rows * h.block[1]).reshape(rows, h.block[1]), h.predictor)
    return block[: last - first + 1, : right - left + 1].astype(kind.newbyteorder("="))


def read(data: bytes) -> Raster:
    f = io.BytesIO(data)
    h = header(f)
    values = np.empty((h.height, h.width), np.dtype(h.kind).newbyteorder("="))
    for k in range(len(h.offsets)):
        first, last, left, right = h.extent(k)
        values[first : last + 1, left : right + 1] = block_of(f, h, k)
    return Raster(values, h.x_min, h.y_max, h.res, h.nodata, h.epsg)


#: Rows of a strip that is written.
STRIP = 64


def encoded(rows: np.ndarray, compression: int = 8, predictor: int = 1) -> bytes:
    """A strip of float32 rows, compressed."""
    values = np.ascontiguousarray(rows, "<f4")
    if predictor == 2:
        words = values.view("<u4")
        values = np.concatenate([words[:, :1], words[:, 1:] - words[:, :-1]], axis=1)
    return {5: lzw, 8: zlib.compress}[compression](values.tobytes())


def assembled(strips: list[bytes], width: int, height: int, x_min: float, y_max: float, res: float, epsg: int | None = None, nodata: float | None = None, compression: int = 8, predictor: int = 1) -> bytes:
    """A file of one float32 band from its strips of ``STRIP`` rows; NaN, or ``nodata``, stands for no data."""
    offsets = np.cumsum([8, *map(len, strips)]).tolist()
    projected = epsg not in (None, 4326, 4269)
    keys = (1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, 3072 if projected else 2048, 0, 1, epsg or 4326)
    none = (repr(float("nan") if nodata is None else nodata).encode() + b"\0",)
    fields = [
        (_WIDTH, 4, (width,)), (_HEIGHT, 4, (height,)), (_BITS, 3, (32,)), (_COMPRESSION, 3, (compression,)), (262, 3, (1,)), (_OFFSETS, 4, tuple(offsets[:-1])), (_SAMPLES, 3, (1,)), (_ROWS, 4, (STRIP,)),
        (_COUNTS, 4, tuple(map(len, strips))), (_PREDICTOR, 3, (predictor,)), (_FORMAT, 3, (3,)), (_SCALE, 12, (res, res, 0.0)), (_TIE, 12, (0.0, 0.0, 0.0, x_min, y_max, 0.0)), (_KEYS, 3, keys), (_NODATA, 2, none),
    ]
    at = offsets[-1] + offsets[-1] % 2
    head, extra = struct.pack("<H", len(fields)), b""
    after = at + 2 + 12 * len(fields) + 4
    for tag, kind, held in fields:
        raw = held[0] if kind == 2 else struct.pack("<" + _TYPES[kind] * len(held), *held)
        count = len(raw) if kind == 2 else len(held)
        if len(raw) > 4:
            raw, extra = struct.pack("<I", after + len(extra)), extra + raw + b"\0" * (len(raw) % 2)
        head += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(strips) + b"\0" * (at - offsets[-1]) + head + b"\0" * 4 + extra


def write(raster: Raster, compression: int = 8, predictor: int = 1) -> bytes:
    """One float32 band in strips; compression 8 is deflate, 5 LZW; predictor 2 stores differences of words."""
    strips = [encoded(raster.values[i : i + STRIP], compression, predictor) for i in range(0, len(raster.values), STRIP)]
    return assembled(strips, raster.values.shape[1], len(raster.values), raster.x_min, raster.y_max, raster.res, raster.epsg, raster.nodata, compression, predictor)


PIXELS = "row int, col int, value double"


def held(values: np.ndarray, nodata: float | None, row: int = 0, col: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values) of the cells with data of a part of a raster whose first cell is (row, col)."""
    part = values.astype(float)
    there = ~np.isnan(part) if nodata is None or np.isnan(nodata) else ~np.isnan(part) & (part != nodata)
    r, c = np.nonzero(there)
    return (r + row).astype(np.int32), (c + col).astype(np.int32), part[r, c]


def pixels(data: bytes) -> Iterator[pa.RecordBatch]:
    """(row, col, value) of the cells with data, a block at a time: the decoder for ``tables.decode_tiffs``."""
    f = io.BytesIO(data)
    h = header(f)
    for k in range(len(h.offsets)):
        first, _, left, _ = h.extent(k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held(block_of(f, h, k), h.nodata, first, left)], ["row", "col", "value"])
