"""Media payloads in content-defined chunks, deduplicated by digest, rebuilt from ordered chunk lists and verified.

A rolling gear hash over the last 32 bytes cuts each payload; a manifest lists its chunks' lengths and SHA-256
digests in order. Digests alone are counted first. Documents are then packed, about a MB of text each, and a pack holds
each of its distinct chunks once. Documents whose chunks no other document has are done with that. Which documents may
have shared chunks a bit table tells, of bounded size: a false hit only sends a document the longer way, so that no
size changes the result. The packs of those documents are joined by digest: of the packs that hold a chunk the
first owns it, and the store keeps every distinct chunk once. Reading back is local where a pack has all chunks of a
document; other packs fetch theirs, each once, by a join on the digest.

Every chunk read back is checked against its digest. media_bytes and media_sha256 are taken over what is read back of
a medium: its chunk list, then its chunks in order.

Defined results: a null text is an empty payload (padding only); equal texts have equal values; repeated rows stay;
null and repeated keys are kept as they are; other columns of the input are not read; a text beyond a pack's size is a
pack of its own. Memory is a few packs, one text at least.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreflow.llm.common import batches_of, dropped, settled, slices, strings

UNIT, PAD = 576, 255
LEAST, MOST, MASK_BITS = 256, 8192, 10
#: Bytes of text of a pack, about.
PACK_BYTES = 1 << 20
#: Bits of the table of shared digests: 16 for each, within these bounds (128 KB and 64 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
#: Bytes of a digest by which chunks are joined; the manifest has the whole digest, and what is read is checked by it.
NAME = 16
_MAGIC = b"GCL1"
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 padded to a positive multiple of the unit, and its length before."""
    raw = text.encode()
    return raw + bytes([PAD]) * (-len(raw) % UNIT if raw else UNIT), len(raw)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the 32 bytes that end at each place, by doubling: the sum of gear[b] << age."""
    h, width = _GEAR[data], 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """Chunk ends of each payload. A payload's cuts depend on it alone: candidates lie past the window's length."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    marks = np.flatnonzero(gear(data) >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, at = [], 0
    for p in payloads:
        ends, last, stop = [], 0, len(p)
        for c in (marks[np.searchsorted(marks, at) : np.searchsorted(marks, at + stop)] - at).tolist():
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST:
                ends.append(c)
                last = c
        while stop - last > MOST:
            last += MOST
            ends.append(last)
        if last < stop:
            ends.append(stop)
        out.append(ends)
        at += stop
    return out


def chunked(texts: list[str]) -> list[tuple[bytes, list[tuple[bytes, bytes]]]]:
    """(manifest, [(digest, chunk)]) of each text."""
    made = [payload_of(t) for t in texts]
    out = []
    for (payload, n), ends in zip(made, cuts([p for p, _ in made]), strict=True):
        parts = [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        named = [(hashlib.sha256(x).digest(), x) for x in parts]
        out.append((_MAGIC + struct.pack("<QQI", n, len(payload), len(named)) + b"".join(struct.pack("<I", len(x)) + d for d, x in named), named))
    return out


def read_manifest(manifest: bytes) -> tuple[int, int, list[tuple[int, bytes]]]:
    """(bytes before padding, payload bytes, [(length, digest)])."""
    if manifest[:4] != _MAGIC:
        raise ValueError("not a chunk list")
    n, total, count = struct.unpack_from("<QQI", manifest, 4)
    return n, total, [(struct.unpack_from("<I", manifest, at)[0], manifest[at + 4 : at + 36]) for at in range(24, 24 + 36 * count, 36)]


def features(manifest: bytes, chunks: list[bytes]) -> dict:
    """What is told of a medium read back. Raises if a chunk isn't what its digest says."""
    n, total, named = read_manifest(manifest)
    for (length, digest), x in zip(named, chunks, strict=True):
        if len(x) != length or hashlib.sha256(x).digest() != digest:
            raise ValueError("a stored chunk differs from its digest")
    payload = b"".join(chunks)
    if len(payload) != total:
        raise ValueError("the chunks don't make up the payload")
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / total
    return {
        "n_bytes": n, "payload_bytes": total, "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(manifest) + total, "media_sha256": hashlib.sha256(manifest + payload).hexdigest(),
        "feature": f"chunks={len(named)};distinct={len({d for _, d in named})};longest={max(k for k, _ in named)};entropy={-(share * np.log2(share)).sum():.4f}",
    }


_FEATURES = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
FEATURES_SQL = ", ".join(f"{name} {'long' if kind == pa.int64() else 'string'}" for name, kind in _FEATURES)
_BLOBS = pa.list_(pa.binary())


def _told(keys: pa.Array, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, *(pa.array([r[n] for r in rows], t) for n, t in _FEATURES)], ["key", *(n for n, _ in _FEATURES)])


def _listed(values: list, kind: pa.DataType) -> pa.Array:
    """One list in one row."""
    return pa.array([values], pa.list_(kind))


def _named(manifests: Iterable[bytes]) -> dict[bytes, int]:
    """The distinct chunks of manifests, in order of appearance: name and length."""
    return {d[:NAME]: n for m in manifests for n, d in read_manifest(m)[2]}


def _split(data: bytes, lengths: dict[bytes, int]) -> dict[bytes, bytes]:
    """The chunks of compressed ``data``, by name."""
    raw, ends = zstandard.decompress(data), [0, *accumulate(lengths.values())]
    return {d: raw[a:b] for d, a, b in zip(lengths, ends, ends[1:], strict=False)}


def _table_of(digests: DataFrame) -> np.ndarray:
    """The bit table of digests: three bits each. Words are made by a grouping, at most MOST_BITS / 64 of them."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * digests.count()).bit_length()))
    place = lambda i: F.conv(F.hex(F.substring("digest", 1 + 4 * i, 4)), 16, 10).cast("long") % bits
    set_ = digests.select(F.explode(F.array(*map(place, range(3)))).alias("bit"))
    words = set_.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("mask"))
    table = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        table[r.word] = r.mask
    return table.view(np.uint64)


def _hits(table: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Which chunks may be shared."""
    p = np.frombuffer(b"".join(d[:12] for d in names), ">u4").reshape(-1, 3).astype(np.uint64) % np.uint64(64 * len(table))
    return ((table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(1)


def _counted(rows: DataFrame) -> DataFrame:
    """(digest, n): names of the chunks of documents, and in how many documents they occur, by slices."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                n = Counter(d for _, named in chunked(strings(part, 1)) for d in {d[:NAME] for d, _ in named})
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.binary()), pa.array(n.values(), pa.int64())], ["digest", "n"])

    return rows.mapInArrow(run, "digest binary, n long")


def _packed(rows: DataFrame, table, shared: bool, pack_bytes: int) -> DataFrame:
    """(pack, keys, manifests, data, hits) of the documents that may have shared chunks, or of the others. data: their
    distinct chunks in order of appearance, compressed together; hits: the names of those that may be shared."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, pack = zstandard.ZstdCompressor(level=6), TaskContext.get().partitionId() << 33
        for batch in it:
            for part in slices(batch, 1, pack_bytes):
                made = chunked(strings(part, 1))
                hit = dict(zip(names := list({d[:NAME]: 0 for _, named in made for d, _ in named}), _hits(table.value, names).tolist(), strict=True))
                at = [i for i, (_, named) in enumerate(made) if any(hit[d[:NAME]] for d, _ in named) == shared]
                if at:
                    own = {d[:NAME]: x for i in at for d, x in made[i][1]}
                    yield pa.RecordBatch.from_arrays([
                        pa.array([pack], pa.int64()), _listed(part.column(0).take(pa.array(at)).to_pylist(), part.column(0).type), _listed([made[i][0] for i in at], pa.binary()),
                        pa.array([squeeze.compress(b"".join(own.values()))], pa.binary()), _listed([d for d in own if hit[d]], pa.binary()),
                    ], ["pack", "keys", "manifests", "data", "hits"])
                pack += 1

    return rows.mapInArrow(run, f"pack long, keys array<{dict(rows.dtypes)['key']}>, manifests array<binary>, data binary, hits array<binary>")


class Store:
    """The stored chunks of one table of texts, as two tables.

    single: (keys, manifests, data) of documents whose chunks no other document has.
    shared: the others, a row a pack. keys, manifests: of documents whose chunks are all in the pack; open_keys,
    open_manifests: of documents that need chunks of other packs, their names in wanted; own, own_data: chunks that
    the pack owns and others need, each compressed; open_data: the other chunks of open documents; data: the rest."""

    def __init__(self, single: DataFrame, shared: DataFrame):
        self.single, self.shared = single, shared


_SHARED = ["pack", "keys", "manifests", "data", "open_keys", "open_manifests", "open_data", "own", "own_data", "wanted"]


def _settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs (pack, keys, manifests, data) with marks (name, whether it is the pack's own) as rows of Store.shared."""
    squeeze = zstandard.ZstdCompressor(level=6)
    for batch in it:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            keys, manifests, data, marks = (c[0].as_py() for c in row.columns[1:])
            kind, marked = row.column(1).type.value_type, {x["digest"]: x["own"] for x in marks or ()}
            away = {d for d, mine in marked.items() if not mine}
            opened = [not away.isdisjoint(_named([m])) for m in manifests]
            part = lambda values, want, opened=opened: [v for v, o in zip(values, opened, strict=True) if o == want]
            chunks, waiting = _split(data, _named(manifests)), _named(part(manifests, True))
            mine = [d for d, own in marked.items() if own]
            joined = lambda names, chunks=chunks, marked=marked: pa.array([squeeze.compress(b"".join(chunks[d] for d in names if d not in marked))], pa.binary())
            yield pa.RecordBatch.from_arrays([
                row.column(0), _listed(part(keys, False), kind), _listed(part(manifests, False), pa.binary()), joined([d for d in _named(part(manifests, False)) if d not in waiting]),
                _listed(part(keys, True), kind), _listed(part(manifests, True), pa.binary()), joined(waiting),
                _listed(mine, pa.binary()), _listed([squeeze.compress(chunks[d]) for d in mine], pa.binary()), _listed(sorted(away), pa.binary()),
            ], _SHARED)


def store(df: DataFrame, key: str = "doc_id", text: str = "text", pack_bytes: int = PACK_BYTES) -> Store:
    """Stores the texts, every distinct chunk once."""
    spark, rows = df.sparkSession, df.select(df[key].alias("key"), df[text].alias("text"))
    key_type = dict(rows.dtypes)["key"]
    with batches_of(spark):
        digests = settled(_counted(rows).groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest"))
        table = spark.sparkContext.broadcast(_table_of(digests))
        dropped(digests)
        single = settled(_packed(rows, table, False, pack_bytes).drop("pack", "hits"))
        staged = settled(_packed(rows, table, True, pack_bytes))
        held = staged.select("pack", F.explode("hits").alias("digest"))
        owners = held.groupBy("digest").agg(F.min("pack").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
        marks = held.join(owners, "digest").groupBy("pack").agg(F.collect_list(F.struct("digest", (F.col("owner") == F.col("pack")).alias("own"))).alias("marks"))
        kinds = dict.fromkeys(_SHARED, "array<binary>") | {"pack": "long", "keys": f"array<{key_type}>", "open_keys": f"array<{key_type}>", "data": "binary", "open_data": "binary"}
        shared = settled(staged.drop("hits").join(marks, "pack", "left").mapInArrow(_settle, ", ".join(f"{c} {kinds[c]}" for c in _SHARED)))
    dropped(staged)
    return Store(single, shared)


def _rebuilt(keys: pa.Array, manifests: list[bytes], chunks: dict[bytes, bytes]) -> pa.RecordBatch:
    known: dict[bytes, dict] = {}
    for m in manifests:
        if m not in known:
            known[m] = features(m, [chunks[d[:NAME]] for _, d in read_manifest(m)[2]])
    return _told(keys, [known[m] for m in manifests])


def _read_single(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i in range(batch.num_rows):
            manifests, data = (batch.column(j)[i].as_py() for j in (1, 2))
            yield _rebuilt(batch.column(0).slice(i, 1).flatten(), manifests, _split(data, _named(manifests)))


def _chunks_of(row: dict) -> dict[bytes, bytes]:
    """The chunks that a row of Store.shared holds; ``data`` may be left out."""
    own, waiting = dict(zip(row["own"], map(zstandard.decompress, row["own_data"]), strict=True)), _named(row["open_manifests"])
    skip = set(own).union(row["wanted"])
    found = own | _split(row["open_data"], {d: n for d, n in waiting.items() if d not in skip})
    if "data" in row:
        found |= _split(row["data"], {d: n for d, n in _named(row["manifests"]).items() if d not in skip and d not in waiting})
    return found


def _read_local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            own = row.drop_columns(["keys"]).to_pylist()[0]
            yield _rebuilt(row.column("keys").flatten(), own["manifests"], _chunks_of(own))


def _read_open(group: pa.Table, fetched: pa.Table) -> pa.Table:
    own = group.drop_columns(["open_keys"]).to_pylist()[0]
    chunks = _chunks_of(own) | dict(zip(fetched.column("digest").to_pylist(), map(zstandard.decompress, fetched.column("chunk").to_pylist()), strict=True))
    return pa.Table.from_batches([_rebuilt(group.column("open_keys").combine_chunks().flatten(), own["open_manifests"], chunks)])


def read_back(media: Store, key: str = "doc_id") -> DataFrame:
    """(key, features) of every stored document, from the stored bytes."""
    packs = media.shared
    schema = f"key {dict(packs.dtypes)['keys'][6:-1]}, {FEATURES_SQL}"
    single = media.single.select("keys", "manifests", "data").mapInArrow(_read_single, schema)
    local = packs.where(F.size("keys") > 0).drop("pack", "open_keys").mapInArrow(_read_local, schema)
    wanted = packs.select("pack", F.explode("wanted").alias("digest"))
    shared = packs.select(F.explode(F.arrays_zip("own", "own_data")).alias("x")).select(F.col("x.own").alias("digest"), F.col("x.own_data").alias("chunk"))
    fetched = wanted.join(shared, "digest").select(F.col("pack").alias("asking"), "digest", "chunk")
    waiting = packs.where(F.size("open_keys") > 0).select("pack", "open_keys", "open_manifests", "open_data", "own", "own_data", "wanted")
    joined = waiting.groupBy("pack").cogroup(fetched.groupBy("asking")).applyInArrow(_read_open, schema)
    return single.unionByName(local).unionByName(joined).withColumnRenamed("key", key)
