"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the whole vocabulary answers, for the distinct pre-tokens of a batch at
once, which of them are tokens already (slot by hash-and-displace, then one comparison with the slot's token).
Tier two: a pre-token that isn't a token is merged over a linked list of its bytes, the next pair taken from a
heap of (rank, place) with stale entries skipped.

Defined results: a null text is an empty one (no ids); ids keep the text's order; ids that decode outside the
vocabulary raise ``IndexError``; repeated rows and repeated ids stay; other columns of the input are not read.
The vocabulary (some 50k entries) is sent once to each executor; its size doesn't depend on the input.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from acreflow.llm.common import Memo, slices, strings

#: Resolved pre-tokens that a Python worker remembers between batches.
MEMO_ENTRIES = 300_000
_M64 = (1 << 64) - 1
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ (d * _STEP & _M64)) * _MIX & _M64
    return (x ^ (x >> 29)) % n


class PerfectHash:
    """Minimal perfect hash of byte strings: ``n`` keys fill ``n`` slots.

    Keys fall into n/3 buckets; each bucket of several keys, largest first, searches the displacement that sends
    its keys to free slots, and each bucket of one key names its slot directly (as -1-slot)."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[(h >> 20) % self.buckets].append(i)
        self.move = np.zeros(self.buckets, np.int64)
        self.key = np.zeros(self.n, np.int32)
        taken = bytearray(self.n)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        single = 0
        for b in order:
            ids = members[b]
            if len(ids) > 1:
                d = 1
                while True:
                    at = [_slot(hashes[i], d, self.n) for i in ids]
                    if len(set(at)) == len(at) and not any(taken[s] for s in at):
                        break
                    d += 1
                self.move[b] = d
            elif ids:
                single = taken.index(0, single)
                at = [single]
                self.move[b] = -1 - single
            else:
                continue
            for i, s in zip(ids, at, strict=True):
                taken[s] = 1
                self.key[s] = i

    def candidates(self, items: list[bytes]) -> np.ndarray:
        """For each item the only key that it can be."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))
        d = self.move[((h >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)]
        x = (h ^ (d.astype(np.uint64) * np.uint64(_STEP))) * np.uint64(_MIX)
        slot = ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)
        return self.key[np.where(d < 0, -1 - d, slot)]


class BpeCodec:
    """Encoder and decoder for a vocabulary of ranks and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.tokens, self.ids, self.pattern = list(ranks), np.fromiter(ranks.values(), np.int64, len(ranks)), pattern
        self.hash = PerfectHash(self.tokens)
        self._ready()

    def _ready(self) -> None:
        self.rank = dict(zip(self.tokens, self.ids.tolist(), strict=True))
        self.bytes_of = [b""] * (int(self.ids.max()) + 1)
        for token, i in self.rank.items():
            self.bytes_of[i] = token
        self.split = regex.compile(self.pattern).findall
        # The same pattern over ASCII texts, where the letters and digits are few.
        ascii_pattern = self.pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9") if r"[\p" not in self.pattern else None
        ascii_pattern = re.sub(r"(?<!\[)(?<!\^)(?<!\\s)A-Za-z\+", "[A-Za-z]+", ascii_pattern) if ascii_pattern else None
        ascii_pattern = ascii_pattern.replace(" ?0-9+", " ?[0-9]+") if ascii_pattern else None
        self.split_ascii = re.compile(ascii_pattern, re.ASCII).findall if ascii_pattern and "\\p" not in ascii_pattern else self.split
        self.memo: Memo = Memo(MEMO_ENTRIES)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("tokens", "ids", "pattern", "hash")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The second tier: byte pairs by rank from a heap, over linked pieces."""
        n, rank = len(word), self.rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or (k := after[j]) != end:
                continue
            alive[j] = 0
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank.get(word[i : after[k]])) is not None:
                    heapq.heappush(heap, (r, i, after[k]))
            if (p := before[i]) >= 0 and (r := rank.get(word[p:k])) is not None:
                heapq.heappush(heap, (r, p, k))
        out, i = [], 0
        while i < n:
            out.append(rank[word[i : after[i]]])
            i = after[i]
        return tuple(out)

    def resolve(self, pieces: Iterable[str]) -> None:
        """Both tiers, for pre-tokens that the memo lacks."""
        texts = list(pieces)
        items = [x.encode() for x in texts]
        found = self.hash.candidates(items).tolist()
        for text, item, i in zip(texts, items, found, strict=True):
            self.memo[text] = (self.rank[item],) if self.tokens[i] == item else self.merge(item)

    def encode(self, text: str) -> array:
        pieces = (self.split_ascii if text.isascii() else self.split)(text)
        if lacking := {x for x in pieces if x not in self.memo}:
            if len(self.memo) + len(lacking) > self.memo.most:
                self.memo.clear()
                lacking = set(pieces)
            self.resolve(lacking)
        return array("I", chain.from_iterable(map(self.memo.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], BpeCodec] = {}


def codec_for(path: str, pattern: str) -> BpeCodec:
    """Built once for a process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BpeCodec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def _shared(df: DataFrame, path: str, pattern: str):
    return df.sparkSession.sparkContext.broadcast(codec_for(path, pattern))


def _little(ids: array) -> bytes:
    return np.frombuffer(ids, np.uint32).astype("<u4").tobytes() if ids else b""


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids binary): ids as little-endian unsigned 32-bit integers, of every row's whole text.

    A narrow operator: one pass, no shuffle; a row's memory is its text and ids."""
    codec = _shared(df, path, pattern)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in it:
            for part in slices(batch, 1):
                ids = [own.encode(x) for x in strings(part, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(map(_little, ids), pa.binary())], ["key", "n_tokens", "ids"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns, and the bytes of the ids in ``ids`` (as ``encode`` writes them; null: empty) in ``out``,
    which replaces a column of that name."""
    codec = _shared(df, path, pattern)
    df = df.drop(out) if out != ids else df
    at, names = df.columns.index(ids), df.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in it:
            for part in slices(batch, at):
                raw = [own.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*names, out])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` binary")


def coded(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids_sha256, decoded_sha256): every row's text encoded, and its ids decoded again, in one
    pass; neither ids nor bytes leave the worker."""
    codec = _shared(df, path, pattern)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in it:
            for part in slices(batch, 1):
                sizes, coded, decoded = [], [], []
                for x in strings(part, 1):
                    ids = own.encode(x)
                    sizes.append(len(ids))
                    coded.append(hashlib.sha256(_little(ids)).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
