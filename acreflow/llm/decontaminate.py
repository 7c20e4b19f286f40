"""Benchmark decontamination: training texts are streamed through a generalised suffix automaton of the test items.

Words are runs of ASCII letters and digits and of all beyond ASCII, A to Z lowered. A window is ``window`` consecutive
words of an item; an item of fewer words, but not none, is one window. The automaton tracks the longest match that ends
at each word of a text; where it reaches a window's length, the words of the match are hit, and the state tells which
items hold that window.

Items are cut into pieces that overlap by a window less a word, so that none is lost, and the pieces are dealt into
shards of bounded size: an automaton is built from a shard in each worker, never from all items. One shard, the usual
case, is one narrow pass over the texts; of several, each is a pass that returns the texts it hits, whose spans are
united afterwards. Most words of a text never reach the automaton: a bit table of the shard's word pairs leaves only
stretches that are long enough and all of whose pairs occur.

Defined results: a null text has no words; a null item text has no windows; an item without an id is named by the empty
string, items of one id count once; rows of documents are treated alone, repeated ones alike; with no items nothing is
hit; an empty table gives an empty result; other columns, whatever their names, aren't read. A word is never cut, so a
shard exceeds its bound where a single word does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreflow.llm.common import PLAIN, dropped, raw_strings, settled, slices, word_lists

WINDOW = 10
#: Words of an item in a piece beyond the overlap; words and bytes of a shard's pieces, about.
PIECE, SHARD_WORDS, SHARD_BYTES = 4096, 1 << 17, 4 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """Of any number of word sequences: ``step`` by transitions, suffix links and longest lengths, as lists by state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state that ``p`` reaches by ``word``, of which longer strings are parted first where there are any."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word)
            last = new

    def matches(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        v = size = 0
        for word in sequence:
            while v and word not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            if word in self.next[v]:
                v, size = self.next[v][word], size + 1
            yield v, size

    def locus(self, v: int, size: int) -> int:
        """The state of the last ``size`` words of a match in state ``v``."""
        while self.length[self.link[v]] >= size and v:
            v = self.link[v]
        return v


class Shard:
    """The pieces of some items; its automaton is built where it is first used, once a process."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int):
        self.pieces, self.window, self._ready = pieces, window, False

    def __getstate__(self):
        return {"pieces": self.pieces, "window": self.window, "_ready": False}

    def ready(self) -> Shard:
        if self._ready:
            return self
        self.names = sorted({name for name, _ in self.pieces})
        number = {name: i for i, name in enumerate(self.names)}
        vocabulary: dict[bytes, int] = {}
        coded = sorted({(number[name], tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words.split(b" "))) for name, words in self.pieces})
        self.vocabulary, self.automaton = vocabulary, SuffixAutomaton()
        for _, ids in coded:
            self.automaton.add(ids)
        #: Items by the state of a whole window; by the state of a short item its sizes and items.
        self.holders: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        self.single: dict[int, set[int]] = {}
        for item, ids in coded:
            if len(ids) == 1:
                self.single.setdefault(ids[0], set()).add(item)
                continue
            size = min(len(ids), self.window)
            for at, (v, have) in enumerate(self.automaton.matches(ids), 1):
                if at >= size and have >= size:
                    v = self.automaton.locus(v, size)
                    held = self.holders if size == self.window else self.short.setdefault(v, {})
                    held.setdefault(v if size == self.window else size, set()).add(item)
        self.least = min((min(len(ids), self.window) for _, ids in coded if len(ids) > 1), default=0)
        pairs = np.array(sorted({pair for _, ids in coded for pair in zip(ids, ids[1:], strict=False)}), np.uint64).reshape(-1, 2)
        self.shift = np.uint64(64 - max(12, min(24, int(16 * len(pairs)).bit_length())))
        self.pairs = np.zeros(1 << 64 - int(self.shift), bool)
        self.pairs[self._place(pairs[:, 0], pairs[:, 1])] = True
        self.alone = np.zeros(len(vocabulary) + 1, bool)
        self.alone[list(self.single)] = True
        self._ready = True
        return self

    def _place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xD6E8FEB86659FD93)) >> self.shift  # any odd numbers

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(words, merged spans of hit words, items) of a text."""
        parts = []
        for words in word_lists(text, PLAIN):
            parts.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words)))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if self.single:
            for at in np.flatnonzero(self.alone[ids]).tolist():
                spans.append((at, at + 1))
                items |= self.single[int(ids[at])]
        if self.least and len(ids) >= self.least:
            known = self.pairs[self._place(ids[:-1], ids[1:])] & (ids[:-1] > 0) & (ids[1:] > 0)
            # Stretches of at least ``least`` words in which every pair is one of the shard.
            edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])))
            first, last = edge[::2], edge[1::2] + 1
            long = last - first >= self.least
            for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
                self._walk(ids[a:b].tolist(), a, spans, items)
        return len(ids), _merged(spans), items

    def _walk(self, ids: list[int], offset: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        automaton, window = self.automaton, self.window
        for at, (v, size) in enumerate(automaton.matches(ids), offset + 1):
            if size >= window:
                spans.append((at - size, at))
                v, size = automaton.locus(v, window), window
                items |= self.holders[v]
            if self.short:
                while v:
                    for n, own in self.short.get(v, {}).items():
                        if n <= size:
                            spans.append((at - n, at))
                            items |= own
                    v = automaton.link[v]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order; spans that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def pieces(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item string, words binary, n_words, n_bytes): the items' words, in pieces that share a window less a word."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                rows = []
                for name, x in zip(part.column(0).to_pylist(), raw_strings(part, 1), strict=True):
                    held: list[bytes] = []
                    fresh = False
                    for words in word_lists(x, PLAIN):
                        held, fresh = held + words, True
                        while len(held) > PIECE + window:
                            rows.append((name, b" ".join(held[: PIECE + window - 1]), PIECE + window - 1))
                            held = held[PIECE:]
                    if fresh:
                        rows.append((name, b" ".join(held), len(held)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["item", "words", "n_words"])

    named = items.select(F.coalesce(items[key].cast("string"), F.lit("")).alias("item"), items[text].alias("text"))
    return named.mapInArrow(run, "item string, words binary, n_words long").distinct().withColumn("n_bytes", F.length("words"))


FIELDS = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _passed(rows: DataFrame, shard: Shard, every: bool) -> DataFrame:
    """(key, text_id, FIELDS) of the rows (key, text), or of those alone that the shard hits; text_id is a digest."""
    shared = rows.sparkSession.sparkContext.broadcast(shard)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.ready()
        for batch in it:
            for part in slices(batch, 1):
                texts = raw_strings(part, 1)
                found = [own.scan(x) for x in texts]
                some = [i for i, f in enumerate(found) if every or f[1]]
                columns = [
                    part.column(0).take(pa.array(some, pa.int64())), pa.array([hashlib.sha256(texts[i]).digest() for i in some], pa.binary()), pa.array([found[i][0] for i in some], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in found[i][1]] for i in some], _SPANS), pa.array([sorted(own.names[k] for k in found[i][2]) for i in some], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "text_id", "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, text_id binary, {FIELDS}")


def _united(column: pa.ChunkedArray) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in _merged([(s["start"], s["end"]) for s in x or ()])] for x in column.to_pylist()], _SPANS)


def _shards(items: DataFrame, window: int, item_key: str, item_text: str, words: int) -> Iterator[Shard]:
    """One after the other; the driver holds one shard at a time."""
    cut = settled(pieces(items, window, item_key, item_text))
    size = cut.agg(F.sum("n_words"), F.sum("n_bytes")).first()
    n = max(1, -(-(size[0] or 0) // words), -(-(size[1] or 0) // SHARD_BYTES))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
    yield n
    for k in range(n):
        rows = dealt.where(F.col("shard") == k).select("item", "words").toArrow()
        yield Shard(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), window)
    dropped(cut)


def _found(docs: DataFrame, items: DataFrame, window: int, key: str, text: str, item_key: str, item_text: str, words: int) -> DataFrame:
    """(key, text_id, FIELDS) of every row."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    shards = _shards(items, window, item_key, item_text, words)
    if next(shards) == 1:
        (only,) = shards
        return _passed(rows, only, True)
    hits = None
    for shard in shards:
        # Rows of one id and text have one result, so one of them is kept before the spans of the shards meet.
        own = settled(_passed(rows, shard, False).groupBy("key", "text_id").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
        hits = own if hits is None else hits.unionByName(own)
    groups = hits.groupBy("key", "text_id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # bounded by a text's words and the shards

    def unite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _united(batch.column(2)), batch.column(3)], batch.schema.names)

    groups = settled(groups.mapInArrow(unite, f"key {dict(rows.dtypes)['key']}, text_id binary, spans array<struct<start:int,end:int>>, items array<string>"))
    plain = _passed(rows, Shard([], window), True).select("key", "text_id", "n_words").alias("p")
    joined = plain.join(groups.alias("g"), F.col("p.key").eqNullSafe(F.col("g.key")) & (F.col("p.text_id") == F.col("g.text_id")), "left")
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    return joined.select("p.key", "p.text_id", "n_words", empty("spans", "array<struct<start:int,end:int>>"), empty("items", "array<string>"))


def _lengths(spans: str = "spans"):
    return F.transform(spans, lambda s: s["end"] - s["start"])


def matched(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(key, n_words, n_hit, longest, spans, items) of every row: its words, those inside a window of an item, the longest
    span of such words, the spans (start and end word), and the names of the items, sorted as strings."""
    found = _found(docs, items, window, key, text, item_key, item_text, shard_words)
    n_hit = F.aggregate(_lengths(), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce(F.array_max(_lengths()), F.lit(0)).cast("long").alias("longest"), "spans", "items")


def cleaned(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int | None = None, coverage: float = 0.5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` without what it shares with the items: a row goes when more than ``coverage`` of its words are hit; else
    its spans of at least ``least`` words (a window's by default) are cut out of the text, with what stands between their
    words. Rows that lose nothing stay as they are."""
    least = window if least is None else least
    found = _found(docs, items, window, key, text, item_key, item_text, shard_words)
    n_hit = F.aggregate(_lengths(), F.lit(0).cast("long"), lambda a, x: a + x)
    cuts = F.filter("spans", lambda s: s["end"] - s["start"] >= least)
    marked = found.where(F.size("spans") > 0).select("key", "text_id", (n_hit > F.lit(coverage) * F.col("n_words")).alias("goes"), cuts.alias("cuts")).dropDuplicates(["key", "text_id"])
    names = docs.columns
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in names])
    rows = docs.select(whole.alias("row"), docs[key].alias("_key"), F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")).cast("binary"), 256)).alias("_id"))
    joined = rows.join(marked, rows["_key"].eqNullSafe(marked["key"]) & (rows["_id"] == marked["text_id"]), "left").where("goes is null or not goes")
    parts = joined.select("row.*", F.coalesce("cuts", F.array().cast("array<struct<start:int,end:int>>")).alias("_cuts"))
    at = names.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, at):
                spans = part.column(len(names)).to_pylist()
                raw = part.column(at).cast(pa.binary()).to_pylist()
                columns = [part.column(i) for i in range(len(names))]
                columns[at] = pa.array([cut(x, [(s["start"], s["end"]) for s in own]) if own else x for x, own in zip(raw, spans, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return parts.mapInArrow(run, docs.schema)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` (in order) and what stands between them."""
    out, at, todo = [], 0, iter(spans)
    span, start = next(todo, None), 0
    for i, m in enumerate(_WORD.finditer(text)):
        if span is None:
            break
        if i == span[0]:
            start = m.start()
        if i == span[1] - 1:
            out.append(text[at:start])
            at, span = m.end(), next(todo, None)
    return b"".join([*out, text[at:]])
