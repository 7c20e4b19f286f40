"""Periodic run detection: stretches of words that repeat with a period, at least a number of times.

Harmonic grid probing. A run of period p and of ``times`` periods or more crosses ``times`` points of the grid 0, p, 2p,
..., so the words at jp and (j+1)p are equal at all of them. For all periods together that is n/1 + n/2 + ... tests,
which numpy makes for a whole period at once, or for a whole block of large periods at once, so the number of array
steps grows with the square root of a text. What survives, and some probes between its grid points, is extended both
ways by comparing growing chunks. Grid points within a run already found, of a period that divides theirs, are skipped.

Defined results: a null or empty text has no words and no runs; runs may overlap, each is reported once with its
smallest period; every row is treated alone, so repeated rows and ids change nothing; other columns, whatever their
names, are not read. A text's memory is a number a word and its distinct words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from acreflow.llm.common import SPACED, raw_strings, slices, word_lists

#: Words compared at first when a survivor is extended; each further chunk is twice as long, up to the most.
CHUNK, MOST = 32, 1 << 16
#: Probes of each survivor between its grid points.
PROBES = 8
FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def coded(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the words that they stand for."""
    codes: dict[bytes, int] = {}
    parts = [np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int32, len(words)) for words in word_lists(text, SPACED)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(codes)


def _same_right(w: np.ndarray, at: int, p: int) -> int:
    """The first place from ``at`` on whose word differs from the one p later; the last comparable place, plus one."""
    stop, size = len(w) - p, CHUNK
    while at < stop:
        end = min(stop, at + size)
        differ = w[at:end] != w[at + p : end + p]
        if differ.any():
            return at + int(differ.argmax())
        at, size = end, min(2 * size, MOST)
    return stop


def _same_left(w: np.ndarray, at: int, p: int) -> int:
    """The first place of the stretch up to ``at`` whose words all equal those p later."""
    size = CHUNK
    while at > 0:
        start = max(0, at - size)
        differ = w[start:at] != w[start + p : at + p]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, size = start, min(2 * size, MOST)
    return 0


def find_runs(w: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least max(least, times * period) words, by start, then period.

    Periods come in rising order, so a run is found with its smallest first; its multiples give the same stretch again
    and are left out."""
    n, found, seen = len(w), [], set()
    if times < 2:
        raise ValueError("a run has two periods at least")
    most = n // times
    reach, whose = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the run that holds a word: its end, its period
    reason = [(i * (times - 2) * 2 + 1, 2 * PROBES) for i in range(PROBES)] if times > 2 else []

    def settle(p: np.ndarray, x: np.ndarray) -> None:
        """Extends the survivors: x is the first of ``times`` grid points of period p with equal words."""
        if len(x):
            keep = (reach[x] <= x + (times - 1) * p) | (p % whose[x] != 0)
            p, x = p[keep], x[keep]
        for part, whole in reason:  # a run that begins before x holds all the words up to the last grid point
            if not len(x):
                return
            y = x + p * part // whole
            keep = w[y] == w[y + p]
            p, x = p[keep], x[keep]
        for q, at in zip(p.tolist(), x.tolist(), strict=True):
            if reach[at] > at + (times - 1) * q and q % whose[at] == 0:
                continue
            start, end = _same_left(w, at, q), _same_right(w, at, q) + q
            if end - start >= max(least, times * q) and (start, end) not in seen:
                seen.add((start, end))
                found.append((start, end - start, q))
                longer = reach[start:end] < end
                reach[start:end][longer], whose[start:end][longer] = end, q

    root = min(most, int(n**0.5))
    for p in range(1, root + 1):
        grid = w[::p]
        equal = grid[1:] == grid[:-1]
        run = equal[: len(equal) - times + 2].copy()
        for k in range(1, times - 1):
            run &= equal[k : len(equal) - times + 2 + k]
        x = np.flatnonzero(run) * p
        settle(np.full(len(x), p), x)
    first = root + 1
    while first <= most:  # periods of a block are no multiples of each other
        last = min(most, 2 * first - 1)
        p = np.arange(first, last + 1)
        recent: list[np.ndarray] = []
        ps, xs = [], []
        for j in range((n - 1) // first):
            p = p[: max(0, (n - 1) // (j + 1) - first + 1)]  # those whose next grid point lies in the text
            recent = [r[: len(p)] for r in recent[-(times - 2) :]] if times > 2 else []
            recent.append(w[j * p] == w[(j + 1) * p])
            if len(recent) == times - 1:
                held = np.flatnonzero(np.logical_and.reduce(recent))
                ps.append(p[held])
                xs.append((j - times + 2) * p[held])
        p, x = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (ps, xs))
        order = np.lexsort((x, p))
        settle(p[order], x[order])
        first = last + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run is cut to its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def _joined(ids: np.ndarray, words: list[bytes], size: int = 1 << 16) -> Iterator[bytes]:
    """The words of ``ids`` with a space between them, some at a time."""
    for at in range(0, len(ids), size):
        yield (b" " if at else b"") + b" ".join([words[i] for i in ids[at : at + size].tolist()])


def report(ids: np.ndarray, words: list[bytes], least: int = 6, times: int = 4) -> tuple:
    """The values of FIELDS of one text."""
    found = find_runs(ids, least, times)
    text = hashlib.sha256()
    for part in _joined(ids[kept(len(ids), found)] if found else ids, words):
        text.update(part)
    listed = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return len(found), s, m, q, None if m is None else 1000 * m // q, listed, text.hexdigest()


_ARROW = {"long": pa.int64(), "string": pa.string()}


def detected(docs: DataFrame, least: int = 6, times: int = 4, key: str = "doc_id", text: str = "text", words: Callable | None = None) -> DataFrame:
    """(key, FIELDS) of every row: how many runs, the longest one, and digests of all runs and of the text in which each
    run is cut to its first period. ``words(key, ids)`` may put another sequence of the text's words in its place. A
    narrow operator, one pass."""
    fields = [f.split() for f in FIELDS.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                rows = []
                for k, x in zip(part.column(0).to_pylist(), raw_strings(part, 1), strict=True):
                    ids, known = coded(x)
                    rows.append(report(words(k, ids) if words else ids, known, least, times))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(fields))], ["key", *(n for n, _ in fields)])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, {FIELDS}").withColumnRenamed("key", key)


def collapsed(docs: DataFrame, least: int = 6, times: int = 4, text: str = "text") -> DataFrame:
    """``docs`` with each run of a text cut to its first period. Texts without runs stay as they are; others get their
    words joined by one space. Null stays null."""
    at, names = docs.columns.index(text), docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, at):
                out = []
                for x in part.column(at).cast(pa.binary()).to_pylist():
                    ids, known = coded(x or b"")
                    found = find_runs(ids, least, times)
                    out.append(b"".join(_joined(ids[kept(len(ids), found)], known)) if found else x)
                columns = list(part.columns)
                columns[at] = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
