"""Token counts by compiled finite-state transducers.

The pre-token pattern becomes a deterministic automaton over character classes (a symbol carries what lookahead the
pattern needs). Texts run through it in chunks: each chunk's map from entry to exit states is made on its own, the
maps compose by a parallel prefix scan, and a last pass marks where pre-tokens start.

Byte-pair merging becomes a transducer over bytes. After each prefix of a pre-token the encoding has one last token;
a further byte picks the only vocabulary suffix that fits what stands before it, and moves the count by a number
that the state fixes. A state holds the vocabulary prefixes that are open, and for each the token and the relative
count before it: a subset construction, compiled as texts need it, every transition annotated with its counts.
Long pre-tokens run in chunks side by side: the state before a chunk is guessed from the bytes before it, each chunk
maps its entry state to its exit state and count, the maps compose in order, and a chunk whose true entry state isn't
the guessed one is mapped again from that. The counts are those of the run byte by byte.

Defined results: a null text is an empty one (0 bytes, 0 tokens); added special tokens inside a text count as one
token each, as the library's default has it; repeated rows stay; other columns of the input are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from acreflow.llm.bpe import BpeCodec
from acreflow.llm.common import Memo, slices, strings

#: Characters of a chunk of the boundary automaton.
CHUNK = 256
#: Bytes of a chunk of a long pre-token, and bytes before it from which its entry state is guessed.
PIECE, WARM = 128, 32
#: Transitions that a worker keeps; beyond, it compiles afresh, with the same answers.
EDGES = 1 << 20

LETTER, NUMBER, OTHER, SPACE, WHITE, LAST_SPACE, LAST_WHITE, SHORT, LONG, BREAK = range(10)
_SYMBOLS = 10
_FRESH, _LETTERS, _NUMBERS, _OTHERS, _JOIN, _WHITES, _ONE, _TWO = range(8)
_STATES = 8


def _boundary_automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start flag by state * symbols + symbol, for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ ."""
    to, starts = np.zeros((_STATES, _SYMBOLS), np.uint8), np.zeros((_STATES, _SYMBOLS), bool)
    run = {LETTER: _LETTERS, NUMBER: _NUMBERS, OTHER: _OTHERS}
    for state in range(_STATES):
        for symbol in range(_SYMBOLS):
            if symbol == BREAK:
                move, start = _FRESH, False
            elif state in (_ONE, _TWO):  # the letters of a contraction
                move, start = (_FRESH if state == _ONE else _ONE), False
            elif symbol in run:
                move, start = run[symbol], state not in (run[symbol], _JOIN)
            elif symbol in (SHORT, LONG):  # an apostrophe before a contraction's letters
                joined = state in (_OTHERS, _JOIN)
                move, start = (_OTHERS if joined else _ONE if symbol == SHORT else _TWO), not joined
            elif symbol in (LAST_SPACE, LAST_WHITE):
                move, start = (_JOIN if symbol == LAST_SPACE else _FRESH), True
            else:
                move, start = _WHITES, state != _WHITES
            to[state, symbol], starts[state, symbol] = move, start
    return to.ravel(), starts.ravel()


_TO, _STARTS = _boundary_automaton()
_CLASSES: list[np.ndarray] = []
_WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    """Class of each code point, and BREAK for one past the last."""
    if not _CLASSES:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)] + [BREAK], np.uint8)
        table[list(_WHITE_SPACE)] = WHITE
        table[32] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points (0x110000: a break), lookahead included."""
    out = _classes()[points]
    after = np.append(out[1:], np.uint8(BREAK))
    white = (out == SPACE) | (out == WHITE)
    last = white & (after < SPACE)
    out[last & (out == SPACE)] = LAST_SPACE
    out[last & (out == WHITE)] = LAST_WHITE
    at = np.flatnonzero(points == 39)
    one, two = (points[np.minimum(at + k, len(points) - 1)] for k in (1, 2))
    ends = at + 2 < len(points)
    out[at[np.isin(one, [ord(c) for c in "stmd"]) & (at + 1 < len(points))]] = SHORT
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    out[at[pair & ends]] = LONG
    return out


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), by doubling."""
    d = 1
    while d < len(maps):
        maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), 1)])
        d *= 2
    return maps


def starts(points: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pre-tokens start. points: code points, 0x110000 between texts."""
    n, rows = len(points), -(-len(points) // chunk)
    padded = np.full(rows * chunk, BREAK, np.uint8)
    padded[:n] = symbols(points)
    columns = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    maps = np.repeat(np.arange(_STATES, dtype=np.uint8)[None, :], rows, 0)
    for column in columns:
        maps = _TO[maps * np.uint8(_SYMBOLS) + column[:, None]]
    state = np.concatenate([np.zeros(1, np.uint8), compose(maps)[:-1, _FRESH]])
    found = np.empty((chunk, rows), bool)
    for i, column in enumerate(columns):
        edge = state * np.uint8(_SYMBOLS) + column
        found[i], state = _STARTS[edge], _TO[edge]
    return found.T.ravel()[:n]


class CountingTransducer:
    """Counts of byte-pair tokens of pre-tokens, state by state. ``codec`` answers what two tokens merge to."""

    def __init__(self, codec: BpeCodec, most: int = EDGES):
        self.codec, self.most = codec, most
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        parents = set()
        for token, i in codec.rank.items():
            node = 0
            for b in token:
                edge = node << 8 | b
                if (then := self.child.get(edge)) is None:
                    then = self.child[edge] = len(self.token)
                    self.token.append(-1)
                    parents.add(node)
                node = then
            self.token[node] = i
        self.open = bytearray(len(self.token))
        for node in parents:
            self.open[node] = 1
        self.fits: Memo = Memo(1 << 20)
        self._empty()

    def _empty(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys_of: list[tuple] = []
        self.size = 1 << 14
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.zeros((self.size, 2), np.int32)
        self.used = 0
        self._state(((0, -1, 0),))

    def _state(self, key: tuple) -> int:
        if (i := self.states.get(key)) is None:
            i = self.states[key] = len(self.keys_of)
            self.keys_of.append(key)
        return i

    def _fit(self, before: int, token: int) -> bool:
        """Whether ``token`` stays as it is after ``before`` (-1: at the start)."""
        key = before << 20 | token if before >= 0 else -1 - token
        if (ok := self.fits.get(key)) is None:
            own = self.codec.bytes_of
            ok = self.fits.put(key, self.codec.merge(own[before] + own[token]) == (before, token) if before >= 0 else self.codec.merge(own[token]) == (token,))
        return ok

    def compile(self, state: int, b: int) -> tuple[int, int]:
        """The transition of ``state`` by byte ``b``: next state, change of the count."""
        moved, chosen, delta = [], -1, 0
        for node, before, count in self.keys_of[state]:
            then = self.child.get(node << 8 | b)
            if then is None:
                continue
            if self.open[then]:
                moved.append((then, before, count))
            if chosen < 0 and (token := self.token[then]) >= 0 and self._fit(before, token):
                chosen, delta = token, count + 1
        if chosen < 0:
            raise ValueError("no token ends here: the vocabulary isn't closed under merging")
        return self._state((*((n, t, c - delta) for n, t, c in moved), (0, chosen, 0))), delta

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or of the free slot where it would go."""
        shift = np.uint64(64 - self.size.bit_length() + 1)
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        wrong = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (self.size - 1)
            there = self.keys[at[wrong]]
            wrong = wrong[(there != keys[wrong]) & (there >= 0)]
        return at

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if (self.used + len(keys)) * 2 > self.size:
            old, old_values = self.keys[self.keys >= 0], self.values[self.keys >= 0]
            while (self.used + len(keys)) * 2 > self.size:
                self.size *= 2
            self.keys, self.values, self.used = np.full(self.size, -1, np.int64), np.zeros((self.size, 2), np.int32), 0
            self._put(old, old_values)
        self.used += len(keys)
        while len(keys):  # of keys that meet in a free slot, one takes it
            at = self._places(keys)
            self.keys[at] = keys
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values = keys[~won], values[~won]

    def step(self, state: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and count changes of many states by their bytes; lacking transitions are compiled."""
        keys = state << 8 | data
        at = self._places(keys)
        lacking = np.unique(keys[self.keys[at] < 0])
        if len(lacking):
            made = np.array([self.compile(k >> 8, k & 255) for k in lacking.tolist()], np.int32).reshape(-1, 2)
            self._put(lacking, made)
            at = self._places(keys)
        found = self.values[at]
        return found[:, 0].astype(np.int64), found[:, 1]

    def walk(self, state: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after data[begin : begin + length] from each ``state``, and the tokens on the way."""
        order = np.argsort(-length, kind="stable")
        begin, length, state = begin[order], length[order], state[order]
        counts = np.zeros(len(order), np.int64)
        # longer[k] strings are longer than k
        longer = len(order) - np.searchsorted(length[::-1], np.arange(int(length[0]) if len(length) else 0), side="right")
        for k, active in enumerate(longer.tolist()):
            state[:active], moved = self.step(state[:active], data[begin[:active] + k].astype(np.int64))
            counts[:active] += moved
        exits, out = np.empty_like(state), np.empty_like(counts)
        exits[order], out[order] = state, counts
        return exits, out

    def _count_long(self, data: np.ndarray, begin: int, length: int) -> int:
        """Tokens of one pre-token, by chunks."""
        at = np.arange(begin, begin + length, PIECE)
        sizes = np.minimum(PIECE, begin + length - at)
        raw = data[begin : begin + length].tobytes()
        content = [raw[i : i + PIECE] for i in range(0, length, PIECE)]
        guess, _ = self.walk(np.zeros(len(at) - 1, np.int64), data, at[1:] - WARM, np.full(len(at) - 1, WARM))
        entry = [0, *guess.tolist()]
        known: dict[tuple[bytes, int], tuple[int, int]] = {}  # the chunks' state maps, as far as they are needed
        while True:
            lacking = {key: i for i, key in enumerate(zip(content, entry, strict=True)) if key not in known}
            some = np.fromiter(lacking.values(), np.int64, len(lacking))
            exits, counts = self.walk(np.array(entry, np.int64)[some], data, at[some], sizes[some])
            known |= zip(lacking, zip(exits.tolist(), counts.tolist(), strict=True), strict=True)
            state, total, sure = 0, 0, True
            for i, chunk in enumerate(content):
                entry[i] = state
                if (found := known.get((chunk, state))) is None:
                    sure = False
                    if i + 1 < len(content):
                        state = entry[i + 1]  # go on from the guess
                    continue
                state, total = found[0], total + found[1]
            if sure:
                return total

    def count(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[begin : begin + length]."""
        if self.used > self.most:
            self._empty()
        long = length > 2 * PIECE
        out = np.zeros(len(length), np.int64)
        out[~long] = self.walk(np.zeros(int((~long).sum()), np.int64), data, begin[~long], length[~long])[1]
        for i in np.flatnonzero(long).tolist():
            out[i] = self._count_long(data, int(begin[i]), int(length[i]))
        return out


class Counter:
    """Counts tokens of texts as a byte-level tokenizer file defines them."""

    def __init__(self, codec: BpeCodec, special: tuple[str, ...]):
        self.codec, self.special, self._transducer = codec, special, None

    def __getstate__(self):
        return {"codec": self.codec, "special": self.special, "_transducer": None}

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of each text."""
        if self._transducer is None:
            self._transducer = CountingTransducer(self.codec)
        tokens, apart = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        segments, owner = [], []
        for i, text in enumerate(texts):
            parts = [text]
            for special in self.special:
                if special in text:
                    split = [y for x in parts for y in x.split(special)]
                    apart[i] += (len(split) - len(parts)) * len(special.encode())
                    parts = split
            tokens[i] = len(parts) - 1
            segments += parts
            owner += [i] * len(parts)
        whole = "".join(segments)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        ends = np.cumsum(size)
        points = np.insert(np.frombuffer(whole.encode("utf-32-le"), np.uint32), ends, 0x110000)
        data = np.frombuffer(whole.encode(), np.uint8)
        wide = (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF) + 1
        breaks = ends + np.arange(len(segments))
        wide[breaks] = 0
        offset = np.concatenate([np.zeros(1, np.int64), np.cumsum(wide, dtype=np.int64)])
        owner = np.array(owner, np.int64)
        n_bytes = np.bincount(owner, np.diff(offset[np.concatenate([[0], breaks + 1])]), len(texts)).astype(np.int64) + apart
        marks = starts(points)
        bound = marks.copy()
        bound[breaks] = True
        bounds = np.flatnonzero(bound)
        is_start = marks[bounds]
        first, last = bounds[is_start], bounds[np.flatnonzero(is_start) + 1]
        if len(first):
            own = self._transducer.count(data, offset[first], offset[last] - offset[first])
            tokens += np.bincount(owner[np.searchsorted(breaks, first)], own, len(texts)).astype(np.int64)
        return n_bytes, tokens


def _bytes_of_characters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> Counter:
    """A byte-level BPE tokenizer file. Ranks are the order of its merges; single bytes come first."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    model, pre = own["model"], own["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or own["normalizer"] or model.get("ignore_merges"):
        raise ValueError("only plain byte-level BPE is compiled")
    if not pre.get("use_regex", True) or any(t.get(k) for t in own["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("only added tokens that stand anywhere as they are, and the pattern of the byte-level splitter, are compiled")
    alphabet = _bytes_of_characters()
    raw = lambda token: bytes(alphabet[c] for c in token)
    special = tuple(t["content"] for t in own["added_tokens"])
    ranks = {bytes([b]): i for i, b in enumerate(sorted(alphabet.values()))}
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        ranks.setdefault(raw(left + right), len(ranks))
    return Counter(BpeCodec(ranks, ""), special)


_COUNTERS: dict[str, Counter] = {}


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row's whole text. A narrow operator: one pass, no shuffle."""
    if path not in _COUNTERS:
        _COUNTERS[path] = read_tokenizer(path)
    shared = df.sparkSession.sparkContext.broadcast(_COUNTERS[path])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1, 2 << 20):
                n_bytes, n_tokens = shared.value.counts(strings(part, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes), pa.array(n_tokens)], ["key", "n_bytes", "n_tokens"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, n_bytes long, n_tokens long").withColumnRenamed("key", key)
