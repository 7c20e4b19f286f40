"""Personal data: exact base forms, and spans that a character-level BiLSTM-CRF adds.

The tagger is trained here, in numpy, from labelled spans of seeded examples: the kinds as they are written and as
they are veiled (spelled-out or bracketed separators, no plus sign, dotted groups). Texts are cut into overlapping
windows. A window is decoded on its own, without spans that touch an inner edge; a run of overlapping windows is
decoded as a whole too, each place by the window in which it lies deepest, so a span may be of any length, and a run
grows while a span touches its inner edge. All that is found is reconciled over the whole text: the set of spans
without overlaps that weighs most. Decoding is constrained: a span holds a digit, an at sign (plain or bracketed) or
the word dot; so runs start from windows with one.

Defined results: offsets count code points, ends are exclusive; a null text is an empty one; base spans always
stay, and added ones never overlap them; repeated rows stay; other columns of the input are not read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from acreflow.llm.common import slices, strings
from acreflow.llm.tagger import Tagger, encode

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
#: Seeded training examples, and training steps.
EXAMPLES, STEPS = 4_000, 260

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CUE = re.compile(r"[0-9@]|[\[(]at[\])]|(?<=\x20)dot(?=\x20)")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """Around each at sign: the local part reaches left as far as it can, not into the match before."""
    out, done = [], 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < m.start():
            out.append(("email", a, m.end()))
            done = m.end()
    return out


def base_spans(text: str) -> list[Span]:
    """The exact forms by kind, leftmost and not overlapping within a kind; failing matches drop."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(small, m.groups()))]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return found


# Training examples ----------------------------------------------------------------------------------------------


def _word(r: random.Random, most: int = 4) -> str:
    return "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiouéäo") for _ in range(r.randint(1, most)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    body = r.choice("3456") + _digits(r, r.choice((13, 14, 14, 14, 15)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _example(r: random.Random, kind: str) -> str:
    """One written form of a kind."""
    if kind == "email":
        user, host, top = r.choice((_word(r, 3), f"{_word(r, 2)}.{_word(r, 2)}", f"{_word(r, 3)}.{_digits(r, 2)}")), _word(r, 3), r.choice(("com", "org", "net", "example.com"))
        user = user.encode("ascii", "ignore").decode() or "x"
        host = host.encode("ascii", "ignore").decode() or "y"
        return r.choice((f"{user}@{host}.{top}", f"{user} [at] {host}.{top}", f"{user}[at]{host}.{top}", f"{user} (at) {host}.{top}", f"{user}(at){host}[dot]{top}", f"{user} @ {host}.{top}", f"{user} at {host} dot {top.replace('.', ' dot ')}"))
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice((".".join(parts), "[.]".join(parts), "(.)".join(parts), ":".join(f"{r.randint(0, 65535):x}" for _ in range(8))))
    if kind == "card":
        c = _card(r)
        groups = [c[i : i + 4] for i in range(0, len(c), 4)]
        return r.choice((c, " ".join(groups), "-".join(groups), ".".join(groups), "/".join(groups)))
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice((f"+1 ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"+1/{a}/{b}/{c}"))


def _noise(r: random.Random) -> str:
    """What looks alike and is no personal data."""
    return r.choice((
        str(r.randint(1, 2100)), f"{r.randint(1, 9999)}.{r.randint(0, 99):02d}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1950, 2030)}", f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
        f"{r.randint(0, 23)}:{r.randint(0, 59):02d}", f"@{_word(r, 2)}", f"#{r.randint(1, 99999)}", "###", "$$$", "%%%", "&&&", f"{r.randint(1, 99)}%", _digits(r, r.randint(5, 24)), f'token = "{r.getrandbits(160):040x}"', f"password={r.getrandbits(72):018x}", f"AKIA{_word(r, 6).upper()}{_digits(r, 2)}",
        f"{r.randint(2000, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"at {_word(r)}", "dot", f"{_word(r)} dot {_word(r)}",
    ))


def examples(n: int, seed: int) -> tuple[list[str], list[list[Span]]]:
    """Texts of a window's length and their labelled spans; a third have none."""
    r, texts, spans = random.Random(seed), [], []
    for _ in range(n):
        text, own, target = "", [], WINDOW + r.randint(0, 30)
        plan = r.random()
        while len(text) < target:
            roll = r.random()
            if roll < 0.16 and plan > 0.33:
                kind = r.choice(KINDS)
                form = _example(r, kind)
                own.append((kind, len(text), len(text) + len(form)))
                text += form
            elif roll < 0.3:
                text += _noise(r)
            else:
                text += _word(r)
            text += r.choice((" ", " ", " ", " ", ", ", ". ", "\n", "### ", ' "', ": "))
        cut = r.randint(0, len(text) - WINDOW)
        texts.append(text[cut : cut + WINDOW])
        spans.append([(k, max(0, a - cut), min(WINDOW, b - cut)) for k, a, b in own if b > cut and a < cut + WINDOW])
    return texts, spans


def labels(spans: list[Span], n: int) -> np.ndarray:
    """0 outside; 1 + 2k where kind k begins, 2 + 2k within it."""
    y = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


_TAGGERS: dict[tuple[int, int], Tagger] = {}


def trained(n: int = EXAMPLES, steps: int = STEPS) -> Tagger:
    """The tagger, trained once a process; the same every time."""
    if (n, steps) not in _TAGGERS:
        texts, spans = examples(n, 5)
        x = np.stack([encode(t) for t in texts])
        y = np.stack([labels(s, WINDOW) for s in spans])
        tagger = Tagger(1 + 2 * len(KINDS))
        tagger.train(x, y, steps)
        _TAGGERS[n, steps] = tagger
    return _TAGGERS[n, steps]


# Decoding -------------------------------------------------------------------------------------------------------


def plausible(kind: str, x: str) -> bool:
    """Exact check of an added span's content."""
    d = digits_of(x)
    if kind == "email":
        if re.fullmatch(r"[A-Za-z0-9._%+-]+ at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+", x):
            return True
        return ("@" in x or re.search(r"[\[(]at[\])]", x) is not None) and re.search(r"[A-Za-z0-9](?:\.|[\[(]dot[\])])[A-Za-z]{2}", x) is not None and len(x) >= 6
    if kind == "ip":
        parts = re.split(r"[.:()\[\]]+", x.strip("[]()"))
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) or len(parts) == 8 and ":" in x and all(re.fullmatch(r"[0-9a-fA-F]{1,4}", p) for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9][0-9 ./-]*[0-9]", x) is not None
    return 10 <= len(d) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ()./-]*[0-9]", x) is not None and re.search(r"[ ()./-]", x) is not None


def _cued(text: str) -> list[int]:
    """Window starts, of those that cover the text, where a cue lies."""
    last = max(0, len(text) - WINDOW)
    out: list[int] = []
    for m in _CUE.finditer(text):
        at = m.start()
        low = max(0, -(-(at - WINDOW + 1) // STRIDE))
        for k in range(low, at // STRIDE + 1):
            start = min(k * STRIDE, last)
            if not out or start > out[-1]:
                out.append(start)
    return out


def _spans_of(path: np.ndarray) -> list[tuple[int, int, int]]:
    out, kind, a = [], -1, 0
    for i, y in enumerate([*path.tolist(), 0]):
        if kind >= 0 and y != 2 + 2 * kind:
            out.append((kind, a, i))
            kind = -1
        if y and (y % 2 or kind < 0):
            kind, a = (y - 1) // 2, i
    return out


def reconcile(found: dict[Span, float]) -> list[Span]:
    """The spans without overlaps that weigh most together."""
    spans = sorted(found, key=lambda s: (s[2], s[1], KINDS.index(s[0])))
    ends = [s[2] for s in spans]
    best: list[tuple[float, int]] = [(0.0, -1)]
    for i, s in enumerate(spans):
        with_it = found[s] + best[bisect_right(ends, s[1], 0, i)][0]
        best.append(max(best[i], (with_it, i), key=lambda x: x[0]))
    out, i = [], len(spans)
    while i > 0:
        if best[i][1] == i - 1:
            s = spans[i - 1]
            out.append(s)
            i = bisect_right(ends, s[1], 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def _runs(starts: list[int]) -> list[tuple[int, ...]]:
    """Window starts in order, as runs of overlapping windows."""
    out: list[list[int]] = []
    for at in starts:
        if out and at - out[-1][-1] < WINDOW:
            out[-1].append(at)
        else:
            out.append([at])
    return [tuple(x) for x in out]


def _decoded(tagger: Tagger, texts: list[str], runs: list[tuple[int, tuple[int, ...]]], rows: int) -> Iterator[tuple[int, tuple[int, ...], dict[Span, float], bool, bool]]:
    """(text number, run, weighed spans, whether a span touches the run's inner edge before and behind)."""

    def spans(i: int, path: np.ndarray, e: np.ndarray, start: int) -> tuple[dict[Span, float], bool, bool]:
        size, found, before, behind = len(texts[i]), {}, False, False
        for kind, a, b in _spans_of(path):
            b = min(b, size - start)
            if a >= b:
                continue
            edges = a == 0 and start > 0, b == len(e) and start + b < size
            before, behind = before or edges[0], behind or edges[1]
            if not any(edges):
                found[KINDS[kind], start + a, start + b] = float((e[a:b, 1 + 2 * kind : 3 + 2 * kind].max(-1) - e[a:b, 0]).sum())
        return found, before, behind

    at = 0
    while at < len(runs):
        group = [runs[at]]
        while at + len(group) < len(runs) and sum(len(run) for _, run in group) < rows:
            group.append(runs[at + len(group)])
        at += len(group)
        windows = [(j, start) for j, (_, run) in enumerate(group) for start in run]
        stitched = [np.empty((min(run[-1] + WINDOW, len(texts[i])) - run[0], tagger.tags), np.float32) for i, run in group]
        ends = [[(x + WINDOW + y) // 2 for x, y in zip(run, run[1:], strict=False)] + [run[-1] + WINDOW] for _, run in group]
        place: list[int] = [0] * len(group)
        found: list[dict[Span, float]] = [{} for _ in group]
        for first in range(0, len(windows), rows):
            part = windows[first : first + rows]
            x = np.zeros((len(part), WINDOW), np.int64)
            for j, (g, start) in enumerate(part):
                own = encode(texts[group[g][0]][start : start + WINDOW])
                x[j, : len(own)] = own
            emissions = tagger.emissions(x)
            for j, path in enumerate(tagger.decode(emissions)):
                g, start = part[j]
                i, run = group[g]
                low, high = (ends[g][place[g] - 1] if place[g] else start), min(ends[g][place[g]], len(texts[i]))
                stitched[g][low - run[0] : high - run[0]] = emissions[j, low - start : high - start]
                place[g] += 1
                if path.any():
                    for span, weight in spans(i, path, emissions[j], start)[0].items():
                        found[g][span] = max(weight, found[g].get(span, 0.0))
        for g, path in enumerate(tagger.decode_runs(stitched)):
            i, run = group[g]
            whole, before, behind = spans(i, path, stitched[g], run[0])
            for span, weight in whole.items():
                found[g][span] = max(weight, found[g].get(span, 0.0))
            yield i, run, found[g], before, behind


def added_spans(tagger: Tagger, texts: list[str], base: list[list[Span]], rows: int = 1024) -> list[list[Span]]:
    """What the tagger adds to each text."""
    starts = {i: at for i, text in enumerate(texts) if (at := _cued(text))}
    known: dict[int, dict[tuple[int, ...], dict[Span, float]]] = {i: {} for i in starts}
    open_ = [(i, run) for i, at in starts.items() for run in _runs(at)]
    while open_:
        more: dict[int, set[int]] = {}
        for i, run, spans, before, behind in _decoded(tagger, texts, open_, rows):
            known[i][run] = spans
            last = max(0, len(texts[i]) - WINDOW)
            # A run that a span leaves doubles on that side.
            reach = STRIDE * len(run)
            if before:
                more.setdefault(i, set()).update(range(max(0, -(-(run[0] - reach) // STRIDE) * STRIDE), run[0], STRIDE))
            if behind:
                more.setdefault(i, set()).update(min(x, last) for x in range(run[-1] + STRIDE, run[-1] + reach + STRIDE, STRIDE))
        open_ = []
        for i, new in more.items():
            starts[i] = sorted(new.union(starts[i]))
            open_ += [(i, run) for run in _runs(starts[i]) if run not in known[i]]
    found: list[dict[Span, float]] = [{} for _ in texts]
    for i, at in starts.items():
        for run in _runs(at):
            found[i] |= known[i][run]
    out = []
    for text, own, spans in zip(texts, base, found, strict=True):
        own = sorted((a, b) for _, a, b in own)
        reach, ends = 0, []
        for _, b in own:
            ends.append(reach := max(reach, b))
        clear = lambda s: not (i := bisect_left(own, (s[2], 0))) or ends[i - 1] <= s[1]  # noqa: B023, E731
        out.append(reconcile({s: w for s, w in spans.items() if w > 0 and clear(s) and plausible(s[0], text[s[1] : s[2]])}) if spans else [])
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
_SPANS_SQL = "array<struct<kind: string, start: long, end: long, base: boolean>>"


def find(df: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(key, spans): every row's spans as structs of kind, start, end, base, by start, then kind."""
    shared = df.sparkSession.sparkContext.broadcast(tagger or trained())
    order = lambda s: (s["start"], KINDS.index(s["kind"]), s["end"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                texts = strings(part, 1)
                base = [base_spans(x) for x in texts]
                added = added_spans(shared.value, texts, base)
                rows = [sorted(({"kind": k, "start": a, "end": b, "base": own} for own, group in ((True, x), (False, y)) for k, a, b in group), key=order) for x, y in zip(base, added, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _SPANS)], ["key", "spans"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, spans {_SPANS_SQL}").withColumnRenamed("key", key)
