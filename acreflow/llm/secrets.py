"""Secret scans with multipart credential linking.

Strong forms stand alone: assigned passwords and tokens, long access identifiers, long hexadecimal runs. Weak
candidates (short identifiers, assigned client ids, random-looking strings, endpoints) are only parts of a
credential. Each part opens an interval: its scope (text between blank lines), or if a reach is given that much of the
scope on both sides. Identifiers, secrets and endpoints, however long, are joined where one overlaps another's
interval, and a weak one is reported only if its complement co-occurs: a secret with an identifier or an endpoint, an
identifier with a secret, an endpoint with both. Strong forms take part in the join, and are marked where they link.

Defined results: offsets count code points, ends are exclusive; a null text is an empty one without spans; spans
are ordered by start, then kind; repeated rows stay; the input's other columns are kept only by ``redact``.
The join is a sorted sweep within one text: n log n in its parts, nothing leaves the row.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreflow.llm.common import slices, strings

BASE = ("assign", "access", "hex")
WEAK = ("ident", "secret", "endpoint")
KINDS = BASE + WEAK
#: Code points around a part that its complement must touch, by default for single texts; tables are joined over whole
#: scopes (None).
REACH = 240

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_IDENT = re.compile(r"""\b(?:AKIA|ASIA)[A-Z0-9]{6,}|(?i:\b(?:access|client|user|account|app|tenant|key)(?:[_-]?key)?[_-]?(?:id|name))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""", re.ASCII)
_ENDPOINT = re.compile(r"""[a-z][a-z0-9+]{1,9}://[^\s"'<>]{4,}|(?i:\b(?:endpoint|host|hostname|server|url))["']?\x20*[:=]\x20*["']?([A-Za-z0-9.:/_-]{4,})""", re.ASCII)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def _random_looking(x: str) -> bool:
    """Mixed letters and digits with at least 3 bits a character."""
    n = len(x)
    return any(c.isdigit() for c in x) and any(c.isalpha() for c in x) and -sum(k / n * math.log2(k / n) for k in Counter(x).values()) >= 3.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strong forms by kind, leftmost and not overlapping within a kind."""
    found: list[tuple[str, int, int]] = []
    if "=" in text or ":" in text:
        low = text.lower() if text.isascii() else text.translate(_LOWER)
        if any(w in low for w in _WORDS):
            found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


_LOWER = {c: c + 32 for c in range(65, 91)}


def _covered(spans: list[tuple[str, int, int]], by: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """``spans`` without those that overlap one of ``by``."""
    by = sorted(by, key=lambda s: s[1])
    merged: list[list[int]] = []
    for _, a, b in by:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    ends = [b for _, b in merged]
    return [s for s in spans if (i := bisect_left(ends, s[1] + 1)) == len(merged) or merged[i][0] >= s[2]]


def linked_spans(text: str, base: list[tuple[str, int, int]], reach: int | None = REACH) -> tuple[list[tuple[str, int, int]], set[tuple[str, int, int]]]:
    """Weak parts whose complements co-occur in their scope, and those of ``base`` that link."""
    has_id = "AKIA" in text or "ASIA" in text
    if not (has_id or "=" in text or ":" in text):
        return [], set()
    idents = _covered([("ident", *m.span()) for m in _IDENT.finditer(text)], base)
    ends = _covered([("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)], base + idents)
    strong_ids = [s for s in base if s[0] == "access"]
    if not (idents or ends or strong_ids):
        return [], set()
    secrets = [("secret", *m.span()) for m in _TOKEN.finditer(text) if _random_looking(m[0])]
    secrets = _covered(secrets, base + idents + ends)
    strong_secrets = [s for s in base if s[0] != "access"]
    scopes = [0, *(m.end() for m in _BLANK.finditer(text)), len(text) + 1]

    def joined(spans: list, others: list) -> list:
        """Those of ``spans`` whose interval one of ``others`` overlaps."""
        others = sorted((a, b) for _, a, b in others)
        starts, out = [a for a, _ in others], []
        ends = list(accumulate((b for _, b in others), max))
        for kind, a, b in spans:
            scope = bisect_left(scopes, a + 1)
            low, high = scopes[scope - 1], scopes[scope]
            if reach is not None:
                low, high = max(a - reach, low), min(b + reach, high)
            i = bisect_left(starts, high)  # others that begin before the interval's end
            if i and ends[i - 1] > low:
                out.append((kind, a, b))
        return out

    all_ids, all_secrets = idents + strong_ids, secrets + strong_secrets
    with_secret, with_place = joined(all_ids, all_secrets), joined(all_secrets, all_ids + ends)
    found = set(with_secret + with_place + joined(joined(ends, all_ids), all_secrets))
    return sorted(found.difference(base)), found.intersection(base)


def _order(s: tuple[str, int, int]) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


def scan_text(text: str, reach: int | None = REACH) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans), each by start, then kind."""
    base = base_spans(text)
    return sorted(base, key=_order), sorted(linked_spans(text, base, reach)[0], key=_order)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("linked", pa.bool_())]))
_SPANS_SQL = "array<struct<kind: string, start: long, end: long, base: boolean, linked: boolean>>"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", reach: int | None = None) -> DataFrame:
    """(key, spans): every row's spans as structs of kind, start, end, base, linked, by start, then kind."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                rows = []
                for x in strings(part, 1):
                    base = base_spans(x)
                    added, strong = linked_spans(x, base, reach)
                    found = [(s, True, s in strong) for s in base] + [(s, False, True) for s in added]
                    rows.append([dict(zip(("kind", "start", "end", "base", "linked"), (*s, *marks), strict=True)) for s, *marks in sorted(found, key=lambda f: _order(f[0]))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _SPANS)], ["key", "spans"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, spans {_SPANS_SQL}").withColumnRenamed("key", key)


def joined(spans, only=None):
    """Spans column as kind:start:end, comma-joined."""
    spans = F.filter(spans, only) if only else spans
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", reach: int | None = None) -> DataFrame:
    """``df`` with every reported span of ``text`` replaced by ``mark`` (overlapping spans: once). Null texts stay null."""
    at, names = df.columns.index(text), df.columns

    def clean(x: str | None) -> str | None:
        if not x:
            return x
        base, added = scan_text(x, reach)
        out, done = [], 0
        for _, a, b in sorted(base + added, key=lambda s: s[1:]):
            if b <= done:
                continue
            if a >= done:
                out += [x[done:a], mark]
            done = b
        return "".join([*out, x[done:]]) if done else x

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, at):
                columns = [*part.columns]
                columns[at] = pa.array([clean(x) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)
