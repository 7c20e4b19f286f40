"""Importance resampling, periodic runs and decontamination against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest

from acreflow.llm import common, decontaminate, importance, periodic, q_decontaminate, q_importance, q_periodic

SCHEMA = "doc_id long, text string, key string, score long, n_words long, spans string"
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def texts(n, seed):
    """Prose of few words, so that windows, runs and ties occur, with odd characters."""
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "dél", "x1", "日本", "o'k", "a-b", "É", "the", "of"]
    for i in range(n):
        kind, size = i % 6, r.randrange(1, 120)
        some = [r.choice(words[: 3 + i % 9]) for _ in range(size)]
        if kind == 3:
            some = some[: 1 + i % 5] * r.randrange(2, 30)
        yield r.choice((" ", "  ", "\n", " ,\t", "\x0b")).join(some)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("resampling")
    r = random.Random(4)
    docs = [(i, t) for i, t in enumerate(texts(240, 1))]
    docs += [(500, None), (501, ""), (502, " \n"), (None, "no id alpha beta " * 30), (None, None), (503, "word " * 40_000), (504, "x" * 90_000), (505, " ".join(r.choice("ab") for _ in range(3000)))]
    docs += [(7, "twice the same of " * 9)] * 3 + [(8, "twice the same of " * 9)]
    items = [(i, t) for i, t in enumerate(texts(30, 2))]
    items += [(100, None), (101, ""), (102, "alpha"), (103, "Beta gamma"), (103, "alpha alpha x1 x1 x1 alpha"), (104, docs[5][1]), (None, "twice the same"), (105, "never seen words " * 9)]
    items += [(106, " ".join(docs[11][1].split()[:14])), (9, "x" * 90_000)]
    spark.createDataFrame([(i, t, "k", 1, 2, "s") for i, t in docs], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id long").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, items


def plain_features(text, longest):
    words = PLAIN.findall(lowered(text))
    return [" ".join(words[i : i + k]).encode() for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_resampling(docs, items, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    count = lambda rows: Counter(crc32(f) % buckets for _, t in rows for f in plain_features(t, longest))
    s, t = count(docs), count(items)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        found = plain_features(text, longest)
        weight = sum(gain(crc32(f) % buckets) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(plain_features(text, 1)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranked = [(*r[:1], *r[2:], n if n <= percent * len(fit) // 100 else None) for n, r in enumerate(fit, 1)]
    return Counter(ranked + [(*r[:1], *r[2:], None) for r in rows if r[1] < least])


def test_resampling_query(spark, folder):
    got = q_importance.op11_importance_resampling(spark, folder[0])
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_resampling(*folder[1:])


@pytest.mark.parametrize("longest, percent", [(2, 35), (3, 100), (5, 0)])
def test_resampling_of_longer_runs(spark, folder, longest, percent, monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", 64)  # words of a text come in many lists
    _, docs, items = folder
    d, b = (spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "benchmark"))
    got = importance.resampled(d, b, longest, 997, percent, 5, 3)
    assert Counter(map(tuple, got.collect())) == plain_resampling(docs, items, longest, 997, percent, 5, 3)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_ring_equals_whole_runs(piece, monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", piece)
    for text in [*texts(20, 5), ""]:
        for longest in (1, 2, 4):
            got = Counter(b for _, some in importance.ring_buckets(text.encode(), longest, 1 << 32) for b in some.tolist())
            assert got == Counter(map(crc32, plain_features(text, longest)))


def test_resampling_of_empty_tables_and_towards_nothing(spark, folder):
    d, b = (spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "benchmark"))
    assert importance.resampled(d.limit(0), b).count() == 0
    assert Counter(map(tuple, importance.resampled(d, b.limit(0)).collect())) == plain_resampling(folder[1], [])
    kept = importance.drawn(d, b, percent=30)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()


def test_resampling_draws_towards_the_target(spark):
    r = random.Random(6)
    prose = lambda words: " ".join(r.choice(words) for _ in range(60))
    rows = [(i, prose("abcdefgh" if i % 10 else "uvwxyz")) for i in range(600)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(prose("uvwxyz"),) for _ in range(20)], "text string")
    assert {x.doc_id % 10 for x in importance.drawn(docs, target).collect()} == {0}


def plain_runs(words, least=6, times=4):
    """Every maximal stretch of every period, the smallest period first."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i:
                found.setdefault((i, j + p), p)
            i = j + 1 if j == i else j
    return sorted(((a, b - a, p) for (a, b), p in found.items() if b - a >= max(least, times * p)), key=lambda r: (r[0], r[2]))


def plain_report(i, text, plant=True):
    words = SPACED.findall(text or "")
    n, h = len(words), crc32(str(i).encode())
    if plant and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = plain_runs(words) if n < 5000 else [(0, n, 1)]  # the longest text of the fixture is one word
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (i, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_query(spark, folder):
    got = q_periodic.op12_periodic_runs(spark, folder[0])
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = Counter(plain_report(i, t) for i, t in folder[1])
    assert Counter(map(tuple, got.collect())) == want and sum(w[1] > 0 for w in want) > 30


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_all_periods_tried(seed):
    r = random.Random(seed)
    for _ in range(400):
        k, n = r.choice((1, 2, 3, 6)), r.randrange(90)
        w = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.6:
            a = r.randrange(n)
            p = 1 + r.randrange(max(1, (n - a) // 3))
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
        least, times = r.choice((1, 6)), r.choice((2, 3, 4, 5))
        assert periodic.find_runs(np.array(w, np.int32), least, times) == plain_runs(w, least, times)


def test_runs_of_long_texts():
    one = np.zeros(300_000, np.int32)
    assert periodic.find_runs(one) == [(0, 300_000, 1)]
    one[100_000] = 1
    assert periodic.find_runs(one) == [(0, 100_000, 1), (100_001, 199_999, 1)]
    block = np.random.default_rng(1).integers(0, 50, 7000)
    long = np.concatenate([block[:999], np.tile(block, 9), block[:5]])
    assert (999, 63_005, 7000) in periodic.find_runs(long)
    with pytest.raises(ValueError):
        periodic.find_runs(one, 6, 1)


def test_collapsed_texts(spark):
    rows = [(1, "a b a b a b a b c", "x"), (2, "no  run\there", "y"), (3, None, None), (4, "", "z"), (5, "go " * 50_000, None)]
    docs = spark.createDataFrame(rows, "id long, text string, start string")
    got = periodic.collapsed(docs)
    assert got.columns == docs.columns
    assert {x.id: x.text for x in got.collect()} == {1: "a b c", 2: "no  run\there", 3: None, 4: "", 5: "go"}
    assert periodic.collapsed(docs.limit(0)).count() == periodic.detected(docs.limit(0), key="id").count() == 0


def plain_hits(docs, items, window=10):
    wins = set()
    for i, t in items:
        w = PLAIN.findall(lowered(t))
        wins |= {(tuple(w[k : k + window]), "" if i is None else str(i)) for k in range(max(1, len(w) - window + 1)) if w}
    held = {}
    for g, i in wins:
        held.setdefault(g, set()).add(i)
    sizes = {len(g) for g in held}
    for i, t in docs:
        w = PLAIN.findall(lowered(t))
        hit, names = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if own := held.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    names |= own
        yield i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontamination_query(spark, folder):
    got = q_decontaminate.op13_decontaminate(spark, folder[0])
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = Counter(plain_hits(*folder[1:]))
    assert Counter(map(tuple, got.collect())) == want and len({w[3] for w in want}) > 5


@pytest.mark.parametrize("shard, piece, window", [(40, 8, 10), (300, 1, 3), (1 << 17, 5, 2)])
def test_many_shards_and_pieces_change_nothing(spark, folder, monkeypatch, shard, piece, window):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    _, docs, items = folder
    few = [r for r in items if r[0] != 102][:12]  # every shard is a pass
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(few, "item_id long, text string")
    got = decontaminate.matched(d, b, window, shard_words=shard).collect()
    digest = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()
    assert Counter((x.doc_id, x.n_words, x.n_hit, len(x["items"]), digest(x["items"]), bool(x.spans)) for x in got) == Counter(plain_hits(docs, few, window))
    assert all(x.longest == max((s.end - s.start for s in x.spans), default=0) and x.n_hit == sum(s.end - s.start for s in x.spans) for x in got)


def test_automaton_tracks_the_longest_match():
    r = random.Random(3)
    for _ in range(60):
        sequences = [[r.randrange(3) for _ in range(r.randrange(1, 14))] for _ in range(r.randrange(1, 6))]
        a = decontaminate.SuffixAutomaton()
        for s in sequences:
            a.add(s)
        parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)}
        text = [r.randrange(4) for _ in range(50)]
        for i, (v, size) in enumerate(a.matches(text), 1):
            assert size == max(m for m in range(i + 1) if tuple(text[i - m : i]) in parts)
            for m in range(1, size + 1):  # equal strings have one state, whatever the match
                assert a.locus(v, m) == a.locus(list(a.matches(text[i - m : i]))[-1][0], m)


def test_cleaning(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"Clean words, before. {item.upper()}! And (after) it come more and more words, so that it stays.", 7), (2, item, 8), (3, "nothing of it", 9), (4, None, 1), (4, None, 1), (None, f"{item} a b c", 2), (5, "one two three", 3)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string, n_words long"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.cleaned(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "Clean words, before. ! And (after) it come more and more words, so that it stays.", 7), (3, "nothing of it", 9), (4, None, 1), (4, None, 1), (5, "one two three", 3)], key=repr)
    some = {x.doc_id: x.text for x in decontaminate.cleaned(docs, items, coverage=1.0).collect()}
    assert some[2] == "" and some[None] == " a b c"
    assert {x.doc_id: x.text for x in decontaminate.cleaned(docs, items, least=13, coverage=1.0).collect()}[2] == item
    assert decontaminate.cleaned(docs.limit(0), items).count() == 0 and decontaminate.cleaned(docs, items.limit(0)).count() == len(rows)


@pytest.mark.parametrize("module", [q_importance, q_decontaminate])
def test_sql_of_new_queries(spark, module):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in module.ORACLES.items():
        got = module.QUERIES[name](spark, sf)
        none = lambda v: None if v is None or v != v else v
        want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert Counter(tuple(map(none, r)) for r in got.collect()) == Counter(tuple(map(none, r)) for r in want)
