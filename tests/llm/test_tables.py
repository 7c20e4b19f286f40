"""op2, op5, op8, op10 and the pipeline against plain versions."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from acreflow.llm import media, mixing, quality, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(n=300, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéAB") for _ in range(r.randint(1, 7)))
    rows = []
    for i in range(n):
        kind, size = r.random(), int(math.exp(r.uniform(0, 7)))
        words = [word() for _ in range(size)]
        if kind < 0.2:
            words = (words[:12] * (size // 12 + 2))[: size + 9]
        text = "".join(w + r.choice((" ", " ", " ", "\n", "  ", "\t", " ### ", " !! ")) for w in words)
        rows.append((i, text, r.choice(("a", "b", "ä", "", None, "c")), i % 2))
    return [*rows, (n, None, "a", 0), (n + 1, "", None, 1), (n + 2, " \n ", "solo", 0), (n + 3, "same words", "b", 0), (n + 3, "same words", "b", 0)]


# Mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[t] for t in names if t not in full) for s in names}
        above = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix_comes_near_its_targets(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, given = Counter(), Counter(), {}
    for r in got:
        n = len(WORD.findall(r.row.text or ""))
        assert r["size"] == n and 0 <= r.copies <= 3
        sizes[r.row.source] += n
        taken[r.row.source] += n * r.copies
        given[r.row.source] = (r.source_size, r.target)
    want = plain_targets(dict(sizes))
    for s, (size, target) in given.items():
        assert size == sizes[s] and abs(target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target) <= max(3, 0.02 * target), s
    again = sorted((r.row.doc_id, r.copies) for r in mixing.mix(df).collect())
    assert again == sorted((r.row.doc_id, r.copies) for r in got)
    assert mixing.repeated(df).columns == df.columns
    assert mixing.repeated(df).count() == sum(r.copies for r in got)


def test_mix_of_one_source_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, "d", "x")], "doc_id long, text string, source string")
    assert [(r.copies, r.target) for r in mixing.mix(df).collect()] == [(1, 4.0), (1, 4.0)]
    assert mixing.mix(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, " ", "x")], "doc_id long, text string, source string")
    assert [(r["size"], r.target) for r in mixing.mix(empty).collect()] == [(0, 0.0), (0, 0.0)]


def test_a_source_is_solved_exactly():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 9))
        words, tilt = r.integers(0, 50, n).astype(float), r.normal(0, 3, n)
        target = float(r.uniform(0, 3.0)) * words.sum()
        lam, rate = mixing.solve_source(words, tilt, target, 3.0)
        assert abs((words * rate).sum() - target) <= 1e-9 * max(1, target) and (rate <= 3).all() and (rate >= 0).all()
        if target > 0:
            assert np.allclose(rate, np.minimum(3, np.exp(lam + tilt)))
    assert np.allclose(mixing.solve_source(np.array([5.0, 7.0]), np.array([1.0, -1.0]), 36.0, 3.0)[1], 3)


def test_rates_solve_the_balancing_problem(spark):
    """Against a plain gradient ascent on the whole dual, and against rates that are one a source."""
    table = [("a", 60.0, [3, 6, 9], [40, 50, 30]), ("b", 160.0, [3, 7], [60, 40]), ("c", 30.0, [6, 9, 11], [10, 0, 90]), ("d", 30.0, [4], [10])]
    df = spark.createDataFrame(table, "sk string, target double, classes array<int>, words array<long>").repartition(3)
    wanted = mixing._wanted(df)
    mu = mixing.multipliers(df, wanted, 3.0)
    rates = {(x.sk, x.size_class): x.rate for x in mixing._tilted(df, mu, 3.0).collect()}
    x, lam, step = np.zeros(2), dict.fromkeys("abcd", 0.0), 0.5
    for _ in range(20_000):
        gradient = wanted - mixing.RIDGE * 280 * x
        for sk, target, classes, words in table:
            m, w = mixing.moments(np.array(classes, float)), np.array(words, float)
            rate = np.minimum(3, np.exp(lam[sk] + m @ x))
            gradient = gradient - (w * rate) @ m
            lam[sk] += step * (target - (w * rate).sum()) / w.sum()
        x = x + step * gradient / 280
    for sk, target, classes, words in table:
        m = mixing.moments(np.array(classes, float))
        own = [rates[sk, c] for c in classes]
        assert sum(w * r for w, r in zip(words, own, strict=True)) == pytest.approx(target, rel=1e-9)
        if sk != "d":
            assert np.allclose(own, np.minimum(3, np.exp(lam[sk] + m @ x)), atol=2e-3)
    assert rates["d", 4] == pytest.approx(3) and len({round(rates["a", c], 6) for c in (3, 6, 9)}) == 3
    lengths = lambda rate: sum(w * rate(sk, t, sum(ws), c) * mixing.moments(np.array(float(c))) for sk, t, cs, ws in table for c, w in zip(cs, ws, strict=True))
    own, flat = lengths(lambda sk, t, n, c: rates[sk, c]), lengths(lambda sk, t, n, c: t / n)
    assert np.abs(own - wanted).max() < 0.9 * np.abs(flat - wanted).max()
    with pytest.raises(ValueError):
        mixing.multipliers(df, wanted, 3.0, rounds=1)


def test_mix_query_against_plain_rules(spark, tmp_path):
    from acreflow.llm import q_mixing

    rows = [*documents(400, 9), (None, "no id here", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, `size.x` long").write.parquet(str(tmp_path / "documents.parquet"))
    got = q_mixing.op2_source_mix(spark, str(tmp_path)).collect()
    size = lambda text: len(WORD.findall(text or ""))
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += size(text)
    want, place = plain_targets(dict(sizes)), {(i, size(t), s) for i, t, s, _ in rows}
    source_of = {i: s for i, _, s, _ in rows}
    taken = Counter()
    for x in got:
        assert (x.doc_id, x["size"], source_of[x.doc_id]) in place and x.taken <= 3 * x["size"] and x.taken % max(1, x["size"]) == 0
        assert x.source_size == sizes[source_of[x.doc_id]] and x.target == pytest.approx(want[source_of[x.doc_id]])
        taken[source_of[x.doc_id]] += x.taken
    assert Counter(x.doc_id for x in got) == Counter(i for i, *_ in rows)
    assert all(abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]) for s in sizes)
    # Rates differ by document within a source.
    assert max(len({round(x.rate, 6) for x in got if source_of[x.doc_id] == s}) for s in sizes) > 3


# Quality


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_counts_and_base_rules(spark):
    rows = documents(200, 4) + [(900, "w " * 20_000, "a", 0), (901, "a b c d e f g h " * 3, "a", 0), (902, "x\nx\n \n \nx", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, words long")
    for r in quality.judged(df, []).collect():
        want = plain_counts(r.row.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)


def test_learned_list_separates_labelled_rows(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(600):
        low = i % 4 == 0
        rows.append((i, " ".join(word() + ("###" if low and r.random() < 0.5 else "") for _ in range(60)), int(not low)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = quality.fit(df.select("doc_id", "text"), df.where("doc_id < 300").select("doc_id", "quality"))
    assert rules and rules == quality.fit(df.select("doc_id", "text"), df.where("doc_id < 300").select("doc_id", "quality"))
    held = quality.judged(df, rules).where("row.doc_id >= 300").select("row.quality", "kept").collect()
    assert sum(x.kept == bool(x.quality) for x in held) >= 0.98 * len(held)
    assert quality.fit(df, df.where("quality = 1").select("doc_id", "quality")) == []
    assert quality.fit(df, df.limit(0).select("doc_id", "quality")) == []


# Media


def test_cuts_depend_on_the_payload_alone():
    r = random.Random(9)
    texts = ["", "short", "é" * 4000, "".join(r.choice("abc def\n") for _ in range(30_000)), "x" * 40_000]
    together = media.chunked(texts)
    for text, own in zip(texts, together, strict=True):
        assert media.chunked([text])[0] == own
        payload, n = media.payload_of(text)
        assert b"".join(x for _, x in own[1]) == payload and len(payload) % 576 == 0 and len(payload) > 0
        assert all(len(x) <= media.MOST for _, x in own[1]) and all(len(x) >= media.LEAST for _, x in own[1][:-1])
        assert media.read_manifest(own[0])[:2] == (n, len(payload))
    moved = media.chunked(["y" * 700 + texts[3]])[0][1]
    assert len({d for d, _ in moved} & {d for d, _ in together[3][1]}) > len(moved) // 2


def test_wrong_chunks_are_refused():
    manifest, named = media.chunked(["some text"])[0]
    with pytest.raises(ValueError):
        media.features(manifest, [b"\0" * len(named[0][1])])


def test_store_and_read_back(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh \n") for _ in range(20_000))
    rows = [(i, "".join(r.choice("abcdefgh \n") for _ in range(r.randint(0, 9000))), "x") for i in range(40)]
    rows += [(100, None, "x"), (101, "", "x"), (102, long, "x"), (103, long, "x"), (103, long, "x"), (104, "new start " + long, "x"), (105, long * 2, "x"), (None, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5)
    stored = media.store(df, pack_bytes=20_000)
    # Every distinct chunk is stored once, with its pack's data or as a shared one.
    size = lambda blob: len(zstandard.decompress(blob))
    held = sum(size(x.data) for x in stored.single.collect()) + sum(size(x.data) + size(x.open_data) + sum(map(size, x.own_data)) for x in stored.shared.collect())
    assert held == sum(map(len, {d: x for _, text, _ in rows for d, x in media.chunked([text or ""])[0][1]}.values()))
    assert stored.single.count() > 0 and stored.shared.where("size(wanted) > 0").count() > 0
    got = defaultdict(list)
    for x in media.read_back(stored).collect():
        got[x.doc_id].append(x)
    assert sum(map(len, got.values())) == len(rows)
    for key, text, _ in rows:
        payload, n = media.payload_of(text or "")
        for x in got[key]:
            assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({x.media_sha256 for k in (102, 103) for x in got[k]}) == 1 and got[None][0][1:] == got[0][0][1:]
    assert media.read_back(media.store(df.limit(0))).count() == 0


def test_packs_and_bit_table_change_nothing(spark, monkeypatch):
    rows = [(i, f"text {i // 3} " * 300) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(tuple(r) for r in media.read_back(media.store(df, pack_bytes=n)).collect()) for n in (1, 10_000, 1 << 20)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 12
    monkeypatch.setattr(media, "_table_of", lambda _: np.full(64, (1 << 64) - 1, np.uint64))  # every document may have shared chunks
    assert sorted(tuple(r) for r in media.read_back(media.store(df, pack_bytes=10_000)).collect()) == found[0]


def test_media_query_against_plain_payloads(spark, tmp_path):
    from acreflow.llm import q_media

    rows = [*documents(60, 3), (None, "no id", "a", 0), (500, "é" * 40_000, "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, key string, pack long").write.parquet(str(tmp_path / "documents.parquet"))
    got = q_media.op8_media_chunks(spark, str(tmp_path)).collect()
    told = lambda x: (x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32, x.media_bytes, x.media_sha256)
    want = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        manifest = media.chunked([text or ""])[0][0]
        want.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(manifest + payload), hashlib.sha256(manifest + payload).hexdigest()))
    assert Counter(map(told, got)) == Counter(want)


# URL lists


def test_screening_as_of_fetch_day(spark):
    d = datetime.date
    events = [
        ("l", "bad.example", "", "add", d(2024, 1, 10)), ("l", "bad.example", "", "remove", d(2024, 2, 1)), ("l", "bad.example", "", "add", d(2024, 2, 20)), ("l", "bad.example", "", "add", d(2024, 2, 25)),
        ("m", "bad.example", "/a/b", "add", d(2024, 1, 1)), ("l", "same.example", "", "add", d(2024, 1, 5)), ("l", "same.example", "", "remove", d(2024, 1, 5)),
    ]
    captures = [
        (1, "http://www.BAD.example/x", d(2024, 1, 9), False, ""), (2, "http://bad.example:80/x", d(2024, 1, 10), True, "l"), (3, "http://u@bad.example./a/b/c?q", d(2024, 1, 15), True, "l,m"),
        (4, "http://bad.example/a/bc", d(2024, 2, 1), False, ""), (5, "https://a.b.bad.example", d(2024, 3, 30), True, "l"), (6, "http://notbad.example/", d(2024, 3, 30), False, ""),
        (7, None, d(2024, 3, 1), False, ""), (8, "http://bad.example/", None, False, ""), (9, "nonsense", d(2024, 1, 20), False, ""), (10, "http://same.example/", d(2024, 1, 6), False, ""),
    ]
    rows = spark.createDataFrame([c[:3] for c in captures] * 2, "id long, url string, fetched date")
    ev = spark.createDataFrame(events, "list string, domain string, prefix string, action string, day date")
    got = {r.id: (r.blocked, r.lists) for r in urls.screened(rows, ev).collect()}
    assert got == {c[0]: c[3:] for c in captures}
    assert urls.screened(rows, ev.limit(0)).where("blocked").count() == 0
    assert urls.screened(rows.limit(0), ev).count() == 0


# Pipeline


def five_word_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline
    from acreflow.llm import q_bpe, simhash
    from acreflow.llm.secrets import scan_text

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    texts = [" ".join(word() for _ in range(r.randint(5, 90))) for _ in range(60)]
    texts += [texts[40], texts[41], texts[42] + " password=abcdefgh12", None]
    base = [word() for _ in range(90)]
    texts += [" ".join(base), " ".join([*base[:40], "other", *base[41:]])]  # similar, whatever their fingerprints
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "secret_scan", "source_mix", "byte_bpe"]
    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    assert {x.doc_id for x in kept.collect()} == {i for i, t in enumerate(texts) if not (plain_counts(t)[0] < 20 or 100 * plain_counts(t)[4] > 30 * plain_counts(t)[0])}
    single = stages["near_dedup"](spark, kept, str(tmp_path))
    fps = {x.doc_id: simhash.fingerprint(x.text) for x in kept.collect()}
    sets = {x.doc_id: five_word_shingles(x.text) for x in kept.collect()}
    # Documents within three bits, or similar by shingles of five words, are in one group, and those that a chain joins.
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    least = set()
    for a in fps:
        seen, new = {a}, {a}
        while new:
            new = {c for b in new for c in fps if near(b, c)} - seen
            seen |= new
        least.add(min(seen))
    assert {x.doc_id for x in single.collect()} == least and len(texts) - 2 in least and len(texts) - 1 not in least
    clean = stages["secret_scan"](spark, single, str(tmp_path))
    assert all(scan_text(x.text) == ([], []) and x.n_chars == len(x.text) for x in clean.collect())
    for stage in (kept, single, clean):
        assert stage.columns == docs.columns
    mixed = stages["source_mix"](spark, clean, str(tmp_path))
    assert mixed.columns == docs.columns
    want = Counter((x.doc_id, hashlib.sha256(x.text.encode()).hexdigest()) for x in mixed.collect())
    got = Counter((x.doc_id, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and q_bpe.coded(mixed).count() == sum(want.values())


def test_pipeline_with_a_learned_list_and_odd_rows(spark, tmp_path):
    """Low quality that only the labels tell, null and repeated ids, null and empty texts, clashing columns, repeats."""
    import corpus_pipeline

    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(240):
        low = i % 4 == 0
        text = " ".join(word() + ("###" if low and r.random() < 0.5 else "") for _ in range(60))
        rows.append((i, text, "en", f"s{i % 3}", len(text), i, "r"))
    rows += [(None, rows[1][1], "en", "s0", 1, 0, None), (None, " ".join(word() for _ in range(50)), None, None, None, None, None), (500, None, "en", "s0", 0, 0, "r"), (501, "", None, None, None, 1, "r"), rows[2], (502, rows[3][1] + " tail", "en", "s1", 9, 0, "r"), (503, " ".join(word() for _ in range(60_000)), "en", "s1", 9, 0, "r")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(160)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = Counter(x.doc_id for x in kept.collect())
    assert sum(i is not None and i % 4 == 0 for i in ids) <= 3 and sum(i is not None and i < 240 and i % 4 > 0 for i in ids) >= 176
    single = dict(corpus_pipeline.STAGES)["near_dedup"](spark, kept, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in single)[2] == 1 and rows[1][1] in {x.text for x in single} and sum(x.doc_id is None for x in single) == 2
    assert len({(x.doc_id is None, x.text) for x in single}) == len(single)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} <= {x.doc_id for x in single} and all(x.n_tokens > 0 for x in out)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 5)], "doc_id long, text string, source string, `size.x` long")
    assert mixing.repeated(df).columns == df.columns and quality.judged(df, []).select("row.*").columns == df.columns


def test_two_families_balance_together(spark):
    cells = [("a", "en", 100.0), ("a", "de", 50.0), ("b", "en", 30.0), ("b", "de", 70.0), ("c", "en", 10.0)]
    df = spark.createDataFrame(cells, "source string, lang string, size double")
    targets = {"source": {"a": 60.0, "b": 120.0, "c": 20.0}, "lang": {"en": 130.0, "de": 70.0}}
    x = mixing.balance(df, targets)
    rates = {(s, g): n * math.exp(x["source"][s] + x["lang"][g]) for s, g, n in cells}
    for s, want in targets["source"].items():
        assert sum(v for k, v in rates.items() if k[0] == s) == pytest.approx(want, rel=1e-6)
    for g, want in targets["lang"].items():
        assert sum(v for k, v in rates.items() if k[1] == g) == pytest.approx(want, rel=1e-6)
