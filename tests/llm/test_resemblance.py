"""Links between texts of similar five-word shingles, against brute force."""

import random

import numpy as np
import pytest

from acreflow.llm import resemblance, simhash


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def groups(links, n):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = top(i), top(j)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def corpus(seed, families, most):
    """Texts of 5 to ``most`` words: copies with words replaced, put in or cut, cut ends, shared passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    passage, texts = [word() for _ in range(60)], []
    for _ in range(families):
        base = [word() for _ in range(r.randint(5, most))]
        if r.random() < 0.3:
            base[2:2] = passage
        for _ in range(r.randint(1, 6)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 40))):
                at, what = r.randrange(len(own)), r.randrange(3)
                own[at : at + (what < 2)] = [word()] if what else []
            texts.append(" ".join(own[: len(own) - r.choice([0, 0, 0, len(own) // 12])]))
    return texts


def test_shingles_and_keys():
    text = "A b c d e F g a b c d e f g"
    own = resemblance.shingles(text.encode().lower().split())
    assert len(own) == len(plain_shingles(text)) and (np.diff(own.astype(object)) > 0).all()
    assert not len(resemblance.shingles(b"a b c d".split())) and not len(resemblance.keys(own[:0]))
    long = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 40_000, np.uint64))
    whole = [int(((long >> np.uint64(32)).astype(np.uint32) * f).min()) for f in resemblance._FACTORS[:3]]
    parts = [(x >> np.uint64(32)).astype(np.uint32) for x in np.array_split(long, 3)]
    assert whole == [min(int((x * f).min()) for x in parts) for f in resemblance._FACTORS[:3]]
    assert len(set(resemblance.keys(long).tolist())) == resemblance.BANDS


@pytest.mark.parametrize("seed", [1, 2])
def test_one_of_similar_against_brute_force(spark, seed):
    texts = corpus(seed, 60, 150)
    texts += [texts[0].upper(), texts[1] + "\n", None, "", "few words", "Few  words", "few word"]
    sets, n = [plain_shingles(t) for t in texts], len(texts)
    words = [(t or "").lower().split() for t in texts]
    fps = [simhash.fingerprint(t or "") for t in texts]
    near = [
        (i, j) for i in range(n) for j in range(i)
        if words[i] == words[j] or (fps[i] ^ fps[j]).bit_count() <= 3 or plain_similarity(sets[i], sets[j]) >= 0.8
    ]
    want = set(groups(near, n))
    assert sum((fps[i] ^ fps[j]).bit_count() > 3 for i, j in near) > 20  # beyond fingerprints
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    kept = simhash.one_of_similar(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == want


def test_candidates_keep_every_similar_pair(spark):
    texts = corpus(3, 80, 200)
    sets = [plain_shingles(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    sketched = resemblance.sketches(df, simhash.fingerprint).collect()
    near = [(i, j) for i in range(len(texts)) for j in range(i) if plain_similarity(sets[i], sets[j]) >= 0.8]
    bands = {x.row: set(x.bands) for x in sketched}
    assert len(near) > 50 and sum(bool(bands[i] & bands[j]) for i, j in near) >= 0.99 * len(near)


def test_of_an_empty_table_and_of_hot_copies(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.one_of_similar(empty).collect() == []
    base = [f"w{i * 7919 % 997}" for i in range(200)]
    rows = [(i, " ".join(base[: 100 + i % 3] + [f"z{i % 50}"] + base[100 + i % 3 :])) for i in range(400)] + [(1000 + i, " ".join(reversed(base))) for i in range(300)]
    assert {x.doc_id for x in simhash.one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 1000}


def test_keys_of_many_groups_lose_no_link(spark):
    """Every text under the same few keys: three pivots alone would miss most pairs; pairs of keys compare all of 14."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    texts = []
    for _ in range(7):
        base = [word() for _ in range(60)]
        texts += [" ".join(base), " ".join([*base[:-1], word()])]
    r.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    own = [resemblance.shingles(t.encode().split()) for t in texts]
    reps = spark.createDataFrame([(i, len(x), [0, 1, 2]) for i, x in enumerate(own)], "key long, size long, bands array<long>")
    roots = {x.u: x.root for x in resemblance.joined(reps, df, spark.createDataFrame([], "u long, v long")).collect()}
    sets = [plain_shingles(t) for t in texts]
    want = groups([(i, j) for i in range(14) for j in range(i) if plain_similarity(sets[i], sets[j]) >= 0.8], 14)
    assert [roots.get(i, i) for i in range(14)] == want and len(set(want)) == 7


@pytest.mark.parametrize("frequent", [0, 50, 1 << 17])
def test_pairs_without_a_common_key_are_linked(spark, monkeypatch, frequent):
    """No text has a key in common with another, so all links come from the exact join, whatever the sample knows."""
    monkeypatch.setattr(resemblance, "FREQUENT", frequent)
    texts = list(dict.fromkeys(corpus(7, 60, 150)))
    own = [resemblance.shingles(t.encode().split()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    reps = spark.createDataFrame([(i, len(x), [i]) for i, x in enumerate(own)], "key long, size long, bands array<long>")
    roots = {x.u: x.root for x in resemblance.joined(reps, df, spark.createDataFrame([], "u long, v long")).collect()}
    sets, n = [plain_shingles(t) for t in texts], len(texts)
    want = groups([(i, j) for i in range(n) for j in range(i) if plain_similarity(sets[i], sets[j]) >= 0.8], n)
    assert [roots.get(i, i) for i in range(n)] == want and len(set(want)) < n - 40


def test_passages_that_the_sample_misses_bring_no_pairs(spark, monkeypatch):
    """Forty texts with one passage of theirs: four sampled texts don't show it, so it must be found among all."""
    monkeypatch.setattr(resemblance, "RANKED", 4)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    passages = [[word() for _ in range(40)] for _ in range(6)]
    texts = [[*passages[i % 6], *(word() for _ in range(60))] for i in range(240)]
    texts = [" ".join(x) for x in [*texts, texts[7][:-2], texts[100][1:]]]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    reps = spark.createDataFrame([(i, len(plain_shingles(t)), [i]) for i, t in enumerate(texts)], "key long, size long, bands array<long>")
    pairs = {(x.u, x.v) for x in resemblance.prefixed(reps, df, spark.createDataFrame([], "u long, root long")).collect()}
    assert pairs >= {(240, 7), (241, 100)} and len(pairs) < 100


def test_what_was_shuffled_is_deleted(spark, tmp_path):
    from pathlib import Path

    held = lambda: sum(p.stat().st_size for b in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for p in Path(b.getPath()).rglob("shuffle_*"))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = spark.createDataFrame(list(enumerate(corpus(9, 60, 150))), "doc_id long, text string")
    before, setting = held(), spark.conf.get(name)
    kept = simhash.one_of_similar(df)
    assert held() <= before and spark.conf.get(name) == setting
    assert 0 < kept.count() < df.count()


def test_texts_of_many_common_shingles_meet_once_a_part(spark, monkeypatch):
    """Twenty texts that share three quarters of their words: each pair meets in every part, not at every shingle."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(120)]
    texts = [" ".join([*base, *(word() for _ in range(10))]) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    reps = spark.createDataFrame([(i, len(plain_shingles(t)), [i]) for i, t in enumerate(texts)], "key long, size long, bands array<long>")
    rows, met = [], resemblance._met

    def counted(members):
        rows.append(met(members).count())
        return met(members)

    monkeypatch.setattr(resemblance, "_met", counted)
    pairs = {(x.u, x.v) for x in resemblance.prefixed(reps, df, spark.createDataFrame([], "u long, root long")).collect()}
    assert pairs == {(i, j) for i in range(20) for j in range(i)}
    assert len(rows) == resemblance.PARTS and max(rows) <= 190
