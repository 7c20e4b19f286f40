"""op4 against brute force."""

import random

import numpy as np
import pytest
import xxhash

from acreflow.llm import simhash
from acreflow.llm.stars import components


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=3):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "Ä É a b c d e", "x y z " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def cloud(n, seed, spread=5):
    """Fingerprints around a few centres, with a dense ball and strangers."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(12)]
    out = {r.getrandbits(64) for _ in range(n // 3)}
    while len(out) < n:
        x = r.choice(centres)
        for _ in range(r.randint(0, spread)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("leaf", [8, 64, 4096])
def test_forest_spans_the_components(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    fps = cloud(700, 5)
    u, v = simhash.forest(np.array(fps, np.uint64), 3)
    parent = list(range(len(fps)))
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    assert [top(i) for i in range(len(fps))] == classes(fps)


def test_every_pair_meets_in_a_shard():
    fps = np.array(cloud(1500, 8), np.uint64)
    tree = simhash.UpperTree(fps[::2], len(fps), 3, 100)
    rows, shards = tree.route(fps)
    assert tree.shards > 4 and set(rows.tolist()) == set(range(len(fps)))
    where = {}
    for i, s in zip(rows.tolist(), shards.tolist(), strict=True):
        where.setdefault(i, set()).add(s)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for i, j in zip(*np.nonzero(near), strict=True):
        assert where[int(i)] & where[int(j)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (300, 301)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(found[i] == 0 for i in range(1, 41)) and all(found[100 + i] == 100 for i in range(1, 30)) and found[301] == 300 and 200 not in found
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_operator_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows, i = [], 0
    for _ in range(40):
        base = [word() for _ in range(120)]
        for _ in range(r.randint(1, 4)):
            own = list(base)
            for _ in range(r.randint(0, 2)):
                own[r.randrange(120)] = word()
            rows.append((i, " ".join(own), "x"))
            i += 1
    rows += [(i, None, "x"), (i + 1, "  \n", "x"), (i + 2, rows[0][1], "y"), (i + 3, "short", "x"), (i + 3, "short", "x")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df, shard=40).collect()}
    distinct = {}
    for key, text, _ in sorted(rows):
        distinct.setdefault(plain_fingerprint(text or ""), []).append(key)
    fps = list(distinct)
    roots = classes(fps)
    least = {}
    for fp, root in zip(fps, roots, strict=True):
        least[root] = min(least.get(root, 10**9), min(distinct[fp]))
    for fp, root in zip(fps, roots, strict=True):
        for key in distinct[fp]:
            assert got[key] == (f"{fp:016x}", least[root])
    kept = simhash.one_of_each(df.select("doc_id", "text")).count()
    assert kept in (len(set(roots)), len(set(roots)) + 1)  # the repeated row with one id stays repeated
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    with_null = df.select("doc_id", "text").union(spark.createDataFrame([(None, rows[0][1])], "doc_id long, text string"))
    assert simhash.one_of_each(with_null).where("doc_id is null").count() == 1


def test_one_row_of_each_component_stays(spark):
    a, b, c = ("one text of several words " * 3, "quite another thing that stands here alone", "a third one with yet other words in it")
    rows = [(5, a, 0), (9, a, 1), (9, b, 2), (7, c, 3), (7, c, 4), (None, "no id " + b, 5), (None, "no id " + b, 6), (None, a, 7), (None, a, 8)]
    kept = sorted((x.n, x.doc_id, x.text) for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect())
    assert [(x, t) for _, x, t in kept] == [(5, a), (9, b), (7, c), (None, "no id " + b), (None, a)]
