"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A vantage-point tree can't carry this: at a similarity of 0.8 two 64-bit fingerprints lie about ten bits apart, so
the radius must be thirteen or more, and a ball of thirteen bits crosses every median of fingerprints that lie 32
apart. So candidates come from least hashes: a text has BANDS keys of ROWS least shingle hashes each, and texts with a
key in common are candidates. A key's texts are compared with three pivots among them, not with each other, and each
candidate is confirmed on both texts' whole shingle sets (as 64-bit hashes). Candidates that confirmed links join
already aren't compared.

At a similarity of 0.8 a pair shares a key with probability 1 - (1 - 0.8^6)^28 = 0.9998, more above, and two texts may be
similar to each other and to no pivot. So an exact join follows, over what the keys' links leave in several components
(``prefixed``): two texts of a and b shingles are similar only if they have o = 4/9 (a + b) in common, so in any order of
all shingles the first one in common is among the first a - o + 1 of the one and b - o + 1 of the other. Rare shingles
come first in that order, hence a passage that many texts have brings none of them together unless it makes up nearly
all of them. The order's frequencies come from a bounded
sample and from counts of what is first by it; whatever they hold, no pair is lost but by equal 64-bit
hashes of different shingles.

Defined results: words are as in simhash; a text of fewer words than a shingle is similar to equal sequences only; a
null text is empty; an empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreflow.llm.common import batches_of, dropped, settled, slices, strings
from acreflow.llm.stars import components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 6
#: Odd multipliers, one a least hash: permutations of 32-bit numbers.
_FACTORS = np.random.default_rng(42).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
#: Shingles that are permuted at once (11 MB).
_STEP = 1 << 14


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending; none of fewer words than WIDTH."""
    if len(words) < WIDTH:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - WIDTH + 1
    h = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n])
    return np.unique(h)


def keys(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a text's shingles, as signed longs; none of no shingles."""
    if not len(found):
        return np.empty(0, np.int64)
    short, least = (found >> np.uint64(32)).astype(np.uint32), np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), _STEP):
        least = np.minimum(least, (short[at : at + _STEP] * _FACTORS[:, None]).min(1))
    h = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + least[i::ROWS])
    return h.view(np.int64)


def sketches(texts: DataFrame, fingerprint: Callable[[str], int]) -> DataFrame:
    """(row, digest, fp, size, bands) for each (row long, text): a digest of its words, its fingerprint, its number of
    distinct shingles and its keys."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                rows = []
                for text in strings(part, 1):
                    words = text.encode().lower().split()
                    own = shingles(words)
                    rows.append((xxhash.xxh3_128_digest(b" ".join(words)), fingerprint(text), len(own), keys(own)))
                digests, fps, sizes, bands = zip(*rows, strict=True)
                columns = [part.column(0), pa.array(digests, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "digest", "fp", "size", "bands"])

    return texts.mapInArrow(run, "row long, digest binary, fp long, size long, bands array<long>")


def _banded(reps: DataFrame) -> DataFrame:
    """(own, band): each text under each of its keys."""
    return reps.select(F.struct(F.xxhash64("key").alias("order"), "key", "size").alias("own"), F.explode("bands").alias("band"))


def candidates(reps: DataFrame) -> DataFrame:
    """(u, v, shared): u and a pivot v of a key of u, whose sizes allow the similarity; ``shared`` such keys.

    A key's pivots are its text of the least number and those of the least and greatest hash of it. All pairs with a
    pivot take part; they are linear in the keys' texts."""
    banded = _banded(reps)
    own, number = F.col("own"), F.struct("own.key", "own")
    pivots = banded.groupBy("band").agg(F.min(number).alias("first"), F.min(own).alias("low"), F.max(own).alias("high"), F.count("*").alias("n"))
    pivots = pivots.where("n > 1").select("band", F.explode(F.array_distinct(F.array("first.own", "low", "high"))).alias("pivot"))
    pairs = banded.join(pivots, "band").where("own.key != pivot.key").groupBy(own.alias("own"), "pivot").agg(F.count("*").alias("shared"))
    fits = F.least("own.size", "pivot.size") >= SIMILARITY * F.greatest("own.size", "pivot.size")
    return pairs.where(fits).select(F.col("own.key").alias("u"), F.col("pivot.key").alias("v"), "shared")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of those stored ``pairs`` that are similar; ``texts`` (row, text). Stored."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, None
        for batch in it:
            for part in slices(batch, 2):
                keep = []
                for v, a, b in zip(part.column(1).to_pylist(), strings(part, 2), strings(part, 3), strict=True):
                    if v != last:
                        last, seen = v, shingles(b.encode().lower().split())
                    own = shingles(a.encode().lower().split())
                    both = len(np.intersect1d(own, seen, assume_unique=True))
                    keep.append(both >= SIMILARITY * (len(own) + len(seen) - both))
                kept = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(i).filter(kept) for i in (0, 1)], ["u", "v"])

    asked = settled(pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct())
    own = settled(texts.join(asked, "row", "left_semi"))
    # The copies' texts come first, so that what a text with many copies draws has bytes by which it is split.
    drawn = pairs.select("u", "v").join(own.select(F.col("row").alias("u"), F.col("text").alias("a")), "u")
    drawn = drawn.join(own.select(F.col("row").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")
    with batches_of(pairs.sparkSession):
        found = settled(drawn.mapInArrow(run, "u long, v long"))
    dropped(asked, own)
    return found


#: Texts by which shingles are ranked at first, chosen by hash, and shingles that are known as frequent (4 MB).
RANKED, FREQUENT = 1 << 13, 1 << 18
#: Texts from which on a shingle is put back in the order, if it would bring components together.
OFTEN = 4
#: Parts of the shingles, by number, that the exact join takes one after the other: what it shuffles at once is one part.
PARTS = 4
#: Shared shingles before one's own by which two texts are known to have met already.
BEFORE = 8


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (u, root) after ``links`` (u, v) as well. Stored. Links become links between roots first, so that the
    components are sought among those that new links meet, not among all texts again."""
    top = lambda c: roots.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root"))
    ends = links.join(top("u"), "u", "left").join(top("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    more = settled(components(ends))
    moved = roots.join(more.select(F.col("u").alias("root"), F.col("root").alias("_to")), "root", "left")
    return settled(moved.select("u", F.coalesce("_to", "root").alias("root")).union(more.select("u", "root")))


def _frequent(reps: DataFrame, texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, ascending, and how many: the most frequent ones."""
    total = max(1, reps.count())
    bound = (1 << 64) * min(RANKED, total) // total - (1 << 63) - 1
    chosen = reps.where(F.xxhash64("key") <= F.lit(bound)).select(F.col("key").alias("row"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 0):
                found = [shingles(x.encode().lower().split()) for x in strings(part, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    tokens = texts.join(chosen, "row", "left_semi").select("text").mapInArrow(run, "token long")
    most = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    known, n = (most.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(known.view(np.uint64))
    return known.view(np.uint64)[order], n[order]


def ranked(found: np.ndarray, known: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first shingles of ``found`` in the order of frequency, then number: all by which a similar text may be met."""
    count = np.zeros(len(found), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        count = np.where(known[at] == found, n[at], 0)
    return found[np.argsort(count, kind="stable")[: len(found) + 1 + (-4 * len(found) // 5)]]


def _firsts(texts: DataFrame, tops: DataFrame, known: np.ndarray, n: np.ndarray) -> DataFrame:
    """(key, top, size, tokens) for each text of ``tops`` (key, top): its first shingles in the order. Stored.

    They are made where the texts are, since they take a third of a text's room."""
    shared = texts.sparkSession.sparkContext.broadcast((known, n))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                found = [shingles(x.encode().lower().split()) for x in strings(part, 1)]
                first = [ranked(x, *shared.value) for x in found]
                ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int32()), tokens], ["row", "size", "tokens"])

    with batches_of(texts.sparkSession):
        made = texts.select("row", "text").mapInArrow(run, "row long, size int, tokens array<long>")
        return settled(made.join(tops, F.col("row") == F.col("key")).select("key", "top", "size", "tokens"))


def _places(firsts: DataFrame, part: int) -> DataFrame:
    """(token, key, top, size, rest) for the tokens of one part; ``rest`` counts a text's shingles from that one on."""
    every = firsts.select("key", "top", "size", F.posexplode("tokens").alias("at", "token"))
    return every.where(F.pmod("token", F.lit(PARTS)) == part).select("token", "key", "top", "size", (F.col("size") - F.col("at")).alias("rest"))


def _between(places: DataFrame) -> DataFrame:
    """(token, n): tokens of several components, and in how many texts they are among the first."""
    seen = places.groupBy("token").agg(F.count("*").alias("n"), F.min("top").alias("a"), F.max("top").alias("b"))
    return seen.where("a != b").select("token", "n")


def _put_back(firsts: DataFrame, known: np.ndarray, n: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The order that the sample gave (``n`` of ``scale`` times as many texts), and in it those shingles that many texts
    have among their first, counted over all texts: the sample doesn't see what few of its texts have, and of more
    texts more have it."""
    parts = []
    for part in range(PARTS):
        often = _between(_places(firsts, part)).where(F.col("n") >= OFTEN)
        most = often.orderBy(F.desc("n"), "token").limit(FREQUENT // PARTS).toArrow()
        parts.append([most.column(i).to_numpy().astype(np.int64) for i in (0, 1)])
    tokens = np.concatenate([known, *(x[0].view(np.uint64) for x in parts)])
    counts = np.concatenate([np.rint(n * scale).astype(np.int64), *(x[1] for x in parts)])
    order = np.lexsort((-counts, tokens))
    tokens, first = np.unique(tokens[order], return_index=True)
    return tokens, counts[order][first]


def _met(members: DataFrame) -> DataFrame:
    """(u, v) of texts that meet at a shingle, from ``members`` (token, key, top, size, rest, before).

    Of a shingle's texts those of its largest component meet the others only, not each other. Texts that have many shingles in
    common meet at the first one of a part: it allows what later ones allow, since ``rest`` only falls, so a pair goes
    where one of the shingles just before is common as well."""
    main = members.groupBy("token", "top").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "top")).alias("most")).select("token", F.col("most.top").alias("main"))
    some = members.join(main, "token").where("top != main").select("token", "main", *[F.col(c).alias(f"_{c}") for c in ("key", "top", "size", "rest", "before")])
    near = 4 * (F.col("size") + F.col("_size")) <= 9 * F.least("rest", "_rest")
    once = (F.col("top") == F.col("main")) | (F.col("key") < F.col("_key"))
    met = members.join(some, "token").where((F.col("top") != F.col("_top")) & once & near & ~F.arrays_overlap("before", "_before"))
    return met.select(F.greatest("key", "_key").alias("u"), F.least("key", "_key").alias("v"))


def prefixed(reps: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): all pairs of texts of different components (``roots``: u, root) that may be similar by their numbers of
    shingles and the place of a common one in the order. Stored."""
    tops = settled(reps.where("size > 0").join(roots, F.col("key") == F.col("u"), "left").select("key", F.coalesce("root", "key").alias("top")))
    known, n = _frequent(reps, texts)
    firsts = _firsts(texts, tops, known, n)
    known, n = _put_back(firsts, known, n, max(1.0, reps.count() / RANKED))
    dropped(firsts)
    firsts, found = _firsts(texts, tops, known, n), []
    for part in range(PARTS):
        places = _places(firsts, part)
        mixed = settled(_between(places).select("token"))
        # Merged at any size, lest what is shuffled grow by a step where the tokens become too many to send around.
        before = Window.partitionBy("key").orderBy(F.desc("rest")).rowsBetween(-BEFORE, -1)
        members = settled(places.join(mixed.hint("merge"), "token").withColumn("before", F.collect_list("token").over(before)))
        found.append(settled(_met(members).distinct()))
        dropped(mixed, members)
    dropped(firsts, tops)
    pairs = settled(reduce(DataFrame.union, found).distinct())
    dropped(*found)
    return pairs


def joined(reps: DataFrame, texts: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, root) of the components of the stored ``edges`` (u, v), of which each u is there once and no v is a u, and of the
    links between similar texts.

    Each text is compared with the one of most shared keys first, then with those that it isn't joined to yet; then the exact
    join finds what keys have missed."""
    pairs = settled(candidates(reps))
    first = settled(pairs.groupBy("u").agg(F.max(F.struct("shared", (-F.col("v")).alias("v"))).alias("best")).select("u", (-F.col("best.v")).alias("v")))
    roots = _merged(edges.select("u", F.col("v").alias("root")), confirmed(first, texts))
    top = lambda c: roots.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root"))
    left = pairs.join(first, ["u", "v"], "left_anti").join(top("u"), "u", "left").join(top("v"), "v", "left")
    left = settled(left.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v"))
    roots = _merged(roots, confirmed(left, texts))
    more = prefixed(reps, texts, roots)
    return roots if more.isEmpty() else _merged(roots, confirmed(more, texts))
