"""SimHash near-duplicates, linked exactly within a Hamming radius through vantage-point trees.

Fingerprints are made where the texts are, then only distinct fingerprints travel. A vantage-point tree fitted on
a bounded sample splits them by distance to a pivot: those within a threshold go inside, the others outside, and
those whose ball crosses the boundary go to both sides, so by the triangle inequality every pair within the radius
meets in some shard. Each shard is a vantage-point tree again, whose leaves compare all pairs. A shard emits a
spanning forest of its links, not the pairs, and the forests join by connected components.

Defined results: a null or blank text has fingerprint zero, linked like any other; a text of fewer words than a
shingle is one shingle; equal fingerprints are one component; a null id takes part, and a component without ids
has a null id; an empty table gives an empty result; the input's other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreflow.llm import resemblance
from acreflow.llm.common import batches_of, cleaned_up, dropped, released, settled, slices, strings
from acreflow.llm.stars import components

#: Fingerprints that a shard holds. Each level of the upper tree copies about a third of what it splits, while the
#: tree within a shard copies in memory only: so shards are large, and no deeper than memory and parallel work ask.
SHARD = 65_536
#: Fingerprints, chosen by hash, on which the upper tree is fitted: about so many for each shard, within these bounds
#: (8 MB at most come to the driver, as numbers). Its splits get even by them; its links are exact whatever the sample.
SAMPLE, LEAST_SAMPLE, MOST_SAMPLE = 256, 8_192, 1 << 20
#: A shard that turns out to hold more than so many times its size is split again, on a sample of its own.
OVERSIZE = 4
#: Fingerprints below which all pairs are compared.
LEAF = 1_024


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash, as an unsigned integer, of word shingles with ASCII letters lowered."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in joined), "<u8", max(1, len(words) - width + 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp long) for every row; the bits of fp are the fingerprint's."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                fps = np.array([fingerprint(x, width, seed) for x in strings(part, 1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["key", "fp"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, fp long")


def _distance(fps: np.ndarray, pivot: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ pivot).astype(np.int16)


def _split(fps: np.ndarray, radius: int, tries: int = 6) -> tuple[np.uint64, int, bool] | None:
    """Pivot, threshold, and whether the ball's crossing goes inward, for the split with the least larger side.

    Inside: distance <= threshold. None if each split tried leaves nearly everything on one side."""
    best, found = 0.9 * len(fps), None
    for i in range(tries):
        pivot = fps[(i * 2654435761) % len(fps)]
        seen = np.cumsum(np.bincount(_distance(fps, pivot), minlength=65))
        at = lambda t: seen[min(64, max(t, 0))] if t >= 0 else 0
        for t in range(64):
            inside, outside = at(t), len(fps) - at(t)
            for inward, sides in ((False, (inside, outside + inside - at(t - radius))), (True, (at(t + radius), outside))):
                if max(sides) < best:
                    best, found = max(sides), (pivot, t, inward)
    return found


def _sides(fps: np.ndarray, split: tuple[np.uint64, int, bool], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprints go inside and which outside; those that both need are in both."""
    pivot, t, inward = split
    d = _distance(fps, pivot)
    return (d <= t + radius, d > t) if inward else (d <= t, d > t - radius)


class UpperTree:
    """Splits fitted on a sample; every fingerprint goes to each shard that its ball can reach."""

    def __init__(self, sample: np.ndarray, total: int, radius: int, shard: int = SHARD):
        self.radius, self.shards, self.split_again = radius, 0, {}
        self.root = self._grow(sample, total, shard)

    def refine(self, leaf: int, sample: np.ndarray, total: int, shard: int) -> bool:
        """Splits the shard ``leaf`` again, by a sample of it; False if nothing splits it (a dense ball)."""
        node = self._grow(sample, total, shard)
        self.split_again[leaf] = node
        return not isinstance(node, int)

    def _grow(self, sample: np.ndarray, total: float, shard: int):
        split = _split(sample, self.radius) if total > shard and len(sample) >= 64 else None
        if split is None:
            self.shards += 1
            return self.shards - 1
        sides = [sample[x] for x in _sides(sample, split, self.radius)]
        return split, *(self._grow(x, total * len(x) / len(sample), shard) for x in sides)

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and their shards."""
        rows, shards, open_ = [], [], [(self.root, np.arange(len(fps)))]
        while open_:
            node, at = open_.pop()
            while isinstance(node, int) and node in self.split_again:
                node = self.split_again[node]
            if isinstance(node, int):
                rows.append(at)
                shards.append(np.full(len(at), node, np.int32))
            elif len(at):
                open_ += [(child, at[x]) for child, x in zip(node[1:], _sides(fps[at], node[0], self.radius), strict=True)]
        return np.concatenate(rows), np.concatenate(shards)


def _reach(near, n: int) -> list[np.ndarray]:
    """Components with links, of places 0..n-1. near(frontier, rest): which of rest are linked to the frontier."""
    rest, found = np.arange(n), []
    while len(rest):
        group, frontier, rest = [rest[:1]], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            hit = near(frontier, rest)
            frontier, rest = rest[hit], rest[~hit]
            group.append(frontier)
        if len(group) > 1 and len(x := np.concatenate(group)) > 1:
            found.append(x)
    return found


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (two arrays of places) that span the components of distinct fingerprints within the radius."""
    parent = np.arange(len(fps))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def take(group: np.ndarray) -> None:
        first = top(int(group[0]))
        for i in group[1:].tolist():
            parent[top(i)] = first

    open_ = [np.arange(len(fps))]
    while open_:
        at = open_.pop()
        own = fps[at]
        if len(at) <= LEAF:
            linked = np.bitwise_count(own[:, None] ^ own[None, :]) <= radius
            busy = np.flatnonzero(linked.sum(1) > 1)
            linked = linked[np.ix_(busy, busy)]
            for group in _reach(lambda f, r, x=linked: x[np.ix_(f, r)].any(0), len(busy)):
                take(at[busy[group]])
        elif (split := _split(own, radius)) is not None:
            open_ += [at[x] for x in _sides(own, split, radius)]
        else:  # a dense ball: whatever is reached needs no more comparisons with what was reached before

            def near(f: np.ndarray, r: np.ndarray, x: np.ndarray = own) -> np.ndarray:
                hit = np.zeros(len(r), bool)
                for i in range(0, len(f), 64):
                    left = np.flatnonzero(~hit)
                    hit[left] = (np.bitwise_count(x[f[i : i + 64], None] ^ x[r[left]]) <= radius).any(0)
                return hit

            for group in _reach(near, len(at)):
                take(at[group])
    moved = np.flatnonzero(parent != np.arange(len(fps)))
    return moved, np.array([top(int(i)) for i in moved], np.int64)


def _bound(wanted: int, rows: int) -> int:
    """The 64-bit hash at or below which ``wanted`` of ``rows`` rows lie."""
    return (1 << 64) * min(wanted, rows) // rows - (1 << 63) - 1


def links(fps: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(u, v) longs: links that span the components of the distinct fingerprints ``fps`` (column fp, stored)."""
    spark, total = fps.sparkSession, fps.count()

    def sampled(df: DataFrame, rows: int, wanted: int) -> DataFrame:
        """About ``wanted`` of the ``rows`` of ``df``, those of the least hashes."""
        return df if rows <= wanted else df.where(F.xxhash64("fp") <= F.lit(_bound(wanted, rows)))

    def collected(df: DataFrame) -> np.ndarray:
        # In order of their hashes, so that pivots don't depend on partitions.
        return df.select("fp").orderBy(F.xxhash64("fp"), "fp").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)

    size = min(MOST_SAMPLE, max(LEAST_SAMPLE, SAMPLE * total // shard))
    tree = UpperTree(collected(sampled(fps.select("fp"), total, size)), total, radius, shard)

    def routed() -> DataFrame:
        shared = spark.sparkContext.broadcast(tree)

        def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                rows, shards = shared.value.route(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(own[rows])], ["shard", "fp"])

        return fps.select("fp").mapInArrow(route, "shard int, fp long")

    # Routed once, stored as numbers, for the shards' counts and their links; again only if a shard is split.
    shards, dense = (settled(routed()) if total > shard else routed()), set()
    while total > shard:
        counts = {r["shard"]: r["count"] for r in shards.groupBy("shard").count().where(F.col("count") > OVERSIZE * shard).collect() if r["shard"] not in dense}
        if not counts:
            break
        again = sorted(counts, key=lambda k: -counts[k])[: MOST_SAMPLE // LEAST_SAMPLE]  # the others in the next round
        part = F.create_map(*[F.lit(x) for k in again for x in (k, _bound(LEAST_SAMPLE, counts[k]))])
        some = shards.where(F.col("shard").isin(again)).where(F.xxhash64("fp") <= F.element_at(part, F.col("shard")))
        rows = some.select("shard", "fp").orderBy("shard", F.xxhash64("fp"), "fp").toArrow()
        whose, held = (rows.column(i).to_numpy() for i in (0, 1))
        for k in again:
            own = held[slice(*np.searchsorted(whose, [k, k + 1]))].astype(np.int64).view(np.uint64)
            if not tree.refine(k, own, counts[k], shard):
                dense.add(tree.split_again[k])
        dropped(shards)
        shards = settled(routed())

    def link(batch: pa.Table) -> pa.Table:
        own = np.sort(batch.column("fp").to_numpy())
        u, v = forest(own.view(np.uint64), radius)
        return pa.table({"u": own[u], "v": own[v]})

    return shards.groupBy("shard").applyInArrow(link, "u long, v long")


def _grouped(made: DataFrame, radius: int, shard: int) -> DataFrame:
    """(key, fp, component_id) for the stored rows ``made`` (key, fp)."""
    fps = settled(made.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(links(fps, radius, shard))
    rooted = fps.join(roots, fps.fp == roots.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("fp", "component_id")
    return made.select("key", "fp").join(found, "fp").select("key", "fp", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(key, fingerprint, component_id): the fingerprint in hex and the least key reachable, itself included."""
    found = _grouped(settled(fingerprints(df, key, text, width)), radius, shard)
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that stand for their near-duplicate components: one with the least doc_id, and one of those
    without an id, if there are any.

    Rows are told apart by a number that they get when they are stored, so neither repeated nor missing ids matter.
    What goes is joined away, the smaller set."""
    rows = settled(df.withColumn("_row", F.monotonically_increasing_id()))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("_row").alias("row")).alias("_key")
    found = near_duplicates(rows.select(key, options.get("text", "text")), key="_key", **options).select("_key", "component_id")
    # Rows with an id come first in a component; those without one have a least one of their own.
    named = found.where("not _key.no_id and _key != component_id")
    bare = found.where("_key.no_id")
    least = bare.groupBy("component_id").agg(F.min("_key").alias("_least"))
    bare = bare.join(least, "component_id").where("_key != _least")
    gone = named.union(bare.select("_key", "component_id")).select("_key.row")
    return rows.join(gone, rows._row == gone.row, "left_anti").select(df.columns)


def one_of_similar(df: DataFrame, text: str = "text", width: int = 3, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Like ``one_of_each``, and texts of similar five-word shingles (``resemblance``) are linked as well; a group is
    what links of either kind reach. Equal sequences of words travel once."""
    rows = settled(df.withColumn("_row", F.monotonically_increasing_id()))
    with released() as keep, cleaned_up(df.sparkSession):
        key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("_row").alias("row"))
        texts = rows.select(F.col("_row").alias("row"), F.col(text).alias("text"))
        with batches_of(df.sparkSession):
            sketched = settled(resemblance.sketches(texts, lambda x: fingerprint(x, width)))
        reps = settled(sketched.groupBy("digest").agg(F.min("row").alias("key"), *[F.first(c).alias(c) for c in ("fp", "size", "bands")]))
        near = _grouped(reps.select("key", "fp"), radius, shard).where("key != component_id").select(F.col("key").alias("u"), F.col("component_id").alias("v"))
        roots = resemblance.joined(reps, texts, settled(near))
        rooted = reps.join(roots, reps.key == roots.u, "left").select("digest", F.coalesce("root", "key").alias("root"))
        keys = rows.select("_row", key.alias("_key")).join(sketched.select("row", "digest").join(rooted, "digest"), F.col("_row") == F.col("row")).select("_key", "root")
        least = keys.groupBy("root", "_key.no_id").agg(F.min("_key").alias("_least"))
        gone = keep(keys.select("*", "_key.no_id").join(least, ["root", "no_id"]).where("_key != _least").select("_key.row"))
    return rows.join(gone, rows._row == gone.row, "left_anti").select(df.columns)
