"""Target-distribution importance resampling: documents are drawn by how much likelier their hashed word runs are in a
target's texts than in the corpus.

A streaming CRC ring makes the features: one scan keeps the running zlib states of the last n starts and extends each
by a space and the next word, so every run of 1 to n words costs one update. Two scans of the corpus: one counts
buckets, one sums the gains of each document. Between them stand the counts of the buckets alone, whose number is a
parameter; they are combined in each task before the shuffle.

Defined results: a null text has no words, so no features and weight 0; a null id hashes as an empty one and ranks
after others of its score; rows of one id share their random part, and repeated rows take ranks one after the other;
an empty corpus gives an empty result, an empty target one in which all gains are those of a target of no features;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreflow.llm.common import PLAIN, dropped, raw_strings, settled, slices, word_lists


def ring_buckets(text: bytes, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end in them), some words of ``text`` at a time.

    The ring is laid out by length: ``ring[k]`` is the state of the start k words back, [] where the text is shorter."""
    ring: list[list[int]] = [[] for _ in range(longest)]
    for words in word_lists(text, PLAIN):
        states = list(map(crc32, words))
        found = [states]
        spaced = [b" " + w for w in words] if longest > 1 else words
        for k in range(1, longest):
            before = ring[k - 1] + states[:-1]
            ring[k - 1] = states[-1:] or ring[k - 1]
            states = list(map(crc32, spaced[len(words) - len(before) :], before))
            found.append(states)
        every = [s for level in found for s in level]
        yield len(words), np.fromiter(every, np.int64, len(every)) % buckets


def bucket_counts(texts: DataFrame, longest: int, buckets: int, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts: ``buckets`` numbers, whatever the size of the table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in it:
            for part in slices(batch, 0):
                for x in raw_strings(part, 0):
                    for _, found in ring_buckets(x, longest, buckets):
                        n += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(n[held], pa.int64())], ["bucket", "n"])

    sums = texts.select(texts[text].alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 ln of its smoothed share in the target over that in the corpus), in doubles."""
    m, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight) of every row: the sum of the gains of its features. Narrow, one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in it:
            for part in slices(batch, 1):
                rows = []
                for x in raw_strings(part, 1):
                    n = features = weight = 0
                    for some, found in ring_buckets(x, longest, len(own)):
                        n, features, weight = n + some, features + len(found), weight + int(own[found].sum())
                    rows.append((n, features, weight))
                n = np.array(rows, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(n[:, i]) for i in range(3))], ["key", "n_words", "n_features", "weight"])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int) -> DataFrame:
    """Adds score: the weight and a Gumbel number of the id, both in thousandths, so that the highest scores are a draw
    without replacement."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
    key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row; rank is null where the row isn't drawn.

    Of the N rows of ``least_words`` or more, floor(percent N / 100) of the highest scores are drawn, ties to the lesser
    id. Ranks: scores (a few bytes a row, no texts) are sorted by range, and each range adds the rows before it."""
    gain = gains(bucket_counts(docs, longest, buckets, text), bucket_counts(target, longest, buckets, target_text))
    rows = settled(scored(weighed(docs, gain, longest, key, text), seed))
    # The row number keeps rows that are equal in all else from being one key of the ranges.
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("number")]
    numbered = rows.withColumns({"fit": F.col("n_words") >= least_words, "number": F.monotonically_increasing_id()})
    # Within a range the ids grow by one from the range's number times 2 to the power 33.
    ranges = settled(numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()).withColumns({"range": F.shiftright("id", 33), "place": F.col("id").bitwiseAND((1 << 33) - 1)}).drop("number", "id", "n_words"))
    dropped(rows)
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"), F.count_if("fit").alias("n_fit"))  # a row a range
    before = counts.select("range", "n_fit", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    drawn = int(before.agg(F.sum("n_fit")).first()[0] or 0) * percent // 100
    rank = F.col("before") + F.col("place") + 1
    out = ranges.join(F.broadcast(before.select("range", "before")), "range")
    return out.select("key", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank")).withColumnRenamed("key", key)


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn. Ids that stand on several rows are drawn together if any is."""
    ids = resampled(docs, target, key=key, **options).where("rank is not null").select(F.col(key).alias("_id")).distinct()
    return docs.join(ids, docs[key].eqNullSafe(F.col("_id")), "left_semi")
