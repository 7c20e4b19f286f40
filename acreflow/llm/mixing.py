"""Mixing sources to target weights by entropy balancing.

Rates r of documents minimise the relative entropy sum(size * (r log r - r + 1)), 0 <= r <= most, under one token
constraint a source, sum(size * r) = its target, and moments that all sources share: the mix keeps the corpus' mean
and spread of document lengths (of length classes, weighed by size), as far as the targets leave room. So the rates
are exponentially tilted, r = min(most, exp(lambda of the source + mu . moments of the length class)): long and short
documents of a source are taken at different rates, where source weights alone would shift the lengths.

The dual is convex. Newton's iterations run on mu: every iteration solves each source's lambda exactly and sums
gradient and Hessian (Schur complement of the sources' block) over a table of one row a source, in Spark; only the
sums come to the driver. A small ridge on mu keeps a solution where the moments can't be held; the sources' targets
are met exactly. An iteration that doesn't converge raises.

Rates become copies: the whole part for each document, and one more for documents chosen by a hash of their id, class
by class from long documents to short ones, each class taking up what the longer ones left over. The choice is made on
a histogram of (source, length class, hash bucket) sums, so no source's documents ever meet in one task.

Targets: source i (by code point, null last) weighs weights[i mod 3]; all together they share the total size;
none is above ``most`` times its source's size, the excess is reshared by weight.

Defined results: a null text has size 0; a document of size 0 is taken 0 or more times with 0 words; a null source
is a source of its own, the empty string another; rows with the same id share the choice; an empty table gives an
empty result; clashing column names of the input don't matter, the rows travel in a struct; names with dots are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreflow.llm.common import dropped, settled, whole_row

WEIGHTS = (5.0, 2.0, 1.0)
#: Hash buckets of a length class.
BUCKETS = 256
#: Newton iterations at most, the relative gradient at which they end, and the ridge on the shared multipliers, as a
#: share of all tokens.
ROUNDS, TOLERANCE, RIDGE = 60, 1e-9, 0.02
#: Rows up to which the tables of sources are broadcast; beyond, Spark joins them by shuffle.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Number of stretches without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(sk, source_size, target) from rows (source, sk, size). Ranks by range partitions, totals as scalars."""
    sums = sizes.groupBy("source", "sk").agg(F.sum("size").alias("source_size"))
    ranged = settled(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    rank = ranged.withColumn("place", place).join(before.select("part", "before"), "part").withColumn("rank", F.col("before") + F.col("place") - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = settled(rank.select("sk", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    level, seen = 0.0, -1
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.lit(level) * F.col("weight") > F.col("cap")
        capped, held, rest = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if capped == seen or not rest:
            break
        level, seen = (total - held) / rest, capped
    return ranked.select("sk", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("cap")).alias("target"))


def moments(size_class: np.ndarray) -> np.ndarray:
    """The shared moments of length classes: log2 of the size about 8, and its square, scaled to be near 1."""
    z = (size_class - 8.0) / 4.0
    return np.stack([z, z * z], -1)


def solve_source(words: np.ndarray, tilt: np.ndarray, target: float, most: float) -> tuple[float, np.ndarray]:
    """lambda, such that the rates min(most, exp(lambda + tilt)) of classes with ``words`` words make up ``target``,
    and the rates. Exact: classes reach the limit in the order of their tilts."""
    if target <= 0 or words.sum() <= 0:
        return 0.0, np.zeros(len(words))
    order = np.argsort(-tilt, kind="stable")
    w, t = words[order], tilt[order]
    top = t.max()
    free = np.append(np.cumsum((w * np.exp(t - top))[::-1])[::-1], 0.0)  # weight of the classes from k on
    held = np.concatenate([[0.0], np.cumsum(w)]) * most  # tokens of the classes before k at the limit
    for k in range(len(w)):
        if free[k] > 0 and target > held[k]:
            lam = np.log((target - held[k]) / free[k]) - top
            if lam + t[k] <= np.log(most):
                return lam, np.minimum(most, np.exp(lam + tilt))
    return float(np.log(most) - t.min()), np.full(len(words), float(most))


def _sums(table: DataFrame, mu: np.ndarray, most: float) -> np.ndarray:
    """Over all sources: the moments' tokens, the Hessian of the reduced dual, and the dual's value."""
    k = len(mu)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k + k * k + 1)
        for rows in it:
            for target, classes, words in zip(rows["target"], rows["classes"], rows["words"], strict=True):
                x, w = moments(np.asarray(classes, float)), np.asarray(words, float)
                lam, rate = solve_source(w, x @ mu, target, most)
                tokens = w * rate
                moving = tokens * (rate < most)
                total[:k] += tokens @ x
                hessian = x.T @ (moving[:, None] * x)
                if moving.sum() > 0:
                    pull = moving @ x
                    hessian -= np.outer(pull, pull) / moving.sum()
                total[k:-1] += hessian.ravel()
                # The conjugate of the bounded entropy: exp below the limit, linear above it.
                at = lam + x @ mu
                total[-1] += lam * target - (w * np.where(at < np.log(most), np.exp(np.minimum(at, np.log(most))), most * (1 + at - np.log(most)))).sum()
        yield pd.DataFrame([total], columns=[f"s{i}" for i in range(len(total))])

    names = [f"s{i}" for i in range(k + k * k + 1)]
    found = table.mapInPandas(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
    return np.array([x or 0.0 for x in found])


def multipliers(table: DataFrame, wanted: np.ndarray, most: float, rounds: int = ROUNDS) -> np.ndarray:
    """mu of the shared moments, for ``table`` (target, classes, words: a row a source) and tokens ``wanted`` of each
    moment. Raises if Newton's iterations don't converge."""
    k, total = len(wanted), float(table.agg(F.sum("target")).first()[0] or 0.0)
    mu = np.zeros(k)
    if total <= 0:
        return mu
    ridge = RIDGE * total
    value = lambda sums, mu: float(wanted @ mu + sums[-1] - ridge * (mu @ mu) / 2)
    sums = _sums(table, mu, most)
    for _ in range(rounds):
        gradient = wanted - sums[:k] - ridge * mu
        if np.abs(gradient).max() <= TOLERANCE * total:
            return mu
        step = np.linalg.solve(sums[k:-1].reshape(k, k) + ridge * np.eye(k), gradient)
        step *= min(1.0, 4.0 / np.abs(step).max())
        now = value(sums, mu)
        while True:
            then = _sums(table, mu + step, most)
            if value(then, mu + step) >= now + 1e-4 * float(gradient @ step) - 1e-12 * (abs(now) + total) or np.abs(step).max() < 1e-12:
                break
            step = step / 2
        mu, sums = mu + step, then
    raise ValueError(f"Newton's iterations haven't converged in {rounds} rounds")


def _tilted(table: DataFrame, mu: np.ndarray, most: float) -> DataFrame:
    """(sk, size_class, rate) of every class of every source."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            out = [(sk, int(c), float(r)) for sk, target, classes, words in zip(rows["sk"], rows["target"], rows["classes"], rows["words"], strict=True)
                   for c, r in zip(classes, solve_source(np.asarray(words, float), moments(np.asarray(classes, float)) @ mu, target, most)[1], strict=True)]
            yield pd.DataFrame(out, columns=["sk", "size_class", "rate"])

    return table.mapInPandas(run, "sk string, size_class int, rate double")


def _cuts(group: pd.DataFrame) -> pd.DataFrame:
    """For one source: per length class, how many hash buckets get one copy more. Bounded by classes x BUCKETS rows."""
    out, carry = [], 0.0
    for size_class, rows in sorted(group.groupby("size_class"), key=lambda x: -x[0]):
        if rows["full"].iloc[0]:  # at the limit of copies: what is left over goes on to shorter documents
            out.append((group["sk"].iloc[0], size_class, 0))
            continue
        rows = rows.sort_values("bucket")
        wanted = float(rows["share"].iloc[0]) * float(rows["words"].sum()) + carry
        running, cut, taken = 0.0, 0, 0.0
        best = abs(wanted)
        for bucket, words in zip(rows["bucket"], rows["words"], strict=True):
            running += float(words)
            if abs(wanted - running) < best:
                best, cut, taken = abs(wanted - running), int(bucket) + 1, running
        carry = wanted - taken
        out.append((group["sk"].iloc[0], size_class, cut))
    return pd.DataFrame(out, columns=["sk", "size_class", "cut"])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(row struct of df's columns, size, source_size, target, rate, copies) for every row of ``df``.

    ``df`` is read twice: once for sizes, once for the result; texts aren't shuffled while the sources' tables are
    small enough to broadcast."""
    bucket = F.pmod(F.xxhash64(df[key], F.lit(7)), F.lit(BUCKETS)).cast("int")
    size = word_count(df[text])
    # Sizes are stored (a few bytes a row), so that the words are counted once for the three sums.
    sizes = settled(df.select(df[source].alias("source"), _source_key(df[source]).alias("sk"), size.alias("size"), bucket.alias("bucket")))
    sized = sizes.withColumn("size_class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    words = settled(sized.groupBy("sk", "size_class", "bucket").agg(F.sum("size").alias("words")))
    targets = settled(source_targets(sizes, weights, most))
    dropped(sizes)
    classes = words.groupBy("sk", "size_class").agg(F.sum("words").alias("words"))
    # A row a source; its classes are at most the 64 of a long's logarithm.
    listed = classes.groupBy("sk").agg(F.sort_array(F.collect_list(F.struct("size_class", "words"))).alias("c"))
    solved = settled(listed.join(targets, "sk").select("sk", "target", F.col("c.size_class").alias("classes"), F.col("c.words").alias("words")))
    mu = multipliers(solved, _wanted(solved), most)
    rates = _tilted(solved, mu, most).withColumn("whole", F.least(F.floor(F.col("rate") + 1e-9), F.lit(int(most))))
    rates = settled(rates.withColumn("share", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))))
    cuts = words.join(_small(rates.select("sk", "size_class", "share", (F.col("whole") >= int(most)).alias("full"))), ["sk", "size_class"]).groupBy("sk").applyInPandas(_cuts, "sk string, size_class int, cut int")
    each = settled(cuts.join(rates, ["sk", "size_class"]).join(targets, "sk").select("sk", "size_class", "cut", "source_size", "target", "rate", "whole"))
    dropped(words, targets, solved, rates)
    rows = df.select(whole_row(df), _source_key(df[source]).alias("sk"), size.alias("size"), bucket.alias("bucket"))
    rows = rows.withColumn("size_class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    copies = F.least(F.col("whole") + F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0), F.lit(int(most))).cast("long")
    return rows.join(_small(each), ["sk", "size_class"]).select("row", "size", "source_size", "target", "rate", copies.alias("copies"))


def _wanted(solved: DataFrame) -> np.ndarray:
    """Tokens of each moment in a mix of the targets' size with the corpus' own lengths."""
    sums = solved.select(F.explode(F.arrays_zip("classes", "words")).alias("x")).groupBy("x.classes").agg(F.sum("x.words").alias("words")).collect()
    size = float(sum(r.words for r in sums))
    total = float(solved.agg(F.sum("target")).first()[0] or 0.0)
    if not size:
        return np.zeros(moments(np.zeros(1)).shape[1])
    return total * sum(r.words * moments(np.array(float(r.classes))) for r in sums) / size


def repeated(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken."""
    mixed = mix(df, **options).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


# Several constraints at once -------------------------------------------------------------------------------------

#: Constraints (targets of all families together) up to which the dual's Newton system is solved on the driver.
CONSTRAINTS = 2_000


def balance(cells: DataFrame, targets: dict[str, dict[str, float]], size: str = "size", tolerance: float = 1e-9, rounds: int = 60) -> dict[str, dict[str, float]]:
    """Multipliers lambda by family and value, such that rates exp(sum of a cell's lambdas) meet every token target.

    cells: sums of ``size`` for combinations of the families' columns; targets: family column to value to tokens, all
    families with one total. Each Newton iteration sums gradient and Hessian over the cells in Spark (a block for each
    pair of families) and solves the bounded system on the driver, halving the step until the dual rises.
    Values without a target keep lambda 0; targets must be positive and their cells non-empty."""
    names = [(f, v) for f, each in targets.items() for v in each]
    if len(names) > CONSTRAINTS:
        raise ValueError(f"{len(names)} constraints are more than {CONSTRAINTS}")
    place = {name: i for i, name in enumerate(names)}
    wanted = np.array([targets[f][v] for f, v in names])
    x = np.zeros(len(names))

    def rated(x: np.ndarray) -> DataFrame:
        total = F.lit(0.0)
        for f, each in targets.items():
            known = F.create_map(*[y for v in each for y in (F.lit(v), F.lit(float(x[place[f, v]])))])
            total = total + F.coalesce(F.try_element_at(known, F.col(f)), F.lit(0.0))
        return cells.withColumn("_tokens", F.col(size) * F.exp(total))

    def dual(x: np.ndarray) -> float:
        return float(wanted @ x) - float(rated(x).agg(F.sum("_tokens")).first()[0] or 0.0)

    now = dual(x)
    for _ in range(rounds):
        tokens, hessian, gradient = rated(x), np.zeros((len(x), len(x))), wanted.copy()
        families = list(targets)
        for i, f in enumerate(families):
            for g in families[i:]:
                for r in tokens.groupBy(F.col(f).alias("f"), F.col(g).alias("g")).agg(F.sum("_tokens").alias("t")).collect():
                    if (f, r.f) in place and (g, r.g) in place:
                        a, b = place[f, r.f], place[g, r.g]
                        hessian[a, b] = hessian[b, a] = r.t
                        if f == g:
                            gradient[a] -= r.t
        if np.abs(gradient).max() <= tolerance * max(1.0, np.abs(wanted).max()):
            break
        step = np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]  # families share a total, so one direction is free
        step *= min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        while (then := dual(x + step)) < now - 1e-9 * abs(now) and np.abs(step).max() > 1e-12:
            step /= 2
        x, now = x + step, then
    else:
        raise ValueError(f"Newton's iterations haven't converged in {rounds} rounds")
    return {f: {v: float(x[place[f, v]]) for v in each} for f, each in targets.items()}
