"""Quality rules: fixed base rules and a learned decision list, both as Spark column expressions.

Features are counted by SQL functions within each row, so there is no shuffle and no Python on the main path.
The list is learned on a bounded sample of labelled rows by sequential covering: a conjunction of thresholds grows
on two thirds of them by information gain, is pruned on the rest, is kept if it is precise on both, and what it
covers is set aside before the next one grows. The ordered conjunctions become one CASE expression over all rows.

Defined results: a null or blank text has no words, all counts 0, and fails the base rules; equal rows get equal
verdicts; without labelled rows of both classes the list is empty and only the base rules reject; extra columns
of the input don't matter, the rows travel in a struct.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreflow.llm.common import whole_row

#: Labelled rows, chosen by a hash of their id, on which the list is learned.
LABELLED_ROWS = 6_000
#: Words of the windows whose repeats count.
WINDOW = 8
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 8, 3, 24
#: Share of low-quality rows that a rule must have among those that it covers, and how many at least.
PRECISION, SUPPORT = 0.97, 6

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _neighbours(items: Column, f) -> Column:
    """f of each item and the next."""
    return F.zip_with(F.slice(items, F.lit(1), F.size(items) - 1), F.slice(items, F.lit(2), F.size(items) - 1), f)


def repeated_words(words: Column, n: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more. Windows compare by 64-bit hash."""
    hashes = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))

    def spread(places: Column) -> Column:
        steps = _neighbours(places, lambda a, b: F.least(b - a, F.lit(window)))
        return F.aggregate(steps, F.lit(window), lambda s, x: s + x)

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        pairs = _let(placed, lambda s: F.flatten(_neighbours(s, lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(F.sort_array(F.array_distinct(pairs)), spread)).otherwise(0)

    return F.when(n >= window + 1, _let(hashes, counted)).otherwise(0).cast("long")


def _count_of(text: Column, characters: str) -> Column:
    """Code points of ``text`` in the class ``characters``."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))).cast("long")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """(row struct of df's columns, COUNTS longs) for every row."""
    whole = F.coalesce(df[text], F.lit(""))
    rows = df.select(whole_row(df), whole.alias("whole"), F.array_remove(F.split(whole, _SPACE), "").alias("words"))
    rows = rows.withColumn("lines", F.filter(F.split("whole", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("n", F.size("words"))
    counts = F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of(F.col("whole"), "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("n")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count_of(F.col("whole"), r"\p{Lu}").alias("n_upper"),
        _count_of(F.col("whole"), "0-9").alias("n_digits"),
        _count_of(F.col("whole"), "!?").alias("n_marks"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    # A generator keeps later filters on the counts from being pushed down, and the counts from being made again there.
    return rows.select("row", F.inline(F.array(counts)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Shares in thousandths of one count to another, and plain counts, on which thresholds are set.
FEATURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "word_chars"), "distinct": ("n_distinct", "n_words"),
}


def feature(name: str) -> Column:
    """An integer: the count, or the share in thousandths, rounded down (0 over 0 is 0)."""
    top, under = FEATURES[name]
    return F.col(top) if under is None else F.floor(F.col(top) * 1000 / F.greatest(F.col(under), F.lit(1))).cast("long")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        x = feature(self.feature)
        return x >= self.threshold if self.at_least else x <= self.threshold

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x >= self.threshold if self.at_least else x <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.covers(values)
    return out


def _grow(values: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    """Adds the condition of the greatest information gain until only low-quality rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(low), bool)
    while len(rule) < MAX_CONDITIONS and (~low[inside]).any():
        p, n = int(low[inside].sum()), int(inside.sum())
        best, found = 1e-9, None
        for name, x in values.items():
            for threshold in np.unique(np.quantile(x[inside & low], np.linspace(0, 1, THRESHOLDS), method="nearest")).tolist() if p else []:
                for at_least in (True, False):
                    hit = inside & ((x >= threshold) if at_least else (x <= threshold))
                    p1, n1 = int((hit & low).sum()), int(hit.sum())
                    gain = p1 * (np.log2(p1 / n1) - np.log2(p / n)) if p1 else 0.0
                    if gain > best:
                        best, found = gain, Condition(name, at_least, int(threshold))
        if found is None:
            break
        rule.append(found)
        inside &= found.covers(values)
    return tuple(rule)


def learn(values: dict[str, np.ndarray], low: np.ndarray) -> list[Rule]:
    """An ordered list of conjunctions that pick out low-quality rows. Deterministic in the rows' order."""
    rules: list[Rule] = []
    for_pruning = np.arange(len(low)) % 3 == 2
    left = np.ones(len(low), bool)
    part = lambda m: {k: v[m] for k, v in values.items()}
    while len(rules) < MAX_RULES and low[left & ~for_pruning].any():
        rule = _grow(part(left & ~for_pruning), low[left & ~for_pruning])
        best, kept = -2.0, ()
        check, check_low = part(left & for_pruning), low[left & for_pruning]
        for k in range(1, len(rule) + 1):
            hit = covers(rule[:k], check, len(check_low))
            worth = (2 * check_low[hit].mean() - 1) if hit.any() else -1.0
            if worth > best:
                best, kept = worth, rule[:k]
        hit = covers(kept, values, len(low)) & left if kept else np.zeros(len(low), bool)
        if not kept or hit.sum() < SUPPORT or low[hit].mean() < PRECISION or low[covers(kept, values, len(low))].mean() < PRECISION:
            break
        rules.append(kept)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = LABELLED_ROWS) -> list[Rule]:
    """Learns from at most ``most`` labelled rows (labels: key, quality 0 or 1); those rows' counts come to the driver.

    A labelled row is a label with a text: of a key with several texts or labels each pair is one. The bound holds for
    the labels first, so that few texts are counted, and for the pairs after."""
    some = labels.where("quality is not null").select(F.col(key).alias("label_key"), "quality").orderBy(F.xxhash64("label_key"), "label_key", "quality").limit(most)
    texts = docs.select(F.col(key).alias("label_key"), F.col(text).alias("text")).join(F.broadcast(some), "label_key")
    found = counted(texts.repartition(12, "label_key")).select("row.label_key", "row.quality", *[feature(f).alias(f) for f in FEATURES]).orderBy(F.xxhash64("label_key"), "label_key", "quality", *FEATURES).limit(most).collect()
    low = np.array([r.quality == 0 for r in found], bool)
    if not len(low) or low.all() or not low.any():
        return []
    return learn({f: np.array([r[f] for r in found], np.int64) for f in FEATURES}, low)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, i).otherwise(out)
    return out


def judged(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """(row, COUNTS, base_failed, rule, kept) for every row of ``df``."""
    found = counted(df, text).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
