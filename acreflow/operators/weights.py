"""Eligibility by quantile search, and the weight surface of a county and year.

NULL, NaN and infinities are cells without data throughout: no quantile counts them, no screen or threshold keeps them,
and they take no part in a scale or a sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreflow.functions.columns import at_most_levels, finite, is_finite

KEYS = ("county_id", "yr")
#: Decimals of quantile thresholds: engines differ in the last bit of an interpolation.
DECIMALS = 9


def _finite(value: str) -> Column:
    return finite(F.col(value).cast("double"))


def _counts(cells: DataFrame, value: str) -> DataFrame:
    """(keys, _v, _c): the distinct values of each group, and how many cells have them. Combines before the shuffle."""
    return cells.select(*KEYS, _finite(value).alias("_v")).where("_v is not null").groupBy(*KEYS, "_v").agg(F.count("*").alias("_c"))


#: Distinct values of a group from which on they are ranked in parts; values that are drawn to part them, and parts.
LARGE, DRAWN, PARTS = 1 << 14, 1024, 64


def _parted(counts: DataFrame) -> DataFrame | None:
    """(keys, _cuts): for groups of many distinct values some of them in order, about evenly spread. They are drawn by hash
    and then thinned, so every run draws the same, and a lost task too. Other groups have none; None if no group is large,
    where one window a group ranks alike with fewer shuffles."""
    most = counts.groupBy(*KEYS).count().agg(F.max("count")).first()[0]
    if (most or 0) <= LARGE:
        return None
    sizes = counts.groupBy(*KEYS).agg(F.count("*").alias("_d")).where(F.col("_d") > LARGE)
    drawn = (F.xxhash64("_v") / F.lit(2.0**64) + 0.5) * F.col("_d") < DRAWN
    some = counts.join(sizes, list(KEYS)).where(drawn).groupBy(*KEYS).agg(F.sort_array(F.collect_list("_v")).alias("_drawn"))  # about DRAWN
    return some.select(*KEYS, F.filter("_drawn", lambda v, i: i % (DRAWN // PARTS) == DRAWN // PARTS - 1).alias("_cuts"))


def _in_parts(values: DataFrame, cuts: DataFrame) -> DataFrame:
    """``values`` with _k, the part that _v lies in: the number of cuts at or below it."""
    own = values.join(cuts, list(KEYS), "left")
    return own.withColumn("_k", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))), F.lit(0))).drop("_cuts")


def _heads(parted: DataFrame) -> DataFrame:
    """(keys, _k, _before, _after, _n, _low): of each part the cells before and after it, of the group all, and the next
    part's least value. A window over the parts of a group, which are few."""
    parts = parted.groupBy(*KEYS, "_k").agg(F.sum("_c").alias("_own"), F.min("_v").alias("_first"))
    order = Window.partitionBy(*KEYS).orderBy("_k")
    before = F.sum("_own").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_own")
    n = F.sum("_own").over(Window.partitionBy(*KEYS))
    return parts.withColumns({"_before": before, "_n": n, "_low": F.lead("_first").over(order)}).select(*KEYS, "_k", "_before", (F.col("_n") - F.col("_before") - F.col("_own")).alias("_after"), "_n", "_low")


def _ranked(counts: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """(keys, _v, _c, _b, _next, _n): distinct values with the cells up to and with them, the next value, and all cells.

    Ranks are running counts within a part of a group's values, plus the cells of the parts before: no task sorts a large
    group's values."""
    if cuts is None:
        order = Window.partitionBy(*KEYS).orderBy("_v")
        return counts.withColumns({"_b": F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_next": F.lead("_v").over(order), "_n": F.sum("_c").over(Window.partitionBy(*KEYS))})
    parted = _in_parts(counts, cuts)
    own = Window.partitionBy(*KEYS, "_k").orderBy("_v")
    ranked = parted.withColumns({"_run": F.sum("_c").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_lead": F.lead("_v").over(own)})
    return ranked.join(_heads(parted), [*KEYS, "_k"]).select(*KEYS, "_v", "_c", (F.col("_run") + F.col("_before")).alias("_b"), F.coalesce("_lead", "_low").alias("_next"), "_n")


def _reaching(counts: DataFrame, thresholds: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """``thresholds`` (keys, _v and others) with _above, the cells at or above each. Values and thresholds stand in one order
    within a part; the parts after it count whole."""
    if cuts is None:
        parted, own = (x.withColumn("_k", F.lit(0)) for x in (counts, thresholds))
    else:
        parted, own = _in_parts(counts, cuts), _in_parts(thresholds, cuts)
    extra = [c for c in thresholds.columns if c not in (*KEYS, "_v")]
    both = parted.select(*KEYS, "_k", "_v", "_c", *[F.lit(None).cast(t).alias(n) for n, t in thresholds.dtypes if n in extra], F.lit(False).alias("_asked"))
    both = both.unionByName(own.select(*KEYS, "_k", "_v", F.lit(0).cast("long").alias("_c"), *extra, F.lit(True).alias("_asked")))
    order = Window.partitionBy(*KEYS, "_k").orderBy(F.col("_v").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_run", F.sum("_c").over(order)).where("_asked")
    if cuts is None:
        return found.select(*KEYS, "_v", *extra, F.col("_run").alias("_above"))
    # A threshold may lie in a part without values of its own: what is after it is found by the parts' order.
    parts = parted.groupBy(*KEYS, "_k").agg(F.sum("_c").alias("_own"))
    after = F.coalesce(F.sum(F.when(F.col("_later") > F.col("_k"), F.col("_own"))), F.lit(0))
    # At most PARTS rows meet each threshold, of which a group has a fixed number.
    tail = found.select(*KEYS, "_k").distinct().join(parts.withColumnRenamed("_k", "_later"), list(KEYS)).groupBy(*KEYS, "_k").agg(after.alias("_after"))
    return found.join(tail, [*KEYS, "_k"]).select(*KEYS, "_v", *extra, (F.col("_run") + F.col("_after")).alias("_above"))


def quantiles(counts: DataFrame, lowest: int, highest: int, step: int, cuts: DataFrame | bool | None = True) -> DataFrame:
    """(keys, _p, q): the interpolated quantiles (type 7) of the levels lowest, lowest + step, ... highest, in thousandths.

    counts: distinct values with their counts. Cumulative counts over the distinct values give the ranks that each value
    holds; the levels between are found by arithmetic, so nothing holds a group's values at once. cuts: from ``_parted``,
    where it was asked before."""
    ranked = _ranked(counts, _parted(counts) if cuts is True else cuts)
    # Levels p with a <= (n - 1) p / 1000 < b lie at this value or between it and the next.
    ceil = lambda rank: F.when(F.col("_n") > 1, F.ceil(rank * 1000 / (F.col("_n") - 1))).otherwise(F.when(rank > 0, F.lit(1001)).otherwise(0)).cast("long")
    first = F.greatest(ceil(F.col("_b") - F.col("_c")), F.lit(lowest))
    first = F.lit(lowest) + F.ceil((first - lowest) / step).cast("long") * step
    last = F.least(ceil(F.col("_b")) - 1, F.lit(highest))
    held = ranked.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    level = held.withColumn("_p", F.explode(F.sequence("_first", "_last", F.lit(step).cast("long"))))
    place = (F.col("_n") - 1) * F.col("_p")
    between = (F.pmod(place, F.lit(1000)) > 0) & (F.floor(place / 1000) + 1 >= F.col("_b"))
    q = F.when(between, F.col("_v") + (F.col("_next") - F.col("_v")) * F.pmod(place, F.lit(1000)) / 1000).otherwise(F.col("_v"))
    return level.select(*KEYS, F.col("_p").cast("int").alias("_p"), F.round(q, DECIMALS).alias("q"))


def quantile(cells: DataFrame, value: str, level: float) -> DataFrame:
    """(keys, <value>_q) at one level, to the thousandth."""
    p = round(level * 1000)
    return quantiles(_counts(cells, value), p, p, 1).select(*KEYS, F.col("q").alias(f"{value}_q"))


def screen(pixels: DataFrame, value: str, level: float = 0.05) -> DataFrame:
    """Cells strictly above the group's quantile, taken over all of its cells, and that threshold as <value>_q."""
    return pixels.join(quantile(pixels, value, level), list(KEYS)).where(_finite(value) > F.col(f"{value}_q"))


def eligibility(cells: DataFrame, harvest: DataFrame, value: str = "ndvi", buffer: float = 0.0, high: int = 90, low: int = 10, step: int = 1) -> DataFrame:
    """(county_id, yr, level, threshold, eligible_cells): the highest of the quantile levels whose cells at or above it
    reach the harvested area with its buffer; the lowest level if none does; the median without a valid area.

    harvest: (county_id, yr, harvested_cells). Levels run from high to low per cent by ``step``: 81 levels by one, 41 by
    two. Thresholds and the counts at or above them come from cumulative counts over the distinct values."""
    levels = len(at_most_levels(high, low)[::step])
    lowest = high - (levels - 1) * step
    counts = _counts(cells, value)
    cuts = _parted(counts)
    searched = quantiles(counts, 10 * lowest, 10 * high, 10 * step, cuts).select(*KEYS, ((F.lit(10 * high) - F.col("_p")) / (10 * step)).cast("int").alias("_i"), F.col("q").alias("threshold"))
    middle = quantiles(counts, 500, 500, 1, cuts).select(*KEYS, F.lit(levels).alias("_i"), F.col("q").alias("threshold"))
    reached = _reaching(counts, searched.union(middle).select(*KEYS, F.col("threshold").alias("_v"), "_i"), cuts).select(*KEYS, "_i", F.col("_v").alias("threshold"), F.col("_above").alias("eligible_cells"))
    wanted = harvest.select(*KEYS, F.col("harvested_cells").cast("double").alias("_h"))
    joined = reached.join(wanted, list(KEYS), "left")
    valid = is_finite(F.col("_h")) & (F.col("_h") > 0)
    last = levels - 1
    fits = F.when(~valid, F.col("_i") == last + 1).otherwise((F.col("_i") <= last) & ((F.col("eligible_cells") >= F.col("_h") * (1 + buffer)) | (F.col("_i") == last)))
    best = joined.where(fits).groupBy(*KEYS).agg(F.min(F.struct("_i", "threshold", "eligible_cells")).alias("_b")).select(*KEYS, "_b.*")
    level = F.when(F.col("_i") == last + 1, 0.5).otherwise(F.lit(high / 100) - F.col("_i") * step / 100)
    return best.select(*KEYS, F.round(level, 2).alias("level"), "threshold", "eligible_cells")


def eligible(cells: DataFrame, chosen: DataFrame, value: str = "ndvi") -> DataFrame:
    """The cells at or above their group's threshold."""
    return cells.join(chosen.select(*KEYS, "threshold"), list(KEYS)).where(_finite(value) >= F.col("threshold")).drop("threshold")


def blend(et: Column, ndvi: Column, a_et: float, a_ndvi: float, ndvi_only: Column | None = None) -> Column:
    """The weighted sum of both scaled signals; NDVI alone where so flagged or where ET is missing."""
    both = F.lit(a_et) * et + F.lit(a_ndvi) * ndvi
    return both if ndvi_only is None else F.when(ndvi_only, ndvi).otherwise(both)


def surface(cells: DataFrame, a_et: float = 0.3, a_ndvi: float = 0.7, ndvi_only: Column | None = None, low: float = 0.01, high: float = 1.0) -> DataFrame:
    """Adds w_ndvi and w_et (scaled to [low, high] within the group; missing where the group has one value), weight, and
    w_norm, whose sum is 1.

    cells: eligible cells with ndvi and et; where both are wanted and one is missing the cell drops. The ranges and the sum
    of a group are groupings, which combine before the shuffle, joined back as a row a group: no task holds a county."""
    ends = [f(_finite(c)).alias(f"_{n}_{c}") for c in ("ndvi", "et") for n, f in (("min", F.min), ("max", F.max))]
    ranged = cells.join(cells.groupBy(*KEYS).agg(*ends), list(KEYS))

    def scaled(c: str) -> Column:
        a, b = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        return F.when(b > a, F.lit(low) + (_finite(c) - a) / (b - a) * (high - low))

    scales = ranged.withColumns({"w_ndvi": scaled("ndvi"), "w_et": scaled("et")})
    # The missing signal of a group is left out instead of making every weight missing.
    only_et = ~F.coalesce(F.col("_max_ndvi") > F.col("_min_ndvi"), F.lit(False))
    weight = F.when(only_et, F.col("w_et")).when(F.col("_max_et").isNull(), F.col("w_ndvi")).otherwise(blend(F.col("w_et"), F.col("w_ndvi"), a_et, a_ndvi, ndvi_only))
    weighed = scales.withColumn("weight", weight).where("weight is not null").select(*cells.columns, "w_ndvi", "w_et", "weight")
    total = weighed.groupBy(*KEYS).agg(F.sum("weight").alias("_sum"))
    return weighed.join(total, list(KEYS)).withColumn("w_norm", F.try_divide("weight", F.col("_sum"))).select(*weighed.columns, "w_norm")


def diagnostics(decisions: DataFrame, chosen: DataFrame, screens: DataFrame, harvest: DataFrame, cell_ha: float) -> DataFrame:
    """One row a county and year: areas, their ratios, thresholds."""
    ha = lambda c: F.col(c) * F.lit(cell_ha)
    table = decisions.join(chosen, list(KEYS), "left").join(screens, list(KEYS), "left").join(harvest.select(*KEYS, "harvested_cells"), list(KEYS), "left")
    return table.select(
        *KEYS, "strategy",
        ha("harvested_cells").alias("harvest_area_ha"), ha("mask_cells").alias("mask_area_ha"), ha("eligible_cells").alias("eligible_area_ha"),
        F.try_divide(F.col("mask_cells").cast("double"), F.col("harvested_cells")).alias("mask_over_harvest"),
        F.try_divide(F.col("eligible_cells").cast("double"), F.col("harvested_cells")).alias("eligible_over_harvest"),
        F.col("threshold").alias("ndvi_threshold"), "q_ndvi", "q_et",
    )
