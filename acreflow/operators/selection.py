"""Which units are harvested: a prefix by weight up to an area, then a prefix by cumulative weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreflow.functions.columns import finite, share_over

KEYS = ("county_id", "yr")


def _by_weight(weight: str):
    return Window.partitionBy(*KEYS).orderBy(F.col(weight).desc_nulls_last(), "unit_id")


def harvest_prefix(units: DataFrame, target: str = "harvested_cells", area: str = "area_cells", weight: str = "w_sum") -> DataFrame:
    """Units before the one whose running area reaches min(target, total); that one too if it is the first.

    units: (keys, unit_id, area, weight, target). Adds rn and cum_cells."""
    group, order = Window.partitionBy(*KEYS), _by_weight(weight)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = units.withColumns({"rn": F.row_number().over(order), "cum_cells": F.sum(area).over(running), "_total": F.sum(area).over(group)})
    crossing = F.min(F.when(F.col("cum_cells") >= F.least(F.col(target), F.col("_total")), F.col("rn"))).over(group)
    kept = ranked.withColumn("_k", crossing).where(F.col("_k").isNull() | (F.col("rn") < F.col("_k")) | ((F.col("_k") == 1) & (F.col("rn") == 1)))
    return kept.drop("_total", "_k")


def renormalized(units: DataFrame, weight: str = "w_sum", out: str = "w_share") -> DataFrame:
    """Each unit's share of the kept weight. A unit is its cells, so masking the raster and summing anew is this."""
    return units.withColumn(out, share_over(F.col(weight).cast("double"), Window.partitionBy(*KEYS)))


#: How far a selection's outline reaches beyond its cells.
TOUCHING = {"none": ((0, 0),), "sides": ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)), "corners": tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))}


def capped_surface(weights: DataFrame, members: DataFrame, weight: str = "w", touching: str = "sides") -> DataFrame:
    """(keys, cx, cy, w_cap): the weight cells that the selected units cover or touch, their sum 1.

    members: (keys, cx, cy) of the selected units, which may overlap. A polygon of whole cells touches those beyond its
    sides ("sides") or its corners as well ("corners"): each cell is put next to itself and met by an equality join, once
    however many units touch it. Cells without a weight take no part."""
    if touching not in TOUCHING:
        raise ValueError(f"touching must be one of {', '.join(TOUCHING)}, not {touching}")
    types = dict(members.dtypes)
    around = F.array(*[F.struct((F.col("cx") + i).cast(types["cx"]).alias("cx"), (F.col("cy") + j).cast(types["cy"]).alias("cy")) for i, j in TOUCHING[touching]])
    near = members.select(*KEYS, "cx", "cy").distinct().select(*KEYS, F.inline(around)).distinct()
    own = weights.select(*KEYS, "cx", "cy", finite(F.col(weight).cast("double")).alias("_w")).where("_w is not null").join(near, [*KEYS, "cx", "cy"], "left_semi")
    total = own.groupBy(*KEYS).agg(F.sum("_w").alias("_sum"))
    return own.join(total, list(KEYS)).select(*KEYS, "cx", "cy", F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum")).otherwise(F.col("_w")).alias("w_cap"))


def prune(units: DataFrame, keep: float = 0.95, least: int = 2, weight: str = "w_sum") -> DataFrame:
    """Units up to and with the one whose cumulative share reaches ``keep``, at least ``least``; then shares anew.

    Adds cumw (the cumulative weight over the total, before pruning) and w_share."""
    group, order = Window.partitionBy(*KEYS), _by_weight(weight)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = F.col(weight)
    ranked = units.withColumns({"_rn": F.row_number().over(order), "_run": F.sum(w).over(running), "_all": F.sum(w).over(group)})
    ranked = ranked.withColumn("cumw", F.try_divide(F.col("_run").cast("double"), F.col("_all")))
    crossing = F.min(F.when(F.col("cumw") >= keep, F.col("_rn"))).over(group)
    kept = ranked.withColumn("_k", crossing).where(F.col("_k").isNull() | (F.col("_rn") <= F.greatest(F.col("_k"), F.lit(least))))
    return renormalized(kept, weight).drop("_rn", "_run", "_all", "_k")
