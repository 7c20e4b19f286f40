"""Crop masks reconciled with reported area: exact year, or the union or intersection of three years.

One join on the window's years and one grouping by cell give all three masks at once; the choice is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreflow.functions.columns import FIRST_CLASS_YEAR, class_year, is_finite, strategy_label

KEYS = ("county_id", "yr")
CELL = ("cx", "cy")


def window_years(year: Column, first: int = FIRST_CLASS_YEAR) -> Column:
    """The year and its neighbours; before the first class year, the first three."""
    late = F.array(*[F.lit(first + i) for i in range(3)])
    return F.when(year < first, late).otherwise(F.array(year - 1, year, year + 1))


def crop_cells(classes: DataFrame, code: int) -> DataFrame:
    """The cells of one class."""
    return classes.where(F.col("cdl") == code).select(*KEYS, *CELL)


def _candidates(targets: DataFrame, crop: DataFrame, first: int) -> DataFrame:
    """Cells of the window's years: exact (in the year's own file), n_years (files of the window that have them)."""
    files = F.array_distinct(F.transform(window_years(F.col("yr"), first), lambda y: F.greatest(y, F.lit(first))))
    asked = targets.select(*KEYS, F.explode(files).alias("_file"))
    cells = crop.select("county_id", F.col("yr").alias("_file"), *CELL).distinct()
    hit = asked.join(cells, ["county_id", "_file"])
    own = (F.col("_file") == F.col("yr")) & (F.col("yr") >= first)
    return hit.groupBy(*KEYS, *CELL).agg(F.max(own).alias("exact"), F.count_distinct("_file").alias("n_years"))


def masks(targets: DataFrame, classes: DataFrame, code: int, lower: float = 0.6, upper: float = 2.0, planted: str = "planted_cells", first: int = FIRST_CLASS_YEAR) -> tuple[DataFrame, DataFrame]:
    """(cells, decisions). cells: (county_id, yr, cx, cy, exact, n_years, chosen). decisions: a row for each target with
    its areas in cells, the ratio of exact to planted area, and the strategy's label.

    targets: (county_id, yr, planted). A null planted area keeps the exact mask."""
    years = classes.select(F.col("yr").alias("_file")).distinct()
    found = _candidates(targets, crop_cells(classes, code), first)
    files = F.array_distinct(F.transform(window_years(F.col("yr"), first), lambda y: F.greatest(y, F.lit(first))))
    has = targets.select(*KEYS, F.explode(files).alias("_file")).join(F.broadcast(years), "_file").groupBy(*KEYS).agg(
        F.count("*").alias("n_files"), F.max((F.col("_file") == F.col("yr")) & (F.col("yr") >= first)).alias("has_exact")
    )
    cells = found.join(has, list(KEYS))
    areas = cells.groupBy(*KEYS).agg(F.count_if("exact").alias("exact_cells"), F.count("*").alias("union_cells"), F.count_if(F.col("n_years") == F.col("n_files")).alias("both_cells"))
    table = targets.join(has, list(KEYS), "left").join(areas, list(KEYS), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("exact_cells", "union_cells", "both_cells")})
    known = is_finite(F.col(planted).cast("double")) & F.col("has_exact")
    ratio = F.when(known, F.try_divide(F.col("exact_cells").cast("double"), F.col(planted).cast("double")))
    kind = (
        F.when(F.coalesce("n_files", F.lit(0)) == 0, "failed")
        .when(~F.coalesce("has_exact", F.lit(False)), "union")
        .when(ratio < lower, "union")
        .when(ratio >= upper, "intersect")
        .otherwise("exact")
    )
    table = table.withColumn("ratio", ratio).withColumn("kind", kind)
    label = F.when(F.col("kind") == "failed", "failed_to_build_mask").otherwise(
        strategy_label(F.col("kind"), F.when(F.col("kind") == "exact", F.array("yr")).otherwise(window_years(F.col("yr"), first)))
    )
    area = F.when(F.col("kind") == "exact", F.col("exact_cells")).when(F.col("kind") == "union", F.col("union_cells")).when(F.col("kind") == "intersect", F.col("both_cells"))
    decisions = table.select(*KEYS, planted, "exact_cells", "union_cells", "both_cells", "ratio", "kind", label.alias("strategy"), area.alias("mask_cells"))
    chosen = F.when(F.col("kind") == "exact", F.col("exact")).when(F.col("kind") == "intersect", F.col("n_years") == F.col("n_files")).otherwise(True)
    kept = cells.join(decisions.select(*KEYS, "kind"), list(KEYS)).select(*KEYS, *CELL, "exact", "n_years", "n_files", chosen.alias("chosen"))
    return kept, decisions


def mask_area(cells: DataFrame, cell_ha: float) -> DataFrame:
    return cells.groupBy(*KEYS).agg(F.count("*").alias("n_cells")).withColumn("area_ha", F.col("n_cells") * F.lit(cell_ha))
