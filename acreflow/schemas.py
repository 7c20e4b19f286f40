"""Table schemas and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

#: Official statistics, one or more rows a county and year.
STATS = _of(county=_S, year=_I, area_planted_ha=_D, area_harvested_ha=_D, yield_kg_ha=_D)
#: Sparse rasters: an absent row is a cell without data.
PIXELS = _of(county=_S, year=_I, row=_I, col=_I, value=_D)
#: Where the rasters of a county and year lie: the system of coordinates, the upper left corner, the cell size.
GRIDS = _of(county_id=_L, crs=_I, x_min=_D, y_max=_D, res=_D)
FIELDS = _of(patch=_L, area_ha=_D, w_sum=_D, w_density=_D)
UNITS = _of(unit_id=_S, unit_area_ha=_D, unit_w_sum=_D, unit_w_density=_D, cum_area=_D)
UNITS_WITH_YIELD = _of(unit_id=_S, county=_S, year=_I, lon=_D, lat=_D, area_ha_scaled=_D, yield_kg_ha=_D, prod_kg=_D, unit_area_ha=_D, unit_w_sum=_D)
CHECK = _of(
    county=_S, year=_I, nass_area_ha=_D, units_total_area_scaled_ha=_D, nass_yield_kg_ha=_D, area_weighted_mean_yield=_D, expected_prod_kg=_D,
    units_total_prod_kg=_D, y_floor_used_kg_ha=_D, y_ceiling_used_kg_ha=_D, adj_factor_applied=_D, nass_deviation_pct=_D,
)
ZONES = _of(cluster_id=_L, county=_S, year=_I, lon=_D, lat=_D, cluster_area_ha=_D, cluster_yield_kg_ha=_D, cluster_prod_kg=_D, n_units=_L)


def require_columns(df: DataFrame, needed: Iterable[str], what: str = "input") -> DataFrame:
    """``df``, if it has the columns; else a ValueError that names those missing."""
    if missing := sorted(set(needed) - set(df.columns)):
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return df


def require_positive(**values: float) -> None:
    for name, x in values.items():
        if not x > 0:
            raise ValueError(f"{name} must be positive, not {x}")
