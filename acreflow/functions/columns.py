"""Column expressions: names, dates, radiometry, guards, scaling, cell geometry. All stay inside codegen."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

FIRST_CLASS_YEAR = 2008


# Names and labels


def norm_county(x: Column) -> Column:
    """Upper case, then without a trailing word COUNTY, then trimmed: in that order, so blanks after it keep it."""
    return F.regexp_replace(F.regexp_replace(F.upper(x), r"\s+COUNTY$", ""), r"^\s+|\s+$", "")


def sanitize_id(x: Column) -> Column:
    """Upper case, other than letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(x), r"[^A-Z0-9]+", "_"), r"^_|_$", "")


def fmt_ha(x: Column) -> Column:
    return F.when(is_finite(x), F.format_number(x, 1)).otherwise(F.lit("NA"))


def fmt_pct(x: Column) -> Column:
    return F.when(is_finite(x), F.format_string("%.1f%%", x)).otherwise(F.lit("NA"))


def strategy_label(kind: Column, years: Column) -> Column:
    """union_2015_2016_2017, exact_2016 and the like."""
    return F.concat_ws("_", kind, F.array_join(F.transform(years, lambda y: y.cast("string")), "_"))


# Dates and years


def season_date(year: Column, month_day: str) -> Column:
    """The day of ``year`` at "MM-DD"."""
    month, day = map(int, month_day.split("-"))
    return F.make_date(year, F.lit(month), F.lit(day))


def class_year(year: Column, first: int = FIRST_CLASS_YEAR) -> Column:
    """The crop-class file that a year reads: none is older than ``first``."""
    return F.greatest(year, F.lit(first))


def sensing_mode(year: Column, first: int = FIRST_CLASS_YEAR, et_from: int = 2000) -> Column:
    """Which inputs a year has: class mask and both signals, an old mask with both, or an old mask with NDVI only."""
    return F.when(year >= first, "FULL").when(year >= et_from, f"ET_NDVI_{first}mask").otherwise(f"NDVI_ONLY_{first}mask")


# Radiometry


def bits_clear(qa: Column, *bits: int) -> Column:
    """Whether all the bits of a quality field are zero."""
    return qa.bitwiseAND(sum(1 << b for b in bits)) == 0


def landsat_clear(qa: Column) -> Column:
    """No cloud shadow, snow, cloud or other flagged bit: 3, 4, 5, 7."""
    return bits_clear(qa, 3, 4, 5, 7)


def sentinel2_clear(qa: Column) -> Column:
    """No opaque cloud or cirrus: bits 10 and 11."""
    return bits_clear(qa, 10, 11)


def landsat_reflectance(dn: Column) -> Column:
    return dn * 2.75e-5 - 0.2


def scaled_1e4(dn: Column) -> Column:
    return dn * 1e-4


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


# Guards. NULL stands for missing; NaN and infinities are mapped to it explicitly.


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite(x: Column) -> Column:
    return F.when(is_finite(x), x)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """Within [low, high]; missing stays missing, though least and greatest skip nulls."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, as_column(low)), as_column(high)))


def power_weight(w: Column, beta: Column | float) -> Column:
    """w to the power beta; 0 where that isn't a finite number of at least 0."""
    p = F.pow(w, beta if isinstance(beta, Column) else F.lit(float(beta)))
    return F.when(is_finite(p) & (p >= 0), p).otherwise(F.lit(0.0))


# Scaling over a group


def minmax_over(x: Column, group: WindowSpec, low: float = 0.01, high: float = 1.0) -> Column:
    """Linear scaling to [low, high] within the group; missing if the group has one value."""
    a, b = F.min(x).over(group), F.max(x).over(group)
    return F.when(b > a, F.lit(low) + (x - a) / (b - a) * (high - low))


def share_over(x: Column, group: WindowSpec) -> Column:
    """x over its group's sum."""
    return F.try_divide(x, F.sum(x).over(group))


def weighted_mean_over(x: Column, weight: Column, group: WindowSpec) -> Column:
    return F.try_divide(F.sum(x * weight).over(group), F.sum(weight).over(group))


def at_most_levels(high: int, low: int) -> list[float]:
    """Quantile levels from high to low per cent, by one."""
    return [i / 100 for i in range(high, low - 1, -1)]


# Cells and coordinates

RADIUS = 6_378_137.0
_ALBERS = (29.5, 45.5, 23.0, -96.0)  # standard parallels, origin


def cell_ha(res: Column | float, crs: int = 5070, y: Column | None = None) -> Column:
    """Hectares of a square cell: constant on the equal-area grid, shrinking with cos² of the latitude on Mercator."""
    planar = (res if isinstance(res, Column) else F.lit(float(res))) ** 2 / 1e4
    if crs != 3857:
        return planar
    return planar / F.pow(F.cosh(y / RADIUS), F.lit(2.0))


@dataclass(frozen=True)
class Albers:
    """Conic equal-area projection of an ellipsoid: half axis, squared eccentricity, standard parallels, origin."""

    axis: float = RADIUS
    e2: float = 0.00669438002290  # fixed value: GRS80
    parallels: tuple[float, float] = _ALBERS[:2]
    origin: tuple[float, float] = _ALBERS[2:]

    def _q(self, sine: float) -> float:
        e = math.sqrt(self.e2)
        return (1 - self.e2) * (sine / (1 - self.e2 * sine * sine) - math.log((1 - e * sine) / (1 + e * sine)) / (2 * e))

    def constants(self) -> tuple[float, float, float, float]:
        """n, C, rho of the origin over the half axis, and the origin's longitude."""
        sines = [math.sin(math.radians(p)) for p in self.parallels]
        m2 = [(1 - s * s) / (1 - self.e2 * s * s) for s in sines]
        q = [self._q(s) for s in sines]
        n = (m2[0] - m2[1]) / (q[1] - q[0])
        c = m2[0] + n * q[0]
        return n, c, math.sqrt(c - n * self._q(math.sin(math.radians(self.origin[0])))) / n, math.radians(self.origin[1])

    def _q_of(self, sine, m):
        e = math.sqrt(self.e2)
        return (1 - self.e2) * (sine / (1 - self.e2 * sine * sine) - m.log((1 - e * sine) / (1 + e * sine)) / (2 * e))

    def forward(self, lon, lat, m=F):
        """Metres of degrees. Columns, or arrays where ``m`` is numpy."""
        n, c, rho0, l0 = self.constants()
        rho = m.sqrt(c - n * self._q_of(m.sin(m.radians(lat)), m)) / n
        theta = (m.radians(lon) - l0) * n
        return rho * m.sin(theta) * self.axis, (rho0 - rho * m.cos(theta)) * self.axis

    def inverse(self, x, y, m=F):
        """Degrees of metres: the series of the authalic latitude, then one Newton step. Columns, or arrays where ``m``
        is numpy. At a pole, where the step has no slope, the series stands."""
        n, c, rho0, l0 = self.constants()
        u, v = x / self.axis, rho0 - y / self.axis
        q = (c - (u * u + v * v) * n * n) / n
        e2, e4, e6 = self.e2, self.e2**2, self.e2**3
        sine = q / self._q(1.0)
        beta = m.asin(m.greatest(m.least(sine, m.lit(1.0)), m.lit(-1.0)) if m is F else m.clip(sine, -1.0, 1.0))
        phi = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * m.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * m.sin(4 * beta) + 761 * e6 / 45360 * m.sin(6 * beta)
        sine = m.sin(phi)
        w = 1 - e2 * sine * sine
        rise, slope = w * w * (q - self._q_of(sine, m)), 2 * m.cos(phi) * (1 - e2)
        step = F.coalesce(F.try_divide(rise, slope), F.lit(0.0)) if m is F else m.divide(rise, slope, out=m.zeros_like(slope), where=slope != 0)
        return m.degrees(m.atan2(u, v) / n + l0), m.degrees(phi + step)


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:5070 metres of degrees."""
    return Albers().forward(lon, lat)


def from_albers(x: Column, y: Column) -> tuple[Column, Column]:
    return Albers().inverse(x, y)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres of degrees."""
    return from_degrees(lon, lat, MERCATOR)


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return to_degrees(x, y, MERCATOR)


#: EPSG codes that coordinates may have: degrees (the datums are taken as one), Web Mercator, conic equal-area metres.
DEGREES, MERCATOR, ALBERS = (4326, 4269), 3857, 5070


def to_degrees(x, y, crs: int, m=F):
    """Longitude and latitude of coordinates in the system ``crs``. Columns, or arrays where ``m`` is numpy."""
    if crs in DEGREES:
        return x, y
    if crs == MERCATOR:
        return m.degrees(x / RADIUS), m.degrees(m.atan(m.sinh(y / RADIUS)))
    if crs == ALBERS:
        return Albers().inverse(x, y, m)
    raise ValueError(f"no projection for EPSG:{crs}")


def from_degrees(lon, lat, crs: int, m=F):
    if crs in DEGREES:
        return lon, lat
    if crs == MERCATOR:
        return m.radians(lon) * RADIUS, m.log(m.tan(math.pi / 4 + m.radians(lat) / 2)) * RADIUS
    if crs == ALBERS:
        return Albers().forward(lon, lat, m)
    raise ValueError(f"no projection for EPSG:{crs}")


def project(x, y, source: int, target: int, m=F):
    """Coordinates of the system ``source`` in the system ``target``."""
    if source == target or (source in DEGREES and target in DEGREES):
        return x, y
    return from_degrees(*to_degrees(x, y, source, m), target, m)


def project_by(x: Column, y: Column, crs: Column, target: int) -> tuple[Column, Column]:
    """The same for a column of codes; a code without a projection gives null."""
    known = [(code, project(x, y, code, target)) for code in (*DEGREES, MERCATOR, ALBERS)]
    pick = lambda i: reduce(lambda rest, k: F.when(crs == k[0], k[1][i]).otherwise(rest), known, F.lit(None).cast("double"))
    return pick(0), pick(1)
