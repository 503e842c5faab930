"""Transverse Mercator both ways, local offsets and units, as Column expressions.

Each step is a column of its own, so shared terms are computed once, and results may be filtered on. Rows need lat0, lon0 and arc0 of their zone
(`gridloom.sources.crs.with_crs`); without them the results are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.crs import ALPHA, BETA, ECCENTRICITY, RADIUS

#: Metres in a foot, and the radius of the sphere of local offsets.
FOOT = 0.3048
SPHERE = 6378137.0
TINY_COS = 1e-9


def _series(coefficients, first: Column, second: Column, trig, hyper) -> Column:
    return sum((F.lit(c) * trig(2 * j * first) * hyper(2 * j * second) for j, c in enumerate(coefficients, 1)), F.lit(0.0))


def _given(rows: DataFrame, kept: list[str], out: dict[str, Column]) -> DataFrame:
    """`rows` with `out` beside the columns kept.

    The results come out of a generator of one row each: a filter on them stays above it, where a plain column's whole chain
    of steps would be put into the condition again and again.
    """
    return rows.select(*(c for c in kept if c not in out), F.inline(F.array(F.struct(*(c.alias(n) for n, c in out.items())))))


def project(rows: DataFrame, lat: str = "lat", lon: str = "lon", easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Add easting and northing in metres of a geographic point in degrees."""
    kept = rows.columns
    s = F.sin(F.radians(F.col(lat)))
    rows = rows.withColumn("__t", F.sinh(F.atanh(s) - F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * s)))
    rows = rows.withColumn("__l", F.radians(F.col(lon) - F.col("lon0")))
    rows = rows.withColumns({"__xi": F.atan2(F.col("__t"), F.cos("__l")), "__eta": F.atanh(F.sin("__l") / F.sqrt(1 + F.col("__t") * F.col("__t")))})
    xi, eta = F.col("__xi"), F.col("__eta")
    out = {easting: F.lit(RADIUS) * (eta + _series(ALPHA, xi, eta, F.cos, F.sinh)), northing: F.lit(RADIUS) * (xi + _series(ALPHA, xi, eta, F.sin, F.cosh)) - F.col("arc0")}
    return _given(rows, kept, out)


def unproject(rows: DataFrame, easting: str = "easting", northing: str = "northing", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add the geographic point, in degrees, of easting and northing in metres."""
    kept = rows.columns
    rows = rows.withColumns({"__x": (F.col(northing) + F.col("arc0")) / RADIUS, "__y": F.col(easting) / RADIUS})
    x, y = F.col("__x"), F.col("__y")
    rows = rows.withColumns({"__xi": x - _series(BETA, x, y, F.sin, F.cosh), "__eta": y - _series(BETA, x, y, F.cos, F.sinh)})
    sinh, cos = F.sinh("__eta"), F.cos("__xi")
    rows = rows.withColumns({"__t": F.sin("__xi") / F.sqrt(sinh * sinh + cos * cos), "__l": F.atan2(sinh, cos)})
    e2 = ECCENTRICITY**2
    rows = rows.withColumn("__u", F.col("__t"))
    for _ in range(2):  # Newton on the tangent of the latitude
        u = F.col("__u")
        rows = rows.withColumn("__h", F.sqrt(1 + u * u))
        h = F.col("__h")
        rows = rows.withColumn("__s", F.sinh(F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * u / h)))
        s = F.col("__s")
        rows = rows.withColumn("__v", u * F.sqrt(1 + s * s) - s * h)
        v = F.col("__v")
        rows = rows.withColumn("__u", u + (F.col("__t") - v) / F.sqrt(1 + v * v) * (1 + (1 - e2) * u * u) / ((1 - e2) * h))
    return _given(rows, kept, {lat: F.degrees(F.atan("__u")), lon: F.col("lon0") + F.degrees("__l")})


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def distance_from_origin(easting: Column, northing: Column) -> Column:
    return F.sqrt(easting * easting + northing * northing)


def local_offset(lat: Column, lon: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """The point that lies so many metres east and north, on a sphere."""
    cos = F.cos(F.radians(lat))
    cos = F.when(F.abs(cos) < TINY_COS, F.when(cos < 0, -TINY_COS).otherwise(TINY_COS)).otherwise(cos)
    return lat + F.degrees(north / SPHERE), lon + F.degrees(east / (F.lit(SPHERE) * cos))


def feet(metres: Column) -> Column:
    return metres / FOOT


def metres(feet_: Column) -> Column:
    return feet_ * FOOT
