"""The CRS dimension: the 19 zones of the Japan Plane Rectangular system on JGD2011, with their series constants.

19 rows, so every join with it may broadcast it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ellipsoid GRS 80, the zones' scale factor, and the zones (number, origin latitude, central meridian, area).
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
SCALE = 0.9999
FIRST_EPSG = 6669
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX")
ZONES = (
    (1, 33.0, 129.5, "Nagasaki and western Kagoshima"),
    (2, 33.0, 131.0, "Fukuoka, Saga, Kumamoto, Oita, Miyazaki and most of Kagoshima"),
    (3, 36.0, 132 + 1 / 6, "Yamaguchi, Shimane and Hiroshima"),
    (4, 33.0, 133.5, "Kagawa, Ehime, Tokushima and Kochi"),
    (5, 36.0, 134 + 1 / 3, "Hyogo, Tottori and Okayama"),
    (6, 36.0, 136.0, "Kyoto, Osaka, Fukui, Shiga, Mie, Nara and Wakayama"),
    (7, 36.0, 137 + 1 / 6, "Ishikawa, Toyama, Gifu and Aichi"),
    (8, 36.0, 138.5, "Niigata, Nagano, Yamanashi and Shizuoka"),
    (9, 36.0, 139 + 5 / 6, "Tokyo, Kanagawa, Chiba, Saitama, Ibaraki, Tochigi, Gunma and Fukushima"),
    (10, 40.0, 140 + 5 / 6, "Aomori, Akita, Yamagata, Iwate and Miyagi"),
    (11, 44.0, 140.25, "Southwestern Hokkaido"),
    (12, 44.0, 142.25, "Central and northern Hokkaido"),
    (13, 44.0, 144.25, "Eastern Hokkaido"),
    (14, 26.0, 142.0, "Tokyo islands east of 140°30' E"),
    (15, 26.0, 127.5, "Central Okinawa"),
    (16, 26.0, 124.0, "Western Okinawa"),
    (17, 26.0, 131.0, "Eastern Okinawa"),
    (18, 20.0, 136.0, "Tokyo islands west of 140°30' E"),
    (19, 26.0, 154.0, "Tokyo islands east of 143° E"),
)

N = 1 / (2 * INVERSE_FLATTENING - 1)
ECCENTRICITY = 2 * math.sqrt(N) / (1 + N)
#: Radius of the rectifying sphere, scaled.
RADIUS = SCALE * SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Krueger's series in n, orders 1 to 5, to the fifth power: geographic to plane, and back.
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880,
    49561 * N**4 / 161280 - 179 * N**5 / 168,
    34729 * N**5 / 80640,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480,
    4397 * N**4 / 161280 - 11 * N**5 / 504,
    4583 * N**5 / 161280,
)


def meridian_arc(latitude: float) -> float:
    """Scaled distance along the meridian from the equator."""
    s = math.sin(math.radians(latitude))
    xi = math.atan(math.sinh(math.atanh(s) - ECCENTRICITY * math.atanh(ECCENTRICITY * s)))
    return RADIUS * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(ALPHA, 1)))


def crs_table(spark: SparkSession) -> DataFrame:
    """One row for each zone, in order of EPSG code."""
    rows = [
        (FIRST_EPSG + zone - 1, f"JGD2011 / Japan Plane Rectangular CS {ROMAN[zone - 1]}", "JGD2011", "metre", zone, ROMAN[zone - 1], lat0, lon0, SCALE, 0.0, 0.0, area, meridian_arc(lat0))
        for zone, lat0, lon0, area in ZONES
    ]
    names = "epsg_code int, name string, datum string, unit string, zone_number int, zone_label string, lat0 double, lon0 double, k0 double, false_easting double, false_northing double, area string, arc0 double"
    return spark.createDataFrame(rows, names)


def _haystack(first: tuple[str, ...], last: tuple[Column, ...]) -> Column:
    zone = [F.col("zone_label"), F.concat(F.lit("zone "), "zone_label"), F.col("zone_number").cast("string"), F.concat(F.lit("zone "), F.col("zone_number").cast("string"))]
    return F.lower(F.concat_ws(" ", *map(F.col, first), *zone, *last))


def search(crs: DataFrame, query: str | None) -> DataFrame:
    """Zones whose text holds every token of the query, split at white space; all for a blank query."""
    code = F.col("epsg_code").cast("string")
    return _matching(crs, (query or "").split(), _haystack(("name", "datum", "unit", "area"), (F.concat(F.lit("EPSG:"), code), code)))


def picker_filter(crs: DataFrame, query: str | None) -> DataFrame:
    """The variant of a picker: tokens are split at spaces only, and the text has another order."""
    code = F.col("epsg_code").cast("string")
    tokens = [t.strip() for t in (query or "").split(" ") if t.strip()]
    return _matching(crs, tokens, _haystack(("name", "area", "datum", "unit"), (code, F.concat(F.lit("EPSG:"), code))))


def _matching(crs: DataFrame, tokens: list[str], text: Column) -> DataFrame:
    for token in tokens:
        crs = crs.filter(text.contains(token.lower()))
    return crs


def _found(crs: DataFrame, rows: DataFrame, query: str, split: str, text: Column) -> DataFrame:
    """`rows`, each beside every zone (epsg_code) whose text holds all tokens of its query. The 19 zones travel as one constant array."""
    zones = [(r["epsg_code"], r["text"]) for r in crs.select("epsg_code", text.alias("text")).collect()]
    array = F.array(*(F.struct(F.lit(c).alias("epsg_code"), F.lit(t).alias("text")) for c, t in zones))
    tokens = F.filter(F.transform(F.split(F.lower(F.coalesce(F.col(query), F.lit(""))), split), lambda t: F.trim(t)), lambda t: t != "")
    rows = rows.withColumn("__tokens", tokens)
    fits = F.filter(array, lambda z: F.forall("__tokens", lambda t: F.contains(z["text"], t)))
    return rows.withColumn("epsg_code", F.explode(F.transform(fits, lambda z: z["epsg_code"]))).drop("__tokens")


def searched(crs: DataFrame, rows: DataFrame, query: str) -> DataFrame:
    """`search` for every row's own query."""
    code = F.col("epsg_code").cast("string")
    return _found(crs, rows, query, r"\s+", _haystack(("name", "datum", "unit", "area"), (F.concat(F.lit("EPSG:"), code), code)))


def picked(crs: DataFrame, rows: DataFrame, query: str) -> DataFrame:
    """`picker_filter` for every row's own query."""
    code = F.col("epsg_code").cast("string")
    return _found(crs, rows, query, " ", _haystack(("name", "area", "datum", "unit"), (code, F.concat(F.lit("EPSG:"), code))))


def display_text(code: Column, name: Column) -> Column:
    return F.concat(F.lit("EPSG:"), code.cast("string"), F.lit("  "), name)


def with_crs(rows: DataFrame, crs: DataFrame, epsg: str = "epsg", strict: bool = False) -> DataFrame:
    """`rows` with their zone's lat0, lon0 and arc0: null for an unknown code, or an error if `strict` (a null code is none)."""
    zone = crs.select(F.col("epsg_code").alias("__code"), "lat0", "lon0", "arc0")
    out = rows.join(F.broadcast(zone), F.col(epsg) == F.col("__code"), "left")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown EPSG code "), F.col(epsg).cast("string"))).cast("double")
        out = out.withColumn("lat0", F.when(F.col(epsg).isNotNull() & F.col("__code").isNull(), unknown).otherwise(F.col("lat0")))
        out = out.withColumn("arc0", F.when(F.col("lat0").isNotNull(), F.col("arc0")))
    return out.drop("__code")
