"""Mesh codes after JIS X 0410, as Column expressions: encode, decode, neighbours, overlay.

Encoding is plain double arithmetic in a fixed order; points on a cell's edge fall where that puts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spans of latitude and longitude by level (digits of the code), and neighbours in display order (north, east).
PRIMARY = (2.0 / 3.0, 1.0)
SECONDARY = (5.0 / 60.0, 7.5 / 60.0)
TERTIARY = (30.0 / 3600.0, 45.0 / 3600.0)
LEVELS = {4: PRIMARY, 6: SECONDARY, 8: TERTIARY}
NEIGHBOURS = (("NW", 1, -1), ("N", 1, 0), ("NE", 1, 1), ("W", 0, -1), ("E", 0, 1), ("SW", -1, -1), ("S", -1, 0), ("SE", -1, 1))


def _clamped(index: Column, size: int) -> Column:
    return F.least(F.greatest(index, F.lit(0)), F.lit(size - 1)).cast("int")


def _two_digits(index: Column) -> Column:
    """At least two digits after the sign."""
    size = F.abs(index)
    return F.concat(F.when(index < 0, "-").otherwise(""), F.when(size < 10, "0").otherwise(""), size.cast("string"))


def _digits(x: Column, axis: int) -> list[Column]:
    """Texts of the primary, secondary and tertiary index of a latitude (axis 0) or longitude (axis 1)."""
    first, second, third = (F.lit(span[axis]) for span in (PRIMARY, SECONDARY, TERTIARY))
    p = F.floor(x / first).cast("int") if axis == 0 else (F.floor(x) - 100).cast("int")
    edge = p * first if axis == 0 else p + F.lit(100.0)
    r = _clamped(F.floor((x - edge) / second), 8)
    s = _clamped(F.floor((x - (edge + r * second)) / third), 10)
    return [_two_digits(p), r.cast("string"), s.cast("string")]


def _usable(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e6)


def encode(lat: Column, lon: Column, digits: int = 8) -> Column:
    """The mesh code of a point at 4, 6 or 8 digits; null for a point that isn't finite."""
    pairs = list(zip(_digits(lat, 0), _digits(lon, 1), strict=True))[: digits // 2 - 1]
    return F.when(_usable(lat) & _usable(lon), F.concat(*(part for pair in pairs for part in pair)))


def bounds(code: Column, strict: bool = False) -> Column:
    """struct(south, west, north, east) of a code of 4, 6 or 8 digits; null for anything else, or an error if `strict`."""
    digit = lambda i, n=1: F.substring(code, i, n).cast("int")
    n = F.length(code)
    south = digit(1, 2) * F.lit(PRIMARY[0]) + F.when(n >= 6, digit(5) * F.lit(SECONDARY[0])).otherwise(0.0) + F.when(n == 8, digit(7) * F.lit(TERTIARY[0])).otherwise(0.0)
    west = digit(3, 2) + F.lit(100.0) + F.when(n >= 6, digit(6) * F.lit(SECONDARY[1])).otherwise(0.0) + F.when(n == 8, digit(8) * F.lit(TERTIARY[1])).otherwise(0.0)
    span = lambda k: F.when(n == 4, PRIMARY[k]).when(n == 6, SECONDARY[k]).otherwise(TERTIARY[k])
    box = F.struct(south.alias("south"), west.alias("west"), (south + span(0)).alias("north"), (west + span(1)).alias("east"))
    out = F.when(code.rlike("^([0-9]{4}|[0-9]{6}|[0-9]{8})$"), box)
    return out.otherwise(F.raise_error(F.concat(F.lit("not a mesh code: "), F.coalesce(code, F.lit("null"))))) if strict else out


def centre(box: Column) -> Column:
    return F.struct(((box["south"] + box["north"]) / 2).alias("lat"), ((box["west"] + box["east"]) / 2).alias("lon"))


def _bound(value: Column, f) -> Column:
    """f(value), with `value` computed once."""
    return F.transform(F.array(value), f)[0]


_STEPS = "array(" + ", ".join(f"struct({i} AS pos, '{name}' AS direction, {up} AS up, {right} AS right)" for i, (name, up, right) in enumerate(NEIGHBOURS)) + ")"


def _moved(b: Column, d: Column) -> tuple[Column, Column]:
    """The centre of the cell that lies a step d from the cell with bounds b."""
    lat = (b["south"] + b["north"]) / 2 + d["up"] * (b["north"] - b["south"])
    return lat, (b["west"] + b["east"]) / 2 + d["right"] * (b["east"] - b["west"])


def neighbours(code: Column) -> Column:
    """array(struct(pos, direction, code)) of the eight cells around a tertiary code; null for other codes."""

    def cell(b: Column, d: Column) -> Column:
        lat, lon = _moved(b, d)
        return F.struct(d["pos"].alias("pos"), d["direction"].alias("direction"), lat.alias("lat"), lon.alias("lon"))

    points = _bound(bounds(code), lambda b: F.transform(F.expr(_STEPS), lambda d: cell(b, d)))
    return F.when(F.length(code) == 8, F.transform(points, lambda p: F.struct(p["pos"].alias("pos"), p["direction"].alias("direction"), encode(p["lat"], p["lon"]).alias("code"))))


def neighbour_rows(rows: DataFrame, key: str, code: str) -> DataFrame:
    """(key, pos, direction, neighbor), eight rows for each row with a tertiary code; plain columns that compile."""
    cells = rows.filter(F.length(code) == 8).select(key, bounds(F.col(code)).alias("b")).select(key, "b", F.explode(F.expr(_STEPS)).alias("d"))
    lat, lon = _moved(F.col("b"), F.col("d"))
    points = cells.select(key, "d.pos", "d.direction", lat.alias("lat"), lon.alias("lon"))
    return points.select(key, "pos", "direction", encode(F.col("lat"), F.col("lon")).alias("neighbor"))


def tile_candidates(rows: DataFrame, key: str, code: str, nearby: bool = True) -> DataFrame:
    """Tiles to look at for each row: (key, tile_id, is_primary, source, position), the row's own tile first, then by id."""
    own = F.struct(F.col(code).alias("tile_id"), F.lit(True).alias("is_primary"), F.lit("primary").alias("source"))
    near = F.transform(neighbours(F.col(code)), lambda n: F.struct(n["code"].alias("tile_id"), F.lit(False).alias("is_primary"), F.lit("neighbor").alias("source")))
    tiles = F.concat(F.array(own), F.coalesce(near, F.array().cast("array<struct<tile_id:string,is_primary:boolean,source:string>>"))) if nearby else F.array(own)
    # a key's tiles are built from one row, so the first of each id is found within the row; each step is a column of its own
    rows = rows.filter(F.col(code).isNotNull()).select(key, tiles.alias("tiles")).withColumn("ids", F.transform("tiles", lambda t: t["tile_id"]))
    rows = rows.withColumn("tiles", F.filter("tiles", lambda t, i: F.array_position("ids", t["tile_id"]) == i + 1))
    ordered = F.concat(F.filter("tiles", lambda t: t["is_primary"]), F.array_sort(F.filter("tiles", lambda t: ~t["is_primary"])))
    return rows.select(key, F.posexplode(ordered).alias("position", "t")).select(key, "t.tile_id", "t.is_primary", "t.source", "position")


def _number(x: Column) -> Column:
    """At most eight decimals, without trailing zeros. Put together from whole numbers, as formatting takes several times as long."""
    unit = 10**8
    n = F.floor(F.abs(x) * float(unit) + 0.5)
    digits = F.concat(((n - n % unit) / unit).cast("long").cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), 8, "0"))
    return F.concat(F.when((x < 0) & (n > 0), "-").otherwise(""), F.rtrim(F.rtrim(digits, F.lit("0")), F.lit(".")))


_GRID = (-1, 0, 1)


def overlay_features(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """`keys` and `features`: a code's own cell, then the eight around it if it is tertiary, each once, as GeoJSON features.

    The nine cells share four latitudes and four longitudes, and three indexes either way: each is made once, as a column
    of its own. Few small steps compile to methods that the JVM compiles too.
    """
    c = F.col("__code")
    digit = lambda i, n=1: F.substring(c, i, n).cast("int")
    near = F.length(c) == 8
    rows = rows.select(*keys, F.col(code).alias("__code")).withColumn("__b", bounds(c))
    rows = rows.withColumns({"__lat": F.when(near, digit(1, 2) * 80 + digit(5) * 10 + digit(7)), "__lon": F.when(near, digit(3, 2) * 80 + digit(6) * 10 + digit(8))})
    for axis, low, high in (("lat", "south", "north"), ("lon", "west", "east")):
        lo, hi = F.col(f"__b.{low}"), F.col(f"__b.{high}")
        lines = (lo - (hi - lo), lo, hi, hi + (hi - lo))
        rows = rows.withColumns({f"__{axis}_edge{i}": _number(x) for i, x in enumerate(lines)})
        at = {k: F.col(f"__{axis}") + k for k in _GRID}
        rows = rows.withColumns({f"__{axis}_p{k + 1}": F.floor(x / 80).cast("int") for k, x in at.items()})
        rest = {k: x - F.col(f"__{axis}_p{k + 1}") * 80 for k, x in at.items()}
        rows = rows.withColumns({f"__{axis}_{n}{k + 1}": t for k, x in rest.items() for n, t in (("a", _two_digits(F.col(f"__{axis}_p{k + 1}"))), ("b", F.floor(x / 10).cast("string")), ("c", (x % 10).cast("string")))})
    codes = {(0, 0): c} | {(u, r): F.concat(*(f"__{axis}_{n}{k + 1}" for n in "abc" for axis, k in (("lat", u), ("lon", r)))) for _, u, r in NEIGHBOURS}
    edge = lambda axis, k: F.col(f"__{axis}_edge{k}")
    features = []
    for (u, r), cell in codes.items():
        south, north, west, east = edge("lat", u + 1), edge("lat", u + 2), edge("lon", r + 1), edge("lon", r + 2)
        first = F.concat(west, F.lit(","), south)
        own = "true" if (u, r) == (0, 0) else "false"
        head = F.concat(F.lit('{"type":"Feature","properties":{"meshCode":"'), cell, F.lit(f'","isPrimary":{own}' + '},"geometry":{"type":"Polygon","coordinates":[[['))
        features.append(F.concat(head, first, F.lit("],["), east, F.lit(","), south, F.lit("],["), east, F.lit(","), north, F.lit("],["), west, F.lit(","), north, F.lit("],["), first, F.lit("]]]}}")))
    for i, f in enumerate(features):  # a step each
        rows = rows.withColumn(f"__f{i}", f)
    # out of a generator of one row: filters on the features stay above it, where a plain column's chain of steps would be written out in them
    out = F.array_compact(F.array(*(f"__f{i}" for i in range(len(features)))))
    return rows.select(*keys, F.inline(F.array(F.struct(out.alias("features")))))


def feature_collection(features: Column) -> Column:
    """Features as the text of a FeatureCollection."""
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", features), F.lit("]}"))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
