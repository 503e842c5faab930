"""DuckDB SQL of the catalogue's queries, written apart from the Column builders.

The projection goes by the isometric latitude and the inverse by a fixed-point iteration, so the two sides share the
series' constants alone.
"""

from __future__ import annotations

from gridloom.sources import crs

SITES = """SELECT c_custkey AS site_id, 24 + (c_custkey * 7919 % 200000) / 10000.0 AS lat, 123 + (c_custkey * 104729 % 300000) / 10000.0 AS lon,
    CAST(6669 + c_custkey % 19 AS INT) AS epsg, CAST(c_custkey * 31 % 200000 - 100000 AS DOUBLE) AS east, CAST(c_custkey * 17 % 300000 - 150000 AS DOUBLE) AS north FROM customer"""

ZONES = "(VALUES " + ", ".join(f"({6668 + z}, {z}, '{crs.ROMAN[z - 1]}', {a!r}::DOUBLE, {b!r}::DOUBLE, '{area.replace(chr(39), chr(39) * 2)}')" for z, a, b, area in crs.ZONES) + ") z(code, zone, label, lat0, lon0, area)"
NAME = "'JGD2011 / Japan Plane Rectangular CS ' || label"


def mesh(lat: str, lon: str, digits: int = 8) -> str:
    p, q = f"floor({lat} / (2.0::DOUBLE / 3))::INT", f"(floor({lon})::INT - 100)"
    south, west = f"({p} * (2.0::DOUBLE / 3))", f"({q} + 100.0::DOUBLE)"
    cut = lambda x, n: f"least(greatest(floor({x})::INT, 0), {n - 1})"
    r, v = cut(f"({lat} - {south}) / (5.0::DOUBLE / 60)", 8), cut(f"({lon} - {west}) / (7.5::DOUBLE / 60)", 8)
    code = f"printf('%02d%02d', {p}, {q})"
    if digits >= 6:
        code += f" || {r} || {v}"
    if digits == 8:
        code += f" || {cut(f'({lat} - ({south} + {r} * (5.0::DOUBLE / 60))) / (30.0::DOUBLE / 3600)', 10)} || {cut(f'({lon} - ({west} + {v} * (7.5::DOUBLE / 60))) / (45.0::DOUBLE / 3600)', 10)}"
    return f"({code})"


def _sum(coefficients, trig: str, hyper: str, x: str, y: str) -> str:
    return " + ".join(f"{c!r}::DOUBLE * {trig}({2 * j} * {x}) * {hyper}({2 * j} * {y})" for j, c in enumerate(coefficients, 1))


E_ = f"{crs.ECCENTRICITY!r}::DOUBLE"
R_ = f"{crs.RADIUS!r}::DOUBLE"


def _isometric(phi: str) -> str:
    return f"(atanh(sin({phi})) - {E_} * atanh({E_} * sin({phi})))"


ARC = f"SELECT code, lon0, {R_} * (atan(sinh(q)) + {' + '.join(f'{c!r}::DOUBLE * sin({2 * j} * atan(sinh(q)))' for j, c in enumerate(crs.ALPHA, 1))}) AS arc FROM (SELECT code, lon0, {_isometric('radians(lat0)')} AS q FROM {ZONES})"


def forward(points: str) -> str:
    """easting and northing of (key..., epsg, lat, lon)."""
    return f"""SELECT b.*, {R_} * (eta + {_sum(crs.ALPHA, 'cos', 'sinh', 'xi', 'eta')}) AS easting, {R_} * (xi + {_sum(crs.ALPHA, 'sin', 'cosh', 'xi', 'eta')}) - arc AS northing
        FROM (SELECT a.*, atan2(sinh(q), cos(l)) AS xi, 0.5 * ln((1 + sin(l) / cosh(q)) / (1 - sin(l) / cosh(q))) AS eta
              FROM (SELECT p.*, arc, {_isometric('radians(lat)')} AS q, radians(lon - lon0) AS l FROM ({points}) p LEFT JOIN ({ARC}) ON code = epsg) a) b"""


def inverse(points: str) -> str:
    """lat and lon of (key..., epsg, east, north)."""
    phi = "asin(tanh(psi))"
    for _ in range(7):
        phi = f"asin(tanh(psi + {E_} * atanh({E_} * sin({phi}))))"
    return f"""SELECT c.*, degrees({phi}) AS plat, lon0 + degrees(atan2(sinh(eta), cos(xi))) AS plon
        FROM (SELECT b.*, atanh(sin(xi) / cosh(eta)) AS psi
              FROM (SELECT a.*, x - ({_sum(crs.BETA, 'sin', 'cosh', 'x', 'y')}) AS xi, y - ({_sum(crs.BETA, 'cos', 'sinh', 'x', 'y')}) AS eta
                    FROM (SELECT p.*, lon0, (north + arc) / {R_} AS x, east / {R_} AS y FROM ({points}) p JOIN ({ARC}) ON code = epsg) a) b) c"""


#: A project's facts; null in lat stands for a missing origin.
RAW = """SELECT c_custkey AS id, c_custkey % 23 <> 0 AS supported, c_custkey % 6 = 0 AS read_only, c_custkey % 17 <> 0 AS info,
    CASE WHEN c_custkey % 17 = 0 OR c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 999999 ELSE (6669 + c_custkey % 19)::INT END AS epsg,
    'zone ' || (c_custkey % 19 + 1) AS crs_name,
    CASE WHEN c_custkey % 17 = 0 OR c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 10.0 ELSE 24 + (c_custkey * 7919 % 200000) / 10000.0 END::DOUBLE AS lat,
    CASE WHEN c_custkey % 17 = 0 OR c_custkey % 13 = 0 THEN NULL ELSE 123 + (c_custkey * 104729 % 300000) / 10000.0 END::DOUBLE AS lon,
    CASE WHEN c_custkey % 17 = 0 OR c_custkey % 13 = 0 THEN NULL ELSE c_custkey * 37 % 6000 - 400 END::DOUBLE AS elevation,
    (c_custkey % 720 - 360)::DOUBLE AS angle, (c_custkey % 3)::INT AS confidence,
    CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'survey ' || (c_custkey % 4) END AS source,
    CASE WHEN c_custkey % 5 = 0 THEN (6669 + c_custkey % 19)::INT END AS wp_epsg,
    CASE WHEN c_custkey % 5 < 2 THEN 35 + (c_custkey % 1000) / 1000.0 END::DOUBLE AS wp_lat, CASE WHEN c_custkey % 5 < 2 THEN 139 + (c_custkey % 1000) / 1000.0 END::DOUBLE AS wp_lon,
    CASE WHEN c_custkey % 5 = 0 AND c_custkey % 7 <> 0 THEN c_custkey % 5000 / 10.0 END::DOUBLE AS wp_e, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 7000 / -10.0 END::DOUBLE AS wp_n,
    CASE WHEN c_custkey % 3 <> 0 THEN 34 + (c_custkey % 500) / 500.0 END::DOUBLE AS est_lat, CASE WHEN c_custkey % 3 <> 0 THEN 138 + (c_custkey % 500) / 500.0 END::DOUBLE AS est_lon,
    c_custkey % 100 AS bp_x, c_custkey % 30 AS bp_z, c_custkey % 90 AS sp_x, c_custkey % 20 AS sp_z, c_custkey AS k FROM customer"""
PROJECTS = f"SELECT *, {mesh('lat', 'lon')} AS own, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '53394611' ELSE {mesh('lat', 'lon')} END AS mesh FROM ({RAW})"
LOCATED = forward(PROJECTS)

_OWN = [("missing-info", "NOT info"), ("missing-crs", "info AND epsg IS NULL"), ("invalid-crs", "info AND epsg = 999999"), ("missing-origin", "info AND lat IS NULL"),
        ("outside-japan-range", "lat NOT BETWEEN 20 AND 46 OR lon NOT BETWEEN 122 AND 154"), ("suspicious-elevation", "elevation NOT BETWEEN -500 AND 5000"),
        ("large-offset", "sqrt(easting ** 2 + northing ** 2) > 100000"), ("stale-mesh", "lat IS NOT NULL AND mesh <> own")]
VALIDATION = " UNION ALL ".join(f"SELECT id AS project_id, '{c}' AS code, 1 AS severity FROM located WHERE {w}" for c, w in _OWN)
_HEALTH = [("read-only-document", 0, "supported AND read_only"), ("missing-info", 2, "supported AND NOT info"), ("unsupported-document", 2, "NOT supported"),
           ("missing-crs", 2, "supported AND info AND epsg IS NULL"), ("missing-origin", 2, "supported AND info AND lat IS NULL"),
           ("unknown-confidence", 1, "supported AND info AND confidence = 0"), ("missing-primary-mesh", 0, "supported AND info AND mesh IS NULL")]
_HEALTH += [(c, 1, f"supported AND ({w})") for c, w in _OWN if not c.startswith("missing")]
FINDINGS = " UNION ALL ".join(f"SELECT id AS project_id, '{c}' AS code, {s} AS severity FROM located WHERE {w}" for c, s, w in _HEALTH)
WITH_FINDINGS = f"WITH located AS ({LOCATED}), found AS ({FINDINGS}), per AS (SELECT project_id, max(severity) AS worst, list(code) AS codes FROM found GROUP BY 1), j AS (SELECT l.*, per.worst, coalesce(codes, []) AS codes FROM located l LEFT JOIN per ON id = project_id)"
