"""The query catalogue: one entry per operator, with its DuckDB oracle where SQL can say it.

A query takes (spark, sf_dir). Inputs are derived from the driver's tables by `gridloom.sources.sites`, or from the
tables' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import mesh, projection, text
from gridloom.operators import importing, rules, workflow
from gridloom.plans import oracle as o
from gridloom.sources import citygml, crs
from gridloom.sources.sites import projects, sites

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- CRS ---


@query(f"""SELECT code AS epsg_code, {o.NAME} AS name, 'EPSG:' || code || '  ' || {o.NAME} AS display, zone AS zone_number, label AS zone_label, lat0, lon0, area, count(site_id) AS sites, min(site_id) AS first_site
    FROM {o.ZONES} LEFT JOIN ({o.SITES}) ON epsg = code GROUP BY ALL""")
def crs_list(spark, sf_dir):
    """The ordered list of systems, with how many sites each has."""
    counted = sites(spark, sf_dir).groupBy("epsg").agg(F.count(F.lit(1)).alias("sites"), F.min("site_id").alias("first_site"))
    zones = crs.crs_table(spark).join(counted, F.col("epsg") == F.col("epsg_code"), "left").orderBy("epsg_code")
    display = crs.display_text(F.col("epsg_code"), F.col("name")).alias("display")
    return zones.select("epsg_code", "name", display, "zone_number", "zone_label", "lat0", "lon0", "area", F.coalesce("sites", F.lit(0)).alias("sites"), "first_site")


@query(f"SELECT c_custkey, CASE WHEN code IS NOT NULL THEN {o.NAME} END AS name FROM customer LEFT JOIN {o.ZONES} ON code = 6660 + c_custkey % 40")
def crs_lookup(spark, sf_dir):
    codes = _read(spark, sf_dir, "customer").select("c_custkey", (6660 + F.col("c_custkey") % 40).alias("code"))
    return codes.join(F.broadcast(crs.crs_table(spark)), F.col("code") == F.col("epsg_code"), "left").select("c_custkey", "name")


_HAY = f"lower(concat_ws(' ', {o.NAME}, 'JGD2011 metre', area, label, 'zone', zone, 'EPSG:' || code))"
_WORD = "['Chiba', 'OKINAWA', '9', ''][s_suppkey % 4 + 1]"


@query(f"SELECT s_suppkey, code AS epsg_code FROM supplier JOIN {o.ZONES} ON {_HAY} LIKE '%zone%' AND {_HAY} LIKE '%' || (s_suppkey % 19 + 1) || '%' AND {_HAY} LIKE '%' || lower({_WORD}) || '%'")
def crs_search(spark, sf_dir):
    """A search for each supplier: a zone's number and, for three in four, a place or digit."""
    word = F.element_at(F.array(*map(F.lit, ("Chiba", "OKINAWA", "9", ""))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit(" zone\t"), (F.col("s_suppkey") % 19 + 1).cast("string"), F.lit(" "), word).alias("q"))
    return crs.searched(crs.crs_table(spark), rows, "q").select("s_suppkey", "epsg_code")


@query(f"SELECT n_nationkey, code AS epsg_code FROM nation JOIN {o.ZONES} ON {_HAY} LIKE '%' || lower(n_name[1:2]) || '%' AND {_HAY} LIKE '%zone%'")
def crs_filter(spark, sf_dir):
    """The picker's variant, for the first two letters of each nation."""
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("zone  "), F.substring("n_name", 1, 2)).alias("q"))
    return crs.picked(crs.crs_table(spark), rows, "q").select("n_nationkey", "epsg_code")


# --- coordinates ---


@query(f"SELECT site_id, round(easting, 3) AS easting, round(northing, 3) AS northing FROM ({o.forward(o.SITES)})")
def project_forward(spark, sf_dir):
    out = projection.project(crs.with_crs(sites(spark, sf_dir), crs.crs_table(spark)))
    return _rounded(out.select("site_id", "easting", "northing"), 3, "easting", "northing")


@query(f"SELECT site_id, round(plat, 7) AS plat, round(plon, 7) AS plon FROM ({o.inverse(o.SITES)})")
def project_inverse(spark, sf_dir):
    out = projection.unproject(crs.with_crs(sites(spark, sf_dir), crs.crs_table(spark)), "east", "north", "plat", "plon")
    return _rounded(out.select("site_id", "plat", "plon"), 7, "plat", "plon")


@query(f"SELECT site_id, round(sqrt(east * east + north * north), 6) AS distance FROM ({o.SITES})")
def distance_from_origin(spark, sf_dir):
    return sites(spark, sf_dir).select("site_id", F.round(projection.distance_from_origin(F.col("east"), F.col("north")), 6).alias("distance"))


@query(f"SELECT site_id, round(lat + degrees(north / 6378137), 8) AS olat, round(lon + degrees(east / (6378137 * cos(radians(lat)))), 8) AS olon FROM ({o.SITES})")
def local_offset(spark, sf_dir):
    lat, lon = projection.local_offset(F.col("lat"), F.col("lon"), F.col("east"), F.col("north"))
    return sites(spark, sf_dir).select("site_id", F.round(lat, 8).alias("olat"), F.round(lon, 8).alias("olon"))


@query(f"""SELECT site_id, CASE WHEN site_id % 5 < 3 AND site_id % 7 <> 0 THEN lat END AS plat, CASE WHEN site_id % 5 < 3 AND site_id % 7 <> 0 THEN lon END AS plon
    FROM (SELECT site_id, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM ({o.SITES}))""")
def coord_pair_parse(spark, sf_dir):
    """Pairs with commas, semicolons and slashes; every fifth has a third number, every fifth a word, every seventh is out of range."""
    lat = F.when(F.col("site_id") % 7 == 0, F.lit("95")).otherwise(F.col("lat").cast("string"))
    lon = F.col("lon").cast("string")
    forms = (F.concat(F.lit(" "), lat, F.lit(", "), lon), F.concat(lat, F.lit(";"), lon), F.concat(lat, F.lit(" / "), lon, F.lit(" ")), F.concat(lat, F.lit(","), lon, F.lit(" 5")), F.concat(F.lit("near "), lat))
    pair = text.coordinate_pair(F.element_at(F.array(*forms), (F.col("site_id") % 5 + 1).cast("int")))
    return sites(spark, sf_dir).select("site_id", pair["lat"].alias("plat"), pair["lon"].alias("plon"))


@query(f"SELECT site_id, CASE WHEN site_id % 2 = 0 THEN 'Verified' ELSE 'Approximate' END AS label, round(CASE WHEN site_id % 2 = 0 THEN plat ELSE lat END, 7) AS rlat, round(CASE WHEN site_id % 2 = 0 THEN plon ELSE lon END, 7) AS rlon FROM ({o.inverse(o.SITES)})")
def point_entry(spark, sf_dir):
    """Typed coordinates are unprojected and verified; clicked ones are approximate."""
    rows = projection.unproject(crs.with_crs(sites(spark, sf_dir), crs.crs_table(spark)), "east", "north", "plat", "plon")
    known = F.col("site_id") % 2 == 0
    pick = lambda a, b, n: F.round(F.when(known, F.col(a)).otherwise(F.col(b)), 7).alias(n)
    return rows.select("site_id", F.when(known, "Verified").otherwise("Approximate").alias("label"), pick("plat", "lat", "rlat"), pick("plon", "lon", "rlon"))


@query(f"SELECT site_id, round(east / 0.3048, 6) AS feet, round(east / 0.3048 * 0.3048, 6) AS metres, round(lat * pi() / 180, 9) AS rad FROM ({o.SITES})")
def unit_conversion(spark, sf_dir):
    ft = projection.feet(F.col("east"))
    return sites(spark, sf_dir).select("site_id", F.round(ft, 6).alias("feet"), F.round(projection.metres(ft), 6).alias("metres"), F.round(F.radians("lat"), 9).alias("rad"))


# --- mesh ---


def _encoded(digits):
    def run(spark, sf_dir):
        return sites(spark, sf_dir).select("site_id", mesh.encode(F.col("lat"), F.col("lon"), digits).alias("code"))

    return run


_POINT = f"(SELECT site_id, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM ({o.SITES}))"
_CODES = f"(SELECT site_id, {o.mesh('lat', 'lon')} AS code FROM {_POINT})"
for _level, _digits in enumerate((4, 6, 8), 1):
    QUERIES[f"mesh_encode_l{_level}"] = _encoded(_digits)
    ORACLE_SQL[f"mesh_encode_l{_level}"] = f"SELECT site_id, {o.mesh('lat', 'lon', _digits)} AS code FROM {_POINT}"

_INDEX = f"(SELECT site_id, code, substr(code, 1, 2)::INT * 80 + substr(code, 5, 1)::INT * 10 + substr(code, 7, 1)::INT AS la, substr(code, 3, 2)::INT * 80 + substr(code, 6, 1)::INT * 10 + substr(code, 8, 1)::INT AS lo FROM {_CODES})"
_AROUND = "(VALUES (0, 'NW', 1, -1), (1, 'N', 1, 0), (2, 'NE', 1, 1), (3, 'W', 0, -1), (4, 'E', 0, 1), (5, 'SW', -1, -1), (6, 'S', -1, 0), (7, 'SE', -1, 1)) d(pos, direction, up, rt)"
_NEAR = "printf('%02d%02d%d%d%d%d', (la + up) // 80, (lo + rt) // 80, (la + up) % 80 // 10, (lo + rt) % 80 // 10, (la + up) % 10, (lo + rt) % 10)"


@query(f"SELECT site_id, code, round(la / 120.0, 9) AS south, round(100 + lo / 80.0, 9) AS west, round((la + 1) / 120.0, 9) AS north, round(100 + (lo + 1) / 80.0, 9) AS east FROM {_INDEX}")
def mesh_bounds(spark, sf_dir):
    rows = QUERIES["mesh_encode_l3"](spark, sf_dir).withColumn("b", mesh.bounds(F.col("code")))
    return _rounded(rows.select("site_id", "code", "b.*"), 9, "south", "west", "north", "east")


@query(f"SELECT site_id, round((la + 0.5) / 120, 9) AS clat, round(100 + (lo + 0.5) / 80, 9) AS clon FROM {_INDEX}")
def mesh_center(spark, sf_dir):
    c = mesh.centre(mesh.bounds(F.col("code")))
    return QUERIES["mesh_encode_l3"](spark, sf_dir).select("site_id", F.round(c["lat"], 9).alias("clat"), F.round(c["lon"], 9).alias("clon"))


@query(f"SELECT site_id, pos, direction, {_NEAR} AS neighbor FROM {_INDEX}, {_AROUND}")
def mesh_neighbors(spark, sf_dir):
    return mesh.neighbour_rows(QUERIES["mesh_encode_l3"](spark, sf_dir), "site_id", "code")


@query(f"""SELECT site_id, tile_id, is_primary, source, (row_number() OVER (PARTITION BY site_id ORDER BY is_primary DESC, tile_id) - 1)::INT AS position
    FROM (SELECT site_id, code AS tile_id, true AS is_primary, 'primary' AS source FROM {_CODES} UNION ALL SELECT site_id, {_NEAR}, false, 'neighbor' FROM {_INDEX}, {_AROUND})""")
def tile_candidates(spark, sf_dir):
    return mesh.tile_candidates(QUERIES["mesh_encode_l3"](spark, sf_dir), "site_id", "code")


_CUT = lambda x: f"regexp_replace(regexp_replace(printf('%.8f', {x}), '0+$', ''), '\\.$', '')"
_W, _S, _E, _N = (_CUT(x) for x in ("100 + lo / 80.0", "la / 120.0", "100 + (lo + 1) / 80.0", "(la + 1) / 120.0"))
_CELL = f"""'{{"type":"Feature","properties":{{"meshCode":"' || cell || '","isPrimary":' || CASE WHEN pos < 0 THEN 'true' ELSE 'false' END || '}},"geometry":{{"type":"Polygon","coordinates":[[['
    || {_W} || ',' || {_S} || '],[' || {_E} || ',' || {_S} || '],[' || {_E} || ',' || {_N} || '],[' || {_W} || ',' || {_N} || '],[' || {_W} || ',' || {_S} || ']]]}}}}'"""


@query(f"""WITH cells AS (SELECT site_id, -1 AS pos, code AS cell, la, lo FROM {_INDEX} UNION ALL SELECT site_id, pos, {_NEAR}, la + up, lo + rt FROM {_INDEX}, {_AROUND})
    SELECT site_id, '{{"type":"FeatureCollection","features":[' || string_agg({_CELL}, ',' ORDER BY pos) || ']}}' AS geojson FROM cells GROUP BY 1""")
def mesh_geojson(spark, sf_dir):
    cells = mesh.overlay_features(QUERIES["mesh_encode_l3"](spark, sf_dir), ["site_id"], "code")
    return cells.select("site_id", mesh.feature_collection(F.col("features")).alias("geojson"))


_BLOCK = "CASE WHEN NOT supported THEN 'unsupported' WHEN epsg IS NULL OR lat IS NULL THEN 'incomplete metadata'"
_OK = "supported AND epsg IS NOT NULL AND lat IS NOT NULL"
_VALID = "coalesce(wp_epsg IS NOT NULL AND wp_lat IS NOT NULL AND wp_e IS NOT NULL AND wp_n IS NOT NULL, false)"


@query(f"""SELECT id AS project_id, CASE WHEN {_OK} THEN 'survey' END AS title, CASE WHEN {_OK} THEN own END AS code,
    {_BLOCK} WHEN mesh IS NULL THEN 'Not stored yet' WHEN mesh = own THEN 'Stored value is current' ELSE 'Stored value is stale' END AS mesh_status,
    {_OK} AND NOT read_only AND (mesh IS NULL OR mesh <> own) AS can_save FROM ({o.PROJECTS})""")
def mesh_inspect_status(spark, sf_dir):
    return workflow.inspect_mesh(projects(spark, sf_dir))


@query(f"""SELECT id AS project_id, title, CASE title WHEN 'working' THEN {o.mesh('wp_lat', 'wp_lon')} WHEN 'base' THEN {o.mesh('est_lat', 'est_lon')} END AS code,
    {_BLOCK} WHEN title IS NULL THEN 'no base point' ELSE 'Inspection only' END AS mesh_status, false AS can_save
    FROM (SELECT *, CASE WHEN {_OK} AND {_VALID} THEN 'working' WHEN {_OK} AND est_lat IS NOT NULL THEN 'base' END AS title FROM ({o.PROJECTS}))""")
def mesh_inspect_base(spark, sf_dir):
    return workflow.inspect_mesh(projects(spark, sf_dir), "base")


# --- rules ---


def _validated(spark, sf_dir):
    return rules.validation(rules.located(projects(spark, sf_dir)))


def _healthy(spark, sf_dir):
    return rules.health(_validated(spark, sf_dir))


@query(f"WITH located AS ({o.LOCATED}) {o.VALIDATION}")
def coord_validate(spark, sf_dir):
    return _validated(spark, sf_dir).select("project_id", F.inline("validation")).select("project_id", "code", "severity")


@query(f"""WITH located AS ({o.LOCATED}), found AS ({o.FINDINGS}), stopped AS (SELECT project_id FROM found WHERE code = 'missing-info')
    SELECT project_id, code, severity, (row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN code = 'read-only-document' AND project_id IN (FROM stopped) THEN 3 ELSE severity END DESC, code) - 1)::INT AS place FROM found""")
def health_findings(spark, sf_dir):
    return _healthy(spark, sf_dir).select("project_id", F.posexplode("findings").alias("place", "f")).select("project_id", "f.code", "f.severity", "place")


@query(f"{o.WITH_FINDINGS} SELECT id AS project_id, worst, CASE worst WHEN 2 THEN 'errors stand in the way' WHEN 1 THEN 'warnings to look at' ELSE 'nothing wrong' END AS status_title FROM j")
def health_status(spark, sf_dir):
    return rules.status(_healthy(spark, sf_dir)).select("project_id", "worst", "status_title")


@query(f"""{o.WITH_FINDINGS} SELECT id AS project_id, CASE WHEN NOT supported OR epsg IS NULL OR lat IS NULL OR worst = 2 OR list_contains(codes, 'invalid-crs') THEN 'Blocked'
    WHEN worst = 1 OR list_has_any(codes, ['missing-primary-mesh', 'read-only-document']) THEN 'NeedsAttention' ELSE 'Ready' END AS readiness FROM j""")
def export_readiness(spark, sf_dir):
    return rules.readiness(_healthy(spark, sf_dir)).select("project_id", "readiness")


@query(f"""{o.WITH_FINDINGS} SELECT id AS project_id, seq, CASE seq WHEN 0 THEN supported WHEN 1 THEN epsg IS NOT NULL AND NOT list_contains(codes, 'invalid-crs') WHEN 2 THEN lat IS NOT NULL
    WHEN 3 THEN info AND confidence <> 0 ELSE info AND mesh IS NOT NULL AND NOT list_contains(codes, 'stale-mesh') END AS satisfied FROM j, (SELECT unnest(range(5))::INT AS seq)""")
def readiness_items(spark, sf_dir):
    return rules.readiness(_healthy(spark, sf_dir)).select("project_id", F.inline("items")).select("project_id", "seq", "satisfied")


@query("""SELECT c_custkey AS project_id, concat_ws(', ', CASE WHEN c_custkey % 3 = 2 THEN 'east-west offset' END, CASE WHEN c_custkey % 4 > 0 THEN 'north-south offset' END,
    CASE WHEN c_custkey % 2 = 1 THEN 'true north angle' END, CASE WHEN c_custkey % 17 <> 0 THEN 'stored metadata' END) AS reasons,
    c_custkey % 3 = 2 OR c_custkey % 4 > 0 OR c_custkey % 2 = 1 OR c_custkey % 17 <> 0 AS detected FROM customer""")
def existing_setup(spark, sf_dir):
    return rules.existing_setup(projects(spark, sf_dir)).select("project_id", "reasons", "detected")


# --- workflow ---


def _intents(spark, sf_dir):
    """Snapshots with an intent each: the project's own values, changed or taken away by its id."""
    k = F.col("project_id")
    rows = rules.located(projects(spark, sf_dir))
    return rows.withColumns({
        "i_epsg": F.when(k % 8 == 0, None).otherwise(F.col("epsg")), "i_name": F.col("crs_name"),
        "i_lat": F.when(k % 9 == 0, None).otherwise(F.col("lat")), "i_lon": F.when(k % 9 == 0, None).otherwise(F.col("lon")),
        "i_easting": F.when(k % 14 == 0, F.lit(float("nan"))).when(k % 15 != 0, (k % 1000).cast("double")), "i_northing": (k % 500).cast("double"),
        "i_mode": (k % 3).cast("int"), "i_angle": F.when(k % 4 == 0, None).otherwise((k % 800 - 400).cast("double")),
        "i_anchor": (k % 3).cast("int"), "i_confidence": (k % 3).cast("int"), "i_source": F.col("setup_source"),
        "i_elevation": F.when(k % 2 == 0, F.col("elevation")).otherwise(F.lit(0.0)),
    })


_I = f"""(SELECT *, CASE WHEN k % 8 <> 0 THEN epsg END AS ie, CASE WHEN k % 9 <> 0 THEN lat END AS il, k % 14 <> 0 AND k % 15 <> 0 AS ip, CASE WHEN k % 4 <> 0 THEN k % 800 - 400 END AS ia,
    wp_epsg IS NOT NULL OR wp_lat IS NOT NULL AS has, {_VALID} AS valid FROM ({o.PROJECTS}))"""
_ERRORS = ["ie IS NULL", "il IS NULL", "NOT ip", "source = ''", "k % 3 = 2 AND ia IS NULL", "abs(ia) > 360", "has AND wp_epsg IS NULL", "has AND wp_lat IS NULL", "has AND (wp_e IS NULL OR wp_n IS NULL)", "has AND ie <> wp_epsg"]


@query("SELECT id AS project_id, concat_ws(', ', " + ", ".join(f"CASE WHEN {t} THEN '{e}' END" for t, e in zip(_ERRORS, rules.INTENT_ERRORS, strict=True)) + ") AS errors, NOT (" + " OR ".join(f"coalesce({t}, false)" for t in _ERRORS) + f") AS ready FROM {_I}")
def intent_validate(spark, sf_dir):
    return workflow.preview_ready(_intents(spark, sf_dir)).select("project_id", F.concat_ws(", ", "errors").alias("errors"), "ready")


@query(f"SELECT id AS project_id, concat_ws(', ', CASE WHEN ie IS NULL THEN 'CRS' END, CASE WHEN il IS NULL THEN 'point' END) AS missing FROM {_I}")
def selection_check(spark, sf_dir):
    return _intents(spark, sf_dir).select("project_id", F.concat_ws(", ", rules.missing_selection(F.col("i_epsg"), F.col("i_lat"), F.col("i_mode"))).alias("missing"))


@query(f"""SELECT id AS project_id, CASE WHEN lat IS NOT NULL THEN 'stored' WHEN k % 3 <> 0 THEN 'base point' WHEN k % 9 <> 0 THEN 'site' ELSE '' END AS source,
    round(CASE WHEN lat IS NOT NULL THEN lat WHEN k % 3 <> 0 THEN est_lat WHEN k % 9 <> 0 THEN 33.5 END, 9) AS clat,
    round(CASE WHEN lat IS NOT NULL THEN elevation WHEN k % 3 <> 0 THEN bp_z * 0.3048 WHEN k % 9 <> 0 THEN k % 8 * 0.3048 END, 9) AS elevation,
    round(CASE WHEN info THEN angle ELSE degrees(k % 2 * 0.25) END, 9) AS angle FROM ({o.PROJECTS})""")
def current_state_fallback(spark, sf_dir):
    rows = workflow.current_state(projects(spark, sf_dir))
    return rows.select("project_id", "current.source", F.round("current.lat", 9).alias("clat"), F.round("current.elevation", 9).alias("elevation"), F.round("current_angle", 9).alias("angle"))


@query(f"""SELECT id AS project_id, CASE WHEN valid THEN wp_epsg WHEN k % 3 = 2 AND ie IS NOT NULL AND il IS NOT NULL AND ip THEN ie END AS epsg,
    CASE WHEN valid THEN wp_e WHEN k % 3 = 2 AND ie IS NOT NULL AND il IS NOT NULL AND ip THEN k % 1000 END::DOUBLE AS easting FROM {_I}""")
def working_point_resolve(spark, sf_dir):
    i = lambda n: F.col(f"i_{n}")
    p = workflow.resolve_working_point(workflow.working_point(), i("anchor"), i("epsg"), i("name"), i("lat"), i("lon"), i("easting"), i("northing"))
    return _intents(spark, sf_dir).withColumn("p", p).select("project_id", "p.epsg", "p.easting")


@query(f"""SELECT id AS project_id, title, CASE WHEN title = 'working' THEN wp_epsg ELSE epsg END AS epsg, round(CASE WHEN title = 'working' THEN wp_e ELSE easting END, 3) AS easting,
    (CASE WHEN title = 'canonical' THEN sp_x ELSE bp_x END)::DOUBLE AS x
    FROM ({o.forward(f"SELECT id, title, epsg, wp_epsg, wp_e, sp_x, bp_x, CASE WHEN title = 'base' THEN est_lat ELSE lat END AS lat, CASE WHEN title = 'base' THEN est_lon ELSE lon END AS lon FROM (SELECT *, CASE WHEN k % 2 = 0 AND {_VALID} THEN 'working' WHEN k % 2 = 0 AND est_lat IS NOT NULL THEN 'base' ELSE 'canonical' END AS title FROM ({o.PROJECTS}) WHERE epsg IS NOT NULL AND lat IS NOT NULL)")})""")
def reference_resolve(spark, sf_dir):
    rows = workflow.import_reference(projects(spark, sf_dir), F.col("project_id") % 2 == 0)
    return rows.select("project_id", "title", "epsg", F.round("easting", 3).alias("easting"), "x")


@query(f"SELECT id AS project_id, CASE WHEN k % 4 = 0 THEN 'CanonicalOrigin' WHEN {_VALID} OR est_lat IS NOT NULL THEN 'WorkingProjectBasePoint' ELSE 'CanonicalOrigin' END AS source FROM ({o.PROJECTS})")
def import_source_default(spark, sf_dir):
    last = F.when(F.col("project_id") % 4 == 0, "CanonicalOrigin")
    source = workflow.default_import_source(last, workflow.valid_point(workflow.working_point()), F.col("est_lat").isNotNull())
    return projects(spark, sf_dir).select("project_id", source.alias("source"))


_CONF = "['Unknown', 'Approximate', 'Verified'][confidence + 1] || ' / ' || CASE WHEN source = '' THEN 'No source note' ELSE source END"


_ORIGIN = lambda a, b, c: f"CASE WHEN {a} IS NULL THEN 'Unknown' ELSE printf('Lat %.6f, Lon %.6f, Elev %.3f m', {a}, {b}, ({c})::DOUBLE) END"
_EN = lambda a, b: f"printf('E %.4f m, N %.4f m', ({a})::DOUBLE, ({b})::DOUBLE)"
_CRS = lambda e: f"CASE WHEN {e} IS NULL THEN 'Not stored' ELSE 'EPSG:' || {e} || '  ' || crs_name END"
_OWN_POINT = "(k % 3 = 2 AND ie IS NOT NULL AND il IS NOT NULL AND ip)"
_STORED_POINT = f"{_CRS('wp_epsg')} || ' / ' || {_EN('wp_e', 'wp_n')} || ' / ' || {_ORIGIN('wp_lat', 'wp_lon', '0')}"
_ANGLE = "(CASE WHEN info THEN angle ELSE degrees(k % 2 * 0.25) END)"
_CURRENT = lambda stored, base, site: f"CASE WHEN lat IS NOT NULL THEN {stored} WHEN k % 3 <> 0 THEN {base} WHEN k % 9 <> 0 THEN {site} END"


@query(f"""SELECT id AS project_id, seq, label,
    CASE seq WHEN 0 THEN {_CRS('epsg')} WHEN 1 THEN {_ORIGIN('clat', 'clon', 'celev')} WHEN 2 THEN 'Not derived from what is stored' WHEN 3 THEN printf('%.3f', {_ANGLE}::DOUBLE) || '°'
      WHEN 4 THEN 'nothing pending' WHEN 5 THEN 'none captured' WHEN 6 THEN CASE WHEN valid THEN {_STORED_POINT} ELSE 'Not stored' END ELSE {_CONF} END AS current_value,
    CASE seq WHEN 0 THEN {_CRS('ie')} WHEN 1 THEN {_ORIGIN('il', 'lon', '0')}
      WHEN 2 THEN CASE WHEN k % 14 = 0 THEN 'E NaN m, N ' || printf('%.4f', (k % 500)::DOUBLE) || ' m' WHEN NOT ip THEN 'none captured' ELSE {_EN('k % 1000', 'k % 500')} END
      WHEN 3 THEN printf('%.3f', CASE WHEN k % 3 = 2 THEN coalesce(ia, {_ANGLE}) ELSE {_ANGLE} END::DOUBLE) || '°'
      WHEN 4 THEN ['Metadata Only', 'Project Location', 'Project Location + True North'][k % 3 + 1] WHEN 5 THEN ['Survey Point (default)', 'Survey Point', 'Project Base Point'][k % 3 + 1]
      WHEN 6 THEN CASE WHEN valid THEN {_STORED_POINT} WHEN {_OWN_POINT} THEN {_CRS('ie')} || ' / ' || {_EN('k % 1000', 'k % 500')} || ' / ' || {_ORIGIN('il', 'lon', '0')} ELSE 'Not stored' END ELSE {_CONF} END AS proposed_value
    FROM (SELECT *, {_CURRENT('lat', 'est_lat', '33.5')} AS clat, {_CURRENT('lon', 'est_lon', '135.25')} AS clon, {_CURRENT('elevation', 'bp_z * 0.3048', 'k % 8 * 0.3048')} AS celev FROM {_I}),
         (VALUES (0, 'CRS'), (1, 'origin'), (2, 'coordinate'), (3, 'true north'), (4, 'mode'), (5, 'anchor'), (6, 'working point'), (7, 'certainty')) f(seq, label)""")
def preview_all(spark, sf_dir):
    """All eight rows. The sites' decimals leave no ties, so engines that round ties apart agree."""
    return workflow.preview(_intents(spark, sf_dir))


@query(ORACLE_SQL["preview_all"])
def preview_fields(spark, sf_dir):
    """The same under its older name."""
    return preview_all(spark, sf_dir)


@query(f"""SELECT id AS project_id, changed, CASE WHEN NOT changed THEN mesh END AS mesh FROM (SELECT *, ie IS DISTINCT FROM epsg OR il IS DISTINCT FROM lat OR (CASE WHEN k % 2 = 0 THEN elevation ELSE 0 END) IS DISTINCT FROM elevation OR ia IS DISTINCT FROM angle AS changed FROM {_I.replace("k % 800 - 400", "k % 720 - 360")})""")
def canonical_apply(spark, sf_dir):
    rows = _intents(spark, sf_dir).withColumn("i_angle", F.when(F.col("project_id") % 4 == 0, None).otherwise((F.col("project_id") % 720 - 360).cast("double")))
    return workflow.apply_location(rows).select("project_id", "changed", "mesh")


@query("SELECT c_custkey, greatest(c_custkey % 4 - 2, 1)::INT AS version FROM customer")
def migrate_version(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", workflow.migrated((F.col("c_custkey") % 4 - 2).cast("int")).alias("version"))


@query("SELECT c_custkey, 1 AS version, 'customer' AS kind, c_name AS name, c_nationkey AS nation FROM customer")
def envelope_roundtrip(spark, sf_dir):
    json = workflow.envelope(F.struct(F.col("c_name").alias("Name"), F.col("c_nationkey").alias("Nation")), "customer")
    e = workflow.opened(F.col("json"), "Name string, Nation int")
    return _read(spark, sf_dir, "customer").withColumn("json", json).select("c_custkey", e["version"].alias("version"), e["kind"].alias("kind"), e["payload"]["Name"].alias("name"), e["payload"]["Nation"].alias("nation"))


@query("SELECT 'm' || (c_custkey % 50) AS module_id, max(c_custkey) AS state FROM customer WHERE c_custkey % 50 < 25 GROUP BY 1 UNION ALL SELECT 'm' || (c_custkey % 50), min(c_custkey) FROM customer WHERE c_custkey % 50 >= 25 GROUP BY 1")
def module_state_merge(spark, sf_dir):
    key = F.concat(F.lit("m"), (F.col("c_custkey") % 50).cast("string")).alias("module_id")
    rows = _read(spark, sf_dir, "customer")
    old = rows.groupBy(key).agg(F.min("c_custkey").alias("state"))
    return workflow.merged_states(old, rows.filter("c_custkey % 50 < 25").groupBy(key).agg(F.max("c_custkey").alias("state")))


@query("SELECT event_id, event_type AS type, value AS latitude, CASE WHEN user_id % 2 = 0 THEN value END AS longitude FROM events")
def bridge_message_parse(spark, sf_dir):
    json = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("value").alias("latitude"), F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("longitude")))
    return _read(spark, sf_dir, "events").select("event_id", text.bridge_message(json).alias("m")).select("event_id", "m.*")


# --- texts of files ---

_SRS = "list_filter(regexp_split_to_array(coalesce(url, ''), '[^0-9]+'), lambda x: length(x) BETWEEN 4 AND 5)"


@query(f"SELECT page_id, {_SRS}[-1]::INT AS epsg FROM pages")
def epsg_extract(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.epsg_of(F.col("url")).alias("epsg"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN lpad((page_id * 7919 % 100000000)::VARCHAR, 8, '0') END AS tile_id FROM pages")
def tile_id_extract(spark, sf_dir):
    digits = F.lpad((F.col("page_id") * 7919 % 100000000).cast("string"), 8, "0")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("C:\\data\\12345678\\plateau_"), digits, F.lit("_bldg.gml"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/x/x"), digits, F.lit("9.gml"))).otherwise("87654321/readme.12345678")
    return _read(spark, sf_dir, "pages").select("page_id", text.tile_id_of(name).alias("tile_id"))


@query("SELECT page_id, 'EPSG:' || page_id AS srs FROM pages")
def srs_normalize(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.trimmed(F.concat(F.lit(" \tEPSG:"), F.col("page_id").cast("string"), F.lit("\n "))).alias("srs"))


def _entries(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_brand").alias("source_path"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("p_type"))).alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("description"))


_FIRST = "(SELECT trim(p_type) AS code, trim(p_name) AS name, trim(p_brand) AS description FROM part WHERE p_size % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY trim(p_type) ORDER BY p_brand, p_partkey) = 1)"


@query(f"SELECT * FROM {_FIRST}")
def codelist_first(spark, sf_dir):
    return citygml.first_of_code(_entries(spark, sf_dir))


@query(f"SELECT p_partkey, f.name AS usage FROM part p LEFT JOIN {_FIRST} f ON f.code = trim(p.p_type)")
def codelist_lookup(spark, sf_dir):
    """The codelist may be large, so the plan picks the join by its size."""
    codes = citygml.first_of_code(_entries(spark, sf_dir)).withColumnRenamed("name", "usage")
    return _read(spark, sf_dir, "part").join(codes, F.trim("p_type") == F.col("code"), "left").select("p_partkey", "usage")


# --- buildings ---


def _rings(spark, sf_dir):
    """A building for each order: a closed or open square, with or without height, or a line."""
    k = F.col("o_orderkey")
    w, tall = (k % 40 + 1).cast("double"), (k % 7).cast("double")
    p = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    zero = F.lit(0.0)
    square = F.array(p(zero, zero, zero), p(w, zero, tall), p(w, w, zero), p(zero, w, tall))
    ring = F.when(k % 3 == 0, F.concat(square, F.array(p(zero, zero, zero)))).when(k % 3 == 1, square).otherwise(F.slice(square, 1, 2))
    return _read(spark, sf_dir, "orders").select(k.alias("building_id"), F.when(k % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("b"), k.cast("string"))).alias("name"), F.when(k % 4 == 0, 6677).when(k % 4 == 1, 6670).cast("int").alias("epsg_code"), ring.alias("ring"), (k % 2).alias("site"))


@query("SELECT o_orderkey AS building_id, CASE WHEN o_orderkey % 3 < 2 THEN 4 ELSE 2 END AS points FROM orders")
def ring_normalize(spark, sf_dir):
    return _rings(spark, sf_dir).select("building_id", F.size(importing.open_ring(F.col("ring"))).alias("points"))


def _solids(spark, sf_dir):
    anchors = spark.range(2).select(F.col("id").alias("site"), F.lit(6677).alias("epsg"), F.lit(10.0).alias("easting"), F.lit(20.0).alias("northing"), F.col("id").cast("double").alias("x"), F.lit(5.0).alias("y"), F.lit(7.0).alias("z"))
    return importing.plan_solids(_rings(spark, sf_dir).withColumn("building_id", F.col("building_id").cast("string")), F.broadcast(anchors), ["site"], strict=False)


@query("""SELECT o_orderkey::VARCHAR AS source_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey::VARCHAR ELSE 'b' || o_orderkey END AS name, 4 AS points,
    round(o_orderkey % 2 - 10 / 0.3048, 6) AS first_x, round(5 - 20 / 0.3048, 6) AS first_y, 7.0::DOUBLE AS base_feet, round(CASE WHEN o_orderkey % 7 <= 3 THEN 10 ELSE o_orderkey % 7 END / 0.3048, 6) AS height_feet
    FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 4 <> 1""")
def context_solids(spark, sf_dir):
    first = F.col("footprint")[0]
    return _solids(spark, sf_dir).select("source_id", "name", F.size("footprint").alias("points"), F.round(first["x_feet"], 6).alias("first_x"), F.round(first["y_feet"], 6).alias("first_y"), "base_feet", F.round("height_feet", 6).alias("height_feet"))


@query("SELECT o_orderkey::VARCHAR AS source_id, pos, round((o_orderkey % 40 + 1) / 0.3048, 6) AS length FROM orders, (SELECT unnest(range(4))::INT AS pos) WHERE o_orderkey % 3 < 2 AND o_orderkey % 4 <> 1")
def footprint_edges(spark, sf_dir):
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return importing.footprint_edges(_solids(spark, sf_dir), "source_id").select("source_id", "pos", F.round(length, 6).alias("length"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a,b' WHEN c_custkey % 3 = 1 THEN 'a,b,c' ELSE 'a,b' END AS tiles FROM customer")
def import_state_merge(spark, sf_dir):
    new = F.element_at(F.array(F.lit("b"), F.lit("c"), F.lit(" ")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return _read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(",", importing.merged_tiles(F.array(F.lit("a"), F.lit("b")), new)).alias("tiles"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders), t AS (SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1)
    SELECT o_custkey, pos::INT AS pos, 'b' || o_orderkey AS name FROM n WHERE pos <= 24 UNION ALL SELECT o_custkey, 25, '... and ' || (total - 24) || ' more' FROM t WHERE total > 24""")
def feature_name_preview(spark, sf_dir):
    return importing.preview_names(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.concat(F.lit("b"), F.col("o_orderkey").cast("string")))


from gridloom.plans import report_queries, store_queries  # noqa: E402, F401  they register their queries too
