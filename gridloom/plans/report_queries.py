"""Queries of reports, previews' notes, applied placements, import states and XML readers, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import projection
from gridloom.operators import importing, reports, rules, workflow
from gridloom.plans import catalogue as c
from gridloom.plans import oracle as o
from gridloom.plans.catalogue import query
from gridloom.sources import citygml, crs
from gridloom.sources.sites import projects, sites


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _choice(names: tuple[str, ...], i: str) -> str:
    return "[" + ", ".join(map(_text, names)) + f"][{i} + 1]"


_CONFIDENCE = _choice(rules.CONFIDENCE, "confidence")
_CRS_TEXT = "'EPSG:' || epsg || '  ' || crs_name"
_ORIGIN_TEXT = "printf('%.6f, %.6f, elev %.3f m', lat, lon, elevation)"
_BLANK = "source = ''"


def _unpivoted(fields: list[tuple[str, str]], rows: str) -> str:
    """project_id, seq, label, value of fields that aren't null."""
    value = " ".join(f"WHEN {i} THEN ({v})::VARCHAR" for i, (_, v) in enumerate(fields))
    names = ", ".join(f"({i}, {_text(n)})" for i, (n, _) in enumerate(fields))
    return f"SELECT * FROM (SELECT id AS project_id, seq, label, CASE seq {value} END AS value FROM {rows}, (VALUES {names}) f(seq, label)) WHERE value IS NOT NULL"


# --- health and readiness in words ---


@query(f"""{o.WITH_FINDINGS} SELECT id AS project_id, CASE WHEN NOT supported THEN {_text(rules.STATUS_MESSAGES[0])} WHEN worst = 2 THEN {_text(rules.STATUS_MESSAGES[1])} WHEN worst = 1 THEN {_text(rules.STATUS_MESSAGES[2])}
    WHEN list_has_any(codes, ['missing-primary-mesh', 'read-only-document']) THEN {_text(rules.STATUS_MESSAGES[4])} ELSE {_text(rules.STATUS_MESSAGES[3])} END AS status_message FROM j""")
def health_message(spark, sf_dir):
    return rules.status(c._healthy(spark, sf_dir)).select("project_id", "status_message")


_NOT, _ARE = [_text(x[1]) for x in rules.CHECKLIST], [_text(x[2]) for x in rules.CHECKLIST]


@query(f"""{o.WITH_FINDINGS} SELECT id AS project_id, seq, {_choice(tuple(x[0] for x in rules.CHECKLIST), "seq")} AS title, CASE seq WHEN 0 THEN CASE WHEN supported THEN {_ARE[0]} ELSE {_NOT[0]} END
    WHEN 1 THEN CASE WHEN epsg IS NULL THEN {_NOT[1]} ELSE 'EPSG:' || epsg END WHEN 2 THEN CASE WHEN lat IS NULL THEN {_NOT[2]} ELSE printf('%.6f, %.6f', lat, lon) END
    WHEN 3 THEN CASE WHEN info AND confidence <> 0 THEN {_CONFIDENCE} ELSE {_NOT[3]} END
    ELSE CASE WHEN NOT info OR mesh IS NULL THEN {_NOT[4]} WHEN list_contains(codes, 'stale-mesh') THEN {_text(rules.STALE)} ELSE mesh END END AS detail
    FROM j, (SELECT unnest(range(5))::INT AS seq)""")
def readiness_details(spark, sf_dir):
    return rules.readiness(c._healthy(spark, sf_dir)).select("project_id", F.inline("items")).select("project_id", "seq", "title", "detail")


_YES = lambda x: f"CASE WHEN {x} THEN 'yes' ELSE 'no' END"


@query(_unpivoted([
    ("document", "id"), ("supported", _YES("supported")), ("read-only", _YES("read_only")), ("metadata", _YES("info")), ("CRS", f"CASE WHEN epsg IS NULL THEN 'none' ELSE {_CRS_TEXT} END"),
    ("origin", f"CASE WHEN lat IS NULL THEN 'none' ELSE {_ORIGIN_TEXT} END"), ("confidence", f"CASE WHEN info THEN {_CONFIDENCE} ELSE 'none' END"), ("mesh", "CASE WHEN info THEN coalesce(mesh, 'none') ELSE 'none' END"),
    ("source", f"CASE WHEN info AND NOT ({_BLANK}) THEN source ELSE 'not recorded' END")], f"({o.PROJECTS})"))
def health_rows(spark, sf_dir):
    return reports.health_rows(projects(spark, sf_dir))


_LENGTH = lambda x: f"printf('%.3f ft / %.3f m', ({x})::DOUBLE, ({x}) * 0.3048::DOUBLE)"
_XYZ = lambda x, y, z: f"printf('X %.3f ft, Y %.3f ft, Z %.3f ft', ({x})::DOUBLE, ({y})::DOUBLE, ({z})::DOUBLE)"


@query(_unpivoted([
    ("document", "id"), ("metadata", _YES("info")), ("read-only", _YES("read_only")), ("site", "CASE WHEN k % 9 <> 0 THEN '33.500000, 135.250000' END"),
    ("time zone", "CASE WHEN k % 4 <> 0 THEN 'UTC' || CASE WHEN k % 105 > 48 THEN '+' WHEN k % 105 < 48 THEN '-' ELSE '' END || (abs(k % 105 - 48) // 4) || ['', '.25', '.5', '.75'][abs(k % 105 - 48) % 4 + 1] END"),
    ("position", f"'EW ' || {_LENGTH('k % 3 * 0.00009')} || ', NS ' || {_LENGTH('k % 4')}"), ("elevation", _LENGTH("k % 8")), ("true north", "CASE WHEN k % 2 = 1 THEN '14.324°' ELSE '0.000°' END"),
    ("survey point", _XYZ("sp_x", "k % 40", "sp_z")), ("base point", _XYZ("bp_x", "k % 50", "bp_z")), ("CRS", _CRS_TEXT), ("origin", f"CASE WHEN lat IS NOT NULL THEN {_ORIGIN_TEXT} END"),
    ("working point", f"CASE WHEN {c._VALID} THEN {c._STORED_POINT} END"), ("confidence", f"CASE WHEN info THEN {_CONFIDENCE} END"), ("source", f"CASE WHEN info AND NOT ({_BLANK}) THEN source END")], f"({o.PROJECTS})"))
def state_rows(spark, sf_dir):
    return reports.state_rows(projects(spark, sf_dir))


@query(_unpivoted([
    ("place", "printf('%.6f, %.6f', il, lon)"), ("easting", "CASE WHEN k % 14 = 0 THEN 'NaN m' WHEN ip THEN printf('%.4f m', (k % 1000)::DOUBLE) END"), ("northing", "printf('%.4f m', (k % 500)::DOUBLE)"),
    ("anchor", "CASE k % 3 WHEN 1 THEN 'Survey Point' WHEN 2 THEN 'Project Base Point' END"), ("source", "CASE WHEN source = '' THEN '  ' ELSE source END"), ("confidence", _CONFIDENCE), ("CRS", "'EPSG:' || ie || '  ' || crs_name")],
    f"(SELECT * FROM {c._I} WHERE il IS NOT NULL)"))
def point_rows(spark, sf_dir):
    return reports.point_rows(c._intents(spark, sf_dir).withColumn("i_easting", F.when(F.isnan("i_easting"), F.lit(float("nan"))).otherwise(F.col("i_easting"))))


_AROUND = "(SELECT site_id, string_agg(neighbor, ' ' ORDER BY pos) AS around FROM (SELECT site_id, pos, " + c._NEAR + f" AS neighbor FROM {c._INDEX.replace(c._CODES, f'(SELECT id AS site_id, own AS code FROM ({o.PROJECTS}) WHERE {c._OK})')}, {c._AROUND}) GROUP BY 1)"


@query(_unpivoted([
    ("reference", "CASE WHEN ok THEN 'survey' END"), ("place", "CASE WHEN ok THEN printf('%.6f, %.6f', lat, lon) END"), ("CRS", f"CASE WHEN ok THEN {_CRS_TEXT} END"), ("origin", f"CASE WHEN ok THEN {_ORIGIN_TEXT} END"),
    ("stored mesh", "CASE WHEN ok THEN coalesce(mesh, 'none') END"), ("mesh", "CASE WHEN ok THEN own END"),
    ("status", f"{c._BLOCK} WHEN mesh IS NULL THEN 'Not stored yet' WHEN mesh = own THEN 'Stored value is current' ELSE 'Stored value is stale' END"), ("neighbours", "CASE WHEN ok THEN around END"),
    ("confidence", f"CASE WHEN ok THEN {_CONFIDENCE} END"), ("source", f"CASE WHEN ok THEN CASE WHEN {_BLANK} THEN 'not recorded' ELSE source END END"),
    ("can save", "CASE WHEN ok AND NOT read_only AND (mesh IS NULL OR mesh <> own) THEN 'yes' END")],
    f"(SELECT p.*, around, {c._OK} AS ok FROM ({o.PROJECTS}) p LEFT JOIN {_AROUND} ON site_id = id)"))
def mesh_rows(spark, sf_dir):
    return reports.mesh_rows(projects(spark, sf_dir))


@query(f"""SELECT *, CASE WHEN outcome = 'saved' THEN own ELSE mesh0 END AS mesh FROM (SELECT id AS project_id, CASE WHEN NOT supported THEN 'unsupported' WHEN read_only THEN 'read-only' WHEN NOT info THEN 'no metadata'
    WHEN epsg IS NULL OR lat IS NULL THEN 'incomplete metadata' ELSE 'saved' END AS outcome, own, mesh AS mesh0 FROM ({o.PROJECTS}))""".replace("SELECT *, CASE", "SELECT project_id, outcome, CASE"))
def mesh_save(spark, sf_dir):
    return workflow.save_mesh_code(projects(spark, sf_dir))


# --- intents: gates, notes, applying ---

_READY = "(NOT (" + " OR ".join(f"coalesce({t}, false)" for t in c._ERRORS) + "))"


@query(f"""SELECT id AS project_id, step, CASE step WHEN 0 THEN supported WHEN 1 THEN ie IS NOT NULL WHEN 4 THEN {_READY} WHEN 5 THEN false ELSE il IS NOT NULL END AS can_next,
    step = 5 AND {_READY} AND supported AND NOT read_only AS can_apply FROM {c._I}, (SELECT unnest(range(6))::INT AS step)""")
def step_gates(spark, sf_dir):
    rows = workflow.preview_ready(c._intents(spark, sf_dir)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(5))))
    g = rules.gates(F.col("step"), F.col("supported"), F.col("read_only"), F.col("i_epsg"), F.col("i_lat"), F.col("ready"))
    return rows.select("project_id", "step", g.alias("g")).select("project_id", "step", "g.*")


_CANDIDATE = [("missing-crs", "ie IS NULL"), ("invalid-crs", "ie = 999999"), ("missing-origin", "il IS NULL"), ("outside-japan-range", "il NOT BETWEEN 20 AND 46 OR (il IS NOT NULL AND lon NOT BETWEEN 122 AND 154)"),
              ("large-offset", "ie IS NOT NULL AND il IS NOT NULL AND sqrt(easting ** 2 + northing ** 2) > 100000")]
_WARNINGS = [(f"coalesce({t}, false)", _text(e)) for t, e in zip(c._ERRORS, rules.INTENT_ERRORS, strict=True)]
_WARNINGS += [("NOT info", _text(workflow.STATE_NOTES[0])), ("k % 3 = 2 OR k % 4 > 0 OR k % 2 = 1 OR info", _text(workflow.STATE_NOTES[1]))]
_WARNINGS += [("lat IS NOT NULL OR k % 3 <> 0 OR k % 9 <> 0", f"{_text(workflow.STATE_NOTES[2])} || {c._CURRENT(_text('stored'), _text('base point'), _text('site'))}")]
_WARNINGS += [(f"coalesce({t}, false)", _text(rules.MESSAGES[n])) for n, t in _CANDIDATE]
_WP = f"(valid OR {c._OWN_POINT})"
_LOCATED = f"(SELECT i.*, easting, northing FROM {c._I} i JOIN (SELECT id AS lid, easting, northing FROM ({o.LOCATED})) ON lid = id)"
_MODES = lambda lists: _choice(tuple(", ".join(x) for x in lists), "k % 3")
_SAVED = f"CASE WHEN {_WP} THEN '; working point saved' ELSE '' END"
_ANCHOR = "CASE WHEN k % 3 = 2 THEN 'Project Base Point' ELSE 'Survey Point' END"


@query("SELECT id AS project_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN {e} END" for t, e in _WARNINGS) + f"""], lambda x: x IS NOT NULL), '; ') AS warnings,
    {_MODES(workflow.CHANGES)} || CASE WHEN {_WP} THEN ', working point' ELSE '' END AS will_change, {_MODES(workflow.STAYS)} || CASE WHEN {_WP} THEN '' ELSE ', working point' END AS will_stay,
    'EPSG:' || coalesce(ie::VARCHAR, 'unknown') || ', origin, angle, confidence ' || {_CONFIDENCE} || {_SAVED} AS persistence,
    CASE WHEN k % 3 = 0 THEN 'metadata alone' ELSE 'location at the ' || {_ANCHOR} || CASE WHEN k % 3 = 2 THEN ' and true north' ELSE '' END END || {_SAVED} AS impact,
    {c._CONF} AS certainty, {_READY} AS ready FROM {_LOCATED}""")
def preview_notes(spark, sf_dir):
    rows = workflow.preview_notes(c._intents(spark, sf_dir))
    return rows.select("project_id", F.array_join("warnings", "; ").alias("warnings"), F.array_join("will_change", ", ").alias("will_change"), F.array_join("will_stay", ", ").alias("will_stay"), "persistence", "impact", "certainty", "ready")


@query(f"""SELECT site_id, epsg AS i_epsg, {o.NAME} AS i_name, round(lat, 9) AS i_lat, round(easting, 3) AS i_easting, 0.0::DOUBLE AS i_elevation, (site_id % 3)::INT AS i_mode, 2 - (site_id % 2)::INT AS i_confidence
    FROM ({o.forward(o.SITES.replace("/ 10000.0 AS", "/ 10000.0::DOUBLE AS"))}) JOIN {o.ZONES} ON code = epsg""".replace("arc, ", "arc, "))
def intent_build(spark, sf_dir):
    rows = projection.project(crs.with_crs(sites(spark, sf_dir).withColumn("key", F.col("site_id")), crs.crs_table(spark).select("*")))
    names = crs.crs_table(spark).select(F.col("epsg_code").alias("epsg"), F.col("name").alias("crs_title"))
    rows = rows.join(F.broadcast(names), "epsg")  # 19 rows
    point = F.struct("lat", "lon", "easting", "northing", (2 - F.col("site_id") % 2).cast("int").alias("confidence"), F.lit(1).alias("anchor"))
    intent = workflow.build_intent(F.col("epsg"), F.col("crs_title"), point, (F.col("site_id") % 3).cast("int"), F.lit("map"), F.lit(None).cast("double"))
    return rows.select("site_id", *(x.alias(n) for n, x in intent.items())).select("site_id", "i_epsg", "i_name", F.round("i_lat", 9).alias("i_lat"), F.round("i_easting", 3).alias("i_easting"), "i_elevation", "i_mode", "i_confidence")


_APPLIED = f"CASE WHEN NOT supported THEN 'unsupported' WHEN read_only THEN 'read-only' WHEN NOT {_READY} THEN 'invalid intent' ELSE 'applied' END"
_NEW_ANGLE = f"CASE WHEN k % 3 = 2 THEN coalesce(ia, {c._ANGLE}) ELSE {c._ANGLE} END::DOUBLE"


@query(f"""SELECT id AS project_id, outcome, CASE WHEN outcome = 'applied' THEN 1 END AS version, CASE WHEN outcome = 'applied' THEN ie END AS epsg, CASE WHEN outcome = 'applied' THEN round({_NEW_ANGLE}, 9) END AS angle,
    CASE WHEN outcome = 'applied' THEN 0 END::DOUBLE AS elevation, NULL::VARCHAR AS mesh, outcome = 'applied' AND {_WP} AS has_state,
    CASE WHEN outcome = 'applied' THEN id || ': ' || ['Metadata Only', 'Project Location', 'Project Location + True North'][k % 3 + 1] || '; EPSG:' || ie || '; ' || printf('Lat %.6f, Lon %.6f', il, lon) || '; ' ||
      printf('E %.3f m, N %.3f m', (k % 1000)::DOUBLE, (k % 500)::DOUBLE) || '; ' || {_ANCHOR} || '; ' || printf('%.3f', {_NEW_ANGLE}) || '°; ' || {c._CONF} ||
      CASE WHEN valid THEN printf('; working point E %.3f m, N %.3f m in EPSG:', wp_e, wp_n) || wp_epsg WHEN {_WP} THEN printf('; working point E %.3f m, N %.3f m in EPSG:', (k % 1000)::DOUBLE, (k % 500)::DOUBLE) || ie ELSE '' END END AS summary
    FROM (SELECT *, {_APPLIED} AS outcome FROM {c._I})""")
def placements_applied(spark, sf_dir):
    rows = workflow.apply_placements(c._intents(spark, sf_dir), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    r = workflow.read_record(F.col("record"))
    rows = rows.withColumn("r", F.when(F.col("record").isNotNull(), r))
    return rows.select(
        "project_id", "outcome", F.col("r.SchemaVersion").alias("version"), F.col("r.ProjectCrs.EpsgCode").alias("epsg"), F.round("r.TrueNorthAngle", 9).alias("angle"), F.col("r.Origin.ElevationMeters").alias("elevation"),
        F.col("r.PrimaryMeshCode.Value").alias("mesh"), F.col("state").isNotNull().alias("has_state"), F.get_json_object("audit", "$.Summary").alias("summary"),
    )


# --- files and imports ---


def _files(spark, sf_dir):
    """A CityGML file for each customer, made from its key: three buildings, of which one is too short and one may lack its polygon."""
    k = F.col("c_custkey")
    ring = lambda n, dim: F.concat_ws(" ", *(F.concat_ws(" ", *(((k * 7 + 13 * i * (d + 1)) % 500).cast("string") for d in range(dim))) for i in range(n)))
    polygon = lambda pos, attribute: F.concat(F.lit(f"<g:Polygon><g:exterior><g:LinearRing><g:posList{attribute}>"), pos, F.lit("</g:posList></g:LinearRing></g:exterior></g:Polygon>"))
    srs = F.when(k % 3 == 0, F.lit("EPSG:6677")).when(k % 3 == 1, F.lit("http://www.opengis.net/def/crs/EPSG/0/6669"))
    root = F.concat(F.lit('<m:CityModel xmlns:m="http://www.opengis.net/citygml/2.0" xmlns:g="http://www.opengis.net/gml" xmlns:b="http://www.opengis.net/citygml/building/2.0"'), F.coalesce(F.concat(F.lit(' srsName="'), srs, F.lit('"')), F.lit("")), F.lit(">"))
    envelope = F.when(k % 2 == 0, '<g:boundedBy><g:Envelope srsName="urn:ogc:def:crs:EPSG::6674"/></g:boundedBy>').otherwise("")
    first = F.concat(F.lit('<m:cityObjectMember><b:Building g:id="a'), k.cast("string"), F.lit('"><g:name> first </g:name><b:lod0FootPrint>'), polygon(ring(5, 3), ""), polygon(ring(4, 3), ""), F.lit("</b:lod0FootPrint></b:Building></m:cityObjectMember>"))
    second = F.concat(F.lit('<m:cityObjectMember><b:Building g:id="b'), k.cast("string"), F.lit('">'), F.when(k % 4 == 0, F.lit("")).otherwise(polygon(ring(4, 2), ' srsDimension="2"')), F.lit("</b:Building></m:cityObjectMember>"))
    short = F.concat(F.lit('<m:cityObjectMember><b:Building g:id="c">'), polygon(ring(3, 3), ""), F.lit("</b:Building></m:cityObjectMember>"))
    path = F.concat(F.lit("/data/plateau_"), F.lpad((k % 100000000).cast("string"), 8, "0"), F.lit("_bldg.gml"))
    content = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), root, envelope, first, second, short, F.lit("</m:CityModel>"))
    return _spread(c._read(spark, sf_dir, "customer").select(path.alias("path"), F.encode(content, "UTF-8").alias("content")))


def _spread(files):
    """Small files cost more to parse than to move: they are dealt to all cores."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism)


_BUILDINGS = """(SELECT '/data/plateau_' || lpad(c_custkey::VARCHAR, 8, '0') || '_bldg.gml' AS source_path, CASE WHEN c_custkey % 3 = 0 THEN 'EPSG:6677' WHEN c_custkey % 3 = 1 THEN 'http://www.opengis.net/def/crs/EPSG/0/6669'
    WHEN c_custkey % 2 = 0 THEN 'urn:ogc:def:crs:EPSG::6674' ELSE '' END AS srs_name, CASE WHEN c_custkey % 3 = 0 THEN 6677 WHEN c_custkey % 3 = 1 THEN 6669 WHEN c_custkey % 2 = 0 THEN 6674 END AS epsg_code,
    lpad(c_custkey::VARCHAR, 8, '0') AS file_tile_id, c_custkey AS k, b FROM customer, (VALUES ('a'), ('b')) v(b) WHERE b = 'a' OR c_custkey % 4 <> 0)"""


@query(f"""SELECT source_path, srs_name, epsg_code, file_tile_id, b || k AS building_id, CASE b WHEN 'a' THEN ' first ' ELSE 'Building' END AS name, CASE b WHEN 'a' THEN 5 ELSE 4 END AS points,
    (k * 7 + 13) % 500::DOUBLE AS second_x, (k * 7 + 26) % 500::DOUBLE AS second_y, CASE b WHEN 'a' THEN (k * 7 + 39) % 500 ELSE 0 END::DOUBLE AS second_z FROM {_BUILDINGS}""")
def citygml_buildings(spark, sf_dir):
    rows = citygml.buildings_of(_files(spark, sf_dir))
    at = F.col("ring")[1]
    return rows.select("source_path", "srs_name", "epsg_code", "file_tile_id", "building_id", "name", F.size("ring").alias("points"), at["x"].alias("second_x"), at["y"].alias("second_y"), at["z"].alias("second_z"))


@query("""SELECT * FROM (SELECT CASE WHEN p_size % 4 = 0 THEN p_brand ELSE 'k' || (p_partkey % 37) END AS code, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS description FROM part WHERE p_size % 9 <> 0
    QUALIFY row_number() OVER (PARTITION BY code ORDER BY lpad(p_partkey::VARCHAR, 12, '0')) = 1)""")
def citygml_codelist(spark, sf_dir):
    """A codelist file for each part: its code as an attribute, as an identifier, or empty."""
    k = F.col("p_partkey")
    open_ = F.when(F.col("p_size") % 9 == 0, F.lit('<g:Definition g:id="" code="x">')).when(F.col("p_size") % 4 == 0, F.concat(F.lit('<entry code="'), F.col("p_brand"), F.lit('">'))).otherwise(F.concat(F.lit("<CodeEntry><g:identifier>k"), (k % 37).cast("string"), F.lit("</g:identifier>")))
    close = F.when(F.col("p_size") % 9 == 0, "</g:Definition>").when(F.col("p_size") % 4 == 0, "</entry>").otherwise("</CodeEntry>")
    body = F.concat(F.lit("<g:name> "), F.col("p_name"), F.lit("</g:name>"), F.when(k % 2 == 0, F.concat(F.lit("<g:description>"), F.col("p_type"), F.lit("</g:description>"))).otherwise(""))
    content = F.concat(F.lit('<g:Dictionary xmlns:g="http://www.opengis.net/gml">'), open_, body, close, F.lit("</g:Dictionary>"))
    return citygml.codelist_of(_spread(c._read(spark, sf_dir, "part").select(F.lpad(k.cast("string"), 12, "0").alias("path"), F.encode(content, "UTF-8").alias("content"))))


_REFERENCE = f"""(SELECT id, CASE WHEN title = 'working' THEN wp_epsg ELSE epsg END AS epsg, crs_name, title FROM (SELECT *, CASE WHEN k % 2 = 0 AND {c._VALID} THEN 'working' WHEN k % 2 = 0 AND est_lat IS NOT NULL THEN 'base' ELSE 'canonical' END AS title
    FROM ({o.PROJECTS}) WHERE epsg IS NOT NULL AND lat IS NOT NULL))"""


@query(f"""SELECT source_path, seq, label, CASE seq WHEN 0 THEN source_path WHEN 1 THEN CASE WHEN srs_name = '' THEN 'none' ELSE srs_name END WHEN 2 THEN coalesce(epsg_code::VARCHAR, 'none') WHEN 3 THEN file_tile_id WHEN 4 THEN n::VARCHAR
    WHEN 5 THEN n::VARCHAR WHEN 6 THEN title ELSE 'EPSG:' || epsg || '  ' || crs_name END AS value FROM (SELECT source_path, srs_name, epsg_code, file_tile_id, k, count(*) AS n FROM {_BUILDINGS} GROUP BY ALL) JOIN {_REFERENCE} ON id = k,
    (VALUES (0, 'file'), (1, 'declared system'), (2, 'EPSG code'), (3, 'tile'), (4, 'buildings'), (5, 'solids'), (6, 'anchor'), (7, 'anchor''s system')) f(seq, label)""")
def import_preview_rows(spark, sf_dir):
    """What each customer's file would bring into that customer's project, at the project's own anchor; projects without one can't import."""
    rows = citygml.buildings_of(_files(spark, sf_dir)).groupBy("source_path", "srs_name", "epsg_code", "file_tile_id")
    solid = F.size(importing.open_ring(F.col("ring"))) >= 3
    files = rows.agg(F.count(F.lit(1)).alias("buildings"), F.count_if(solid).alias("solids")).withColumn("project_id", F.col("file_tile_id").cast("long"))
    anchors = workflow.import_reference(projects(spark, sf_dir), F.col("project_id") % 2 == 0).select("project_id", "title", "epsg", "crs_name")
    return importing.file_rows(files.join(anchors, "project_id"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'a,b,c' ELSE 'a,b' END AS tiles, 'f' || c_custkey || '.gml' AS file, (c_custkey % 9)::INT AS last_count,
    (c_custkey % 9) || ' elements from f' || c_custkey || '.gml at CanonicalOrigin; ' || CASE WHEN c_custkey % 4 = 0 THEN 'no tile id' WHEN c_custkey % 3 = 1 THEN 'tiles a, b, c' ELSE 'tiles a, b' END AS summary FROM customer""")
def import_state(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    old = F.struct(F.when(k % 4 == 0, none).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("tiles"))
    new = F.when(k % 4 == 0, F.lit(" ")).otherwise(F.element_at(F.array(F.lit("b"), F.lit("c"), F.lit(" ")), (k % 3 + 1).cast("int")))
    state = importing.merged_import_state(old, new, F.lit("2024-01-02").cast("timestamp"), F.concat(F.lit("C:\\x\\f"), k.cast("string"), F.lit(".gml")), F.lit("CanonicalOrigin"), (k % 9).cast("int"))
    rows = c._read(spark, sf_dir, "customer").select("c_custkey", state.alias("state"))
    return rows.select("c_custkey", F.array_join("state.tiles", ",").alias("tiles"), F.regexp_replace("state.last_path", r"^.*[/\\\\]", "").alias("file"), "state.last_count", importing.import_summary(F.col("state")).alias("summary"))
