"""Queries of stores, commits, sinks, solids' faces, import histories, held messages and migrations, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import mesh
from gridloom.operators import extrusion, importing, migrations, snapshots, workflow
from gridloom.operators.store import KeyedStore
from gridloom.plans import catalogue as c
from gridloom.plans import report_queries as r
from gridloom.plans.catalogue import query
from gridloom.sources import citygml, framed
from gridloom.sources.scratch import scratch
from gridloom.streaming import messages

# --- files read by ranges, and written by tasks ---


@query(f"SELECT lpad((k % 25)::VARCHAR, 8, '0') AS file_tile_id, b || k AS building_id, CASE b WHEN 'a' THEN ' first ' ELSE 'Building' END AS name, CASE b WHEN 'a' THEN 5 ELSE 4 END AS points, (k * 7 + 13) % 500::DOUBLE AS second_x FROM {r._BUILDINGS} WHERE k % 25 IN (3, 4, 17)")
def citygml_ranges(spark, sf_dir):
    """One CityGML file for each of 25 tiles, with the members of all customers that fall to it; three tiles' files are read, by ranges of 64 KB."""
    root = '<m:CityModel xmlns:m="http://www.opengis.net/citygml/2.0" xmlns:g="http://www.opengis.net/gml" xmlns:b="http://www.opengis.net/citygml/building/2.0" srsName="EPSG:6677">'
    files = r._files(spark, sf_dir).select(F.regexp_extract("path", "([0-9]{8})", 1).cast("long").alias("k"), F.decode("content", "UTF-8").alias("xml"))
    members = F.regexp_extract("xml", "(?s)(<m:cityObjectMember>.*)</m:CityModel>", 1)
    rows = files.select(F.concat(F.lit("plateau_"), F.lpad((F.col("k") % 25).cast("string"), 8, "0"), F.lit("_bldg")).alias("file"), members.alias("text"), "k")
    path = scratch(spark, "citygml")
    framed.write_framed(rows.repartition("file").sortWithinPartitions("file", "k").select("file", "text"), path, head=f'<?xml version="1.0" encoding="UTF-8"?>{root}', foot="</m:CityModel>", extension="gml")
    got = citygml.buildings(spark, path, split_bytes=64 << 10, tiles=["00000003", "00000004", "00000017"])
    return got.select("file_tile_id", "building_id", "name", F.size("ring").alias("points"), F.col("ring")[1]["x"].alias("second_x"))


@query(f"""WITH cells AS (SELECT code AS cell, -1 AS pos, la, lo FROM {c._INDEX} UNION ALL SELECT {c._NEAR}, pos, la + up, lo + rt FROM {c._INDEX}, {c._AROUND})
    SELECT cell AS mesh_code, pos < 0 AS is_primary, round(la / 120.0, 8) AS south, round(100 + (lo + 1) / 80.0, 8) AS east, count(*) AS n FROM cells GROUP BY ALL""")
def geojson_files(spark, sf_dir):
    """The features of all sites' overlays, written as FeatureCollection files of a megabyte and read back."""
    cells = mesh.overlay_features(c.QUERIES["mesh_encode_l3"](spark, sf_dir), ["site_id"], "code")
    path = scratch(spark, "geojson")
    framed.write_features(cells.select(F.explode("features").alias("text")), path, max_bytes=1 << 20)
    rows = framed.read_features(spark, path, "properties struct<meshCode: string, isPrimary: boolean>, geometry struct<coordinates: array<array<array<double>>>>")
    ring = F.col("geometry.coordinates")[0]
    return rows.groupBy(F.col("properties.meshCode").alias("mesh_code"), F.col("properties.isPrimary").alias("is_primary"), F.round(ring[0][1], 8).alias("south"), F.round(ring[1][0], 8).alias("east")).agg(F.count(F.lit(1)).alias("n"))


# --- stores and commits ---


_UPSERTS = "SELECT o_custkey, o_orderkey, o_orderkey % 10 AS commit, o_orderkey % 7 = 0 AS deleted FROM orders"


@query(f"SELECT o_custkey::VARCHAR AS key, commit::BIGINT + 1 AS commit, o_orderkey::VARCHAR AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY commit DESC, o_orderkey DESC) AS n FROM ({_UPSERTS})) WHERE n = 1 AND NOT deleted")
def keyed_upserts(spark, sf_dir):
    """Orders as upserts of their customers' last order, in ten commits, merged after the fifth; one order in seven deletes."""
    store = KeyedStore(spark, scratch(spark, "upserts"), buckets=8)
    orders = c._read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("value"), (F.col("o_orderkey") % 7 == 0).alias("deleted"))
    commit_of = {}
    for k in range(10):
        commit_of[store.commit(f"part {k}", {"last_order": orders.filter(F.col("seq") % 10 == k)})] = k
        if k == 4:
            store.compact()
    commit = F.element_at(F.create_map(*(F.lit(x) for v, k in commit_of.items() for x in (v, k + 1))), F.col("version").cast("int"))
    return store.read("last_order").select("key", commit.cast("long").alias("commit"), "value")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS stored FROM customer")
def store_exists(spark, sf_dir):
    store = KeyedStore(spark, scratch(spark, "exists"), buckets=8)
    store.commit("orders", {"t": c._read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit("x").alias("value"))})
    return store.exists("t", c._read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("key"))).drop("key")


_DONE = f"(SELECT * FROM (SELECT *, {r._APPLIED} AS outcome FROM {c._I}) WHERE outcome = 'applied')"


@query(f"SELECT id AS project_id, ie AS epsg, round({r._NEW_ANGLE}, 9) AS angle, {r._WP} AS has_state, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS audit_lines, id || ': ' AS audit_begins FROM {_DONE}")
def placements_stored(spark, sf_dir):
    """Placements published in two commits, the second one twice under one id, and a third of them again; read back from records, states and audit."""
    store = workflow.project_store(spark, scratch(spark, "placements"))
    placed = workflow.apply_placements(c._intents(spark, sf_dir), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    for name, part in (("even", "project_id % 2 = 0"), ("odd", "project_id % 2 <> 0"), ("odd", "project_id % 2 <> 0"), ("third", "project_id % 3 = 0")):
        workflow.commit_placements(placed.filter(part), store, name)
    records = workflow.load_records(store)
    states = workflow.load_states(store, records.select("project_id", F.lit(workflow.GEOREFERENCE).alias("module_id")))
    lines = workflow.audit_lines(store).groupBy(F.col("project_id").cast("long").alias("project_id")).agg(F.count(F.lit(1)).alias("audit_lines"))
    last = workflow.latest_audit(store).select(F.col("project_id").cast("long").alias("project_id"), F.regexp_extract(F.get_json_object("audit", "$.Summary"), "^[0-9]+: ", 0).alias("audit_begins"))
    rows = records.join(states, "project_id").join(lines, "project_id").join(last, "project_id")
    return rows.select("project_id", F.col("record.ProjectCrs.EpsgCode").alias("epsg"), F.round("record.TrueNorthAngle", 9).alias("angle"), F.col("envelope").isNotNull().alias("has_state"), "audit_lines", "audit_begins")


# --- imports ---

_IMPORTS = """(SELECT o_orderkey AS seq, (o_custkey % 40)::BIGINT AS project_id, o_orderdate::TIMESTAMP AS "at", CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE lpad((o_orderkey * 7919 % 61)::VARCHAR, 8, '0') END AS tile,
    'C:\\x\\f' || o_orderkey || '.gml' AS path, (o_orderkey % 9)::INT AS count FROM orders)"""


def _imports(spark, sf_dir):
    k = F.col("o_orderkey")
    tile = F.when(k % 5 == 0, F.lit(" ")).otherwise(F.lpad((k * 7919 % 61).cast("string"), 8, "0"))
    path = F.concat(F.lit("C:\\x\\f"), k.cast("string"), F.lit(".gml"))
    return c._read(spark, sf_dir, "orders").select(
        k.alias("seq"), (F.col("o_custkey") % 40).cast("long").alias("project_id"), F.col("o_orderdate").cast("timestamp").alias("at"), tile.alias("tile"), path.alias("path"), F.lit("CanonicalOrigin").alias("source"), (k % 9).cast("int").alias("count")
    )


def _history_sql(where: str) -> str:
    rows = f"(SELECT * FROM {_IMPORTS} WHERE {where})"
    return f"""WITH t AS (SELECT project_id, array_to_string(list(tile ORDER BY "at", seq), ',') AS tiles FROM (SELECT * FROM {rows} WHERE trim(tile) <> '' QUALIFY row_number() OVER (PARTITION BY project_id, tile ORDER BY "at", seq) = 1) GROUP BY 1),
        l AS (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY "at" DESC, seq DESC) = 1)
        SELECT l.project_id, coalesce(tiles, '') AS tiles, path AS last_path, count AS last_count FROM l LEFT JOIN t ON l.project_id = t.project_id"""


def _shown(states):
    return states.select("project_id", F.array_join("state.tiles", ",").alias("tiles"), "state.last_path", "state.last_count")


@query(_history_sql("true"))
def import_history(spark, sf_dir):
    return _shown(importing.import_history(_imports(spark, sf_dir)))


@query(_history_sql("project_id % 7 <> 0 AND project_id % 5 <> 0 AND seq % 11 <> 0"))
def imports_stored(spark, sf_dir):
    """Imports published year by year with their elements; projects that can't be written to, and files without solids, store nothing."""
    store = KeyedStore(spark, scratch(spark, "imports"), buckets=8)
    facts = {"supported": F.col("project_id") % 7 != 0, "read_only": F.col("project_id") % 5 == 0, "solids": F.when(F.col("seq") % 11 == 0, 0).otherwise(1)}
    rows = importing.import_outcome(_imports(spark, sf_dir).withColumns(facts))
    elements = rows.select("project_id", "path", F.col("seq").cast("string").alias("source_id"))
    for low, high in ((0, 1994), (1995, 1996), (1997, 9999)):
        when = F.year("at").between(low, high)
        importing.commit_imports(rows.filter(when), elements.join(rows.filter(when).select("project_id", "path"), ["project_id", "path"], "left_semi"), store, f"{low} to {high}")
    return _shown(importing.load_import_states(store))


# --- solids ---


@query("""SELECT source_id, 8::BIGINT AS flat, 12::BIGINT AS walls, round(7 * u * u, 6) AS top, round(7 * u * u, 6) AS bottom, round(16 * u * h, 6) AS around FROM (SELECT o_orderkey AS source_id, (o_orderkey % 40 + 1)::DOUBLE AS u, (o_orderkey % 30 + 3)::DOUBLE AS h FROM orders)""")
def solid_faces(spark, sf_dir):
    """L-shaped footprints, every other one clockwise, as triangles: areas of top, bottom and walls."""
    u = (F.col("o_orderkey") % 40 + 1).cast("double")
    corners = ((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))
    ring = F.array(*(F.struct((u * x).alias("x_feet"), (u * y).alias("y_feet")) for x, y in corners))
    orders = r._spread(c._read(spark, sf_dir, "orders").select("o_orderkey"))  # a small file would be cut in one task
    solids = orders.select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderkey") % 2 == 0, ring).otherwise(F.reverse(ring)).alias("footprint"), F.lit(5.0).alias("base_feet"), (F.col("o_orderkey") % 30 + 3).cast("double").alias("height_feet"))
    faces = extrusion.extruded(solids, "source_id").withColumn("area", extrusion.area(F.col("a"), F.col("b"), F.col("c")))
    of = lambda side: F.round(F.sum(F.when(F.col("side") == side, F.col("area"))), 6)
    flat = F.col("side") != "wall"
    return faces.groupBy("source_id").agg(F.count_if(flat).alias("flat"), F.count_if(~flat).alias("walls"), of("top").alias("top"), of("bottom").alias("bottom"), of("wall").alias("around"))


# --- messages ---


@query("""WITH m AS (SELECT (user_id % 100)::VARCHAR AS map_id, event_id AS seq, event_id % 23 = 0 AS is_ready FROM events), r AS (SELECT map_id, min(seq) AS ready_at FROM m WHERE is_ready GROUP BY 1)
    SELECT map_id, seq, greatest(seq, ready_at) AS released_at FROM m JOIN r USING (map_id) WHERE NOT is_ready""")
def messages_held(spark, sf_dir):
    body = F.when(F.col("event_id") % 23 == 0, F.lit('{"type":"Ready"}')).otherwise(F.to_json(F.struct(F.col("event_type").alias("type"))))
    rows = c._read(spark, sf_dir, "events").select((F.col("user_id") % 100).cast("string").alias("map_id"), F.col("event_id").alias("seq"), body.alias("body"))
    return messages.delivered(rows).select("map_id", "seq", "released_at")


# --- records of many versions, and exports ---

#: A record's first schema, one with the system apart, and the current one with degrees.
CHAIN = migrations.Chain(
    {0: "Epsg int, Lat double, Lon double, Turn double", 1: "Crs struct<Code: int>, Lat double, Lon double, Turn double", 2: "Crs struct<Code: int, Name: string>, Origin struct<Lat: double, Lon: double>, Angle double"},
    {
        0: lambda r: {"Crs": F.struct(r["Epsg"].alias("Code")), "Lat": r["Lat"], "Lon": r["Lon"], "Turn": r["Turn"]},
        1: lambda r: {"Crs": F.struct(r["Crs"]["Code"].alias("Code"), F.concat(F.lit("EPSG:"), r["Crs"]["Code"].cast("string")).alias("Name")), "Origin": F.struct(r["Lat"].alias("Lat"), r["Lon"].alias("Lon")), "Angle": F.degrees(r["Turn"])},
    },
)


@query("SELECT c_custkey, 6669 + c_custkey % 19 AS code, 'EPSG:' || (6669 + c_custkey % 19) AS name, (c_custkey % 90)::DOUBLE AS lat, round(degrees(c_custkey % 3 / 2.0), 9) AS angle FROM customer")
def records_migrated(spark, sf_dir):
    """Records of three versions in one table, read alike."""
    k = F.col("c_custkey")
    epsg, lat, lon, turn = (6669 + k % 19).cast("int"), (k % 90).cast("double"), (k % 180).cast("double"), k % 3 / 2
    flat = F.to_json(F.struct(epsg.alias("Epsg"), lat.alias("Lat"), lon.alias("Lon"), turn.alias("Turn")))
    apart = F.to_json(F.struct(F.lit(1).alias("SchemaVersion"), F.struct(epsg.alias("Code")).alias("Crs"), lat.alias("Lat"), lon.alias("Lon"), turn.alias("Turn")))
    now = F.struct(F.lit(2).alias("SchemaVersion"), F.struct(epsg.alias("Code"), F.concat(F.lit("EPSG:"), epsg.cast("string")).alias("Name")).alias("Crs"), F.struct(lat.alias("Lat"), lon.alias("Lon")).alias("Origin"), F.degrees(turn).alias("Angle"))
    rows = c._read(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, flat).when(k % 3 == 1, apart).otherwise(F.to_json(now)).alias("json"))
    return rows.select("c_custkey", CHAIN.read(F.col("json")).alias("r")).select("c_custkey", F.col("r.Crs.Code").alias("code"), F.col("r.Crs.Name").alias("name"), F.col("r.Origin.Lat").alias("lat"), F.round("r.Angle", 9).alias("angle"))


_FAULT = "CASE c_custkey % 10 WHEN 3 THEN 'not a whole JSON object' WHEN 5 THEN 'wrong type: EastWestFeet' WHEN 7 THEN 'missing: ProjectId' END"


def _exports(spark, sf_dir):
    """An export for each customer; of ten, one is cut short, one has a text for a number, and one lacks its id."""
    k = F.col("c_custkey")
    east = F.when(k % 10 == 5, F.lit('"far"')).otherwise((k % 100 / 4).cast("string"))
    own = F.when(k % 10 == 7, F.lit("")).otherwise(F.concat(F.lit('"ProjectId":'), k.cast("string"), F.lit(",")))
    text = F.concat(F.lit("{"), own, F.lit('"Title":"'), F.col("c_name"), F.lit('","ReadOnly":'), (k % 2 == 0).cast("string"), F.lit(',"TimeZoneHours":null,"EastWestFeet":'), east, F.lit(',"AngleRadians":0.5}'))
    return c._read(spark, sf_dir, "customer").select("c_custkey", F.when(k % 10 == 3, F.substring(text, 1, 40)).otherwise(text).alias("value"))


@query(f"SELECT c_custkey, {_FAULT} IS NULL AS supported, {_FAULT} AS fault, CASE WHEN c_custkey % 10 NOT IN (3, 7) THEN c_custkey END AS project_id, CASE WHEN c_custkey % 10 NOT IN (3, 5) THEN c_custkey % 100 / 4 END::DOUBLE AS east, CASE WHEN c_custkey % 10 <> 3 THEN c_custkey % 2 = 0 END AS read_only FROM customer")
def snapshots_read(spark, sf_dir):
    return snapshots.snapshots(_exports(spark, sf_dir)).select("c_custkey", "supported", "fault", F.col("ProjectId").alias("project_id"), F.col("EastWestFeet").alias("east"), F.col("ReadOnly").alias("read_only"))


@query(f"SELECT {_FAULT} AS fault, count(*) AS exports FROM customer GROUP BY 1 HAVING fault IS NOT NULL")
def snapshots_quarantined(spark, sf_dir):
    return snapshots.quarantine(snapshots.snapshots(_exports(spark, sf_dir)))
