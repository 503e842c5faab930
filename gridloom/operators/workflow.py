"""Fallback chains, previews, canonical location and stored records, on project snapshots."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import mesh
from gridloom.functions.projection import FOOT, finite, project
from gridloom.functions.text import blank
from gridloom.operators.rules import CONFIDENCE, existing_setup, intent_errors, validation
from gridloom.operators.store import KeyedStore
from gridloom.sources.crs import crs_table, with_crs

# Names of modes and anchors, and the version of stored records.
MODES = ("Metadata Only", "Project Location", "Project Location + True North")
ANCHORS = ("Survey Point", "Survey Point", "Project Base Point")
SCHEMA_VERSION = 1
#: The module whose state holds the working point.
GEOREFERENCE = "georeference"
#: A stored record as JSON.
RECORD = """SchemaVersion int, ProjectCrs struct<EpsgCode:int,NameSnapshot:string>, Origin struct<Latitude:double,Longitude:double,ElevationMeters:double>,
    TrueNorthAngle double, PrimaryMeshCode struct<Value:string>, Confidence int, SetupSource string, GeoSetupDate timestamp"""


def _named(names: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), i + 1)


def working_point() -> Column:
    """The stored working point as struct(epsg, name, lat, lon, elevation, easting, northing), null where nothing of it is stored."""
    names = ("epsg", "name", "lat", "lon", "elevation", "easting", "northing")
    some = F.col("wp_epsg").isNotNull() | F.col("wp_lat").isNotNull()
    return F.when(some, F.struct(*(F.col(f"wp_{n}").alias(n) for n in names)))


def valid_point(wp: Column) -> Column:
    return F.coalesce(wp["epsg"].isNotNull() & wp["lat"].isNotNull() & finite(wp["easting"]) & finite(wp["northing"]), F.lit(False))


def resolve_working_point(explicit: Column, anchor: Column, epsg: Column, name: Column, lat: Column, lon: Column, easting: Column, northing: Column) -> Column:
    """The explicit point if it is valid, else the intent's own if it is anchored at the base point (2) and complete, else null."""
    own = F.struct(epsg.alias("epsg"), name.alias("name"), lat.alias("lat"), lon.alias("lon"), F.lit(0.0).alias("elevation"), easting.alias("easting"), northing.alias("northing"))
    return F.when(valid_point(explicit), explicit).when((anchor == 2) & epsg.isNotNull() & lat.isNotNull() & finite(easting) & finite(northing), own)


def current_state(rows: DataFrame) -> DataFrame:
    """Add `current`: struct(lat, lon, elevation, source) from metadata, base point or site, and `current_angle` in degrees."""
    origin = lambda lat, lon, elevation, source: F.struct(lat.alias("lat"), lon.alias("lon"), elevation.alias("elevation"), F.lit(source).alias("source"))
    none = F.lit(None).cast("double")
    current = (
        F.when(F.col("lat").isNotNull(), origin(F.col("lat"), F.col("lon"), F.col("elevation"), "stored"))
        .when(F.col("est_lat").isNotNull(), origin(F.col("est_lat"), F.col("est_lon"), F.col("bp_z") * FOOT, "base point"))
        .when(F.col("site_lat").isNotNull(), origin(F.col("site_lat"), F.col("site_lon"), F.col("pos_elevation") * FOOT, "site"))
        .otherwise(origin(none, none, none, ""))
    )
    angle = F.when(F.col("has_info"), F.col("angle")).otherwise(F.degrees("pos_angle"))
    return rows.withColumns({"current": current, "current_angle": angle})


def mesh_reference(rows: DataFrame, source: str = "survey") -> DataFrame:
    """Add `ref`: struct(title, lat, lon, persistable), null where nothing can be inspected. `source` is survey or base."""
    point = lambda title, lat, lon, keep: F.struct(F.lit(title).alias("title"), lat.alias("lat"), lon.alias("lon"), keep.alias("persistable"))
    ready = F.col("supported") & F.col("epsg").isNotNull() & F.col("lat").isNotNull()
    if source == "survey":
        ref = F.when(ready, point("survey", F.col("lat"), F.col("lon"), ~F.col("read_only")))
    else:
        ref = F.when(ready & valid_point(working_point()), point("working", F.col("wp_lat"), F.col("wp_lon"), F.lit(False)))
        ref = ref.when(ready & F.col("est_lat").isNotNull(), point("base", F.col("est_lat"), F.col("est_lon"), F.lit(False)))
    return rows.withColumn("ref", ref)


def inspected(rows: DataFrame, source: str = "survey") -> DataFrame:
    """Add `ref`, `code`, `mesh_status` and `can_save` for the chosen reference."""
    rows = mesh_reference(rows, source).withColumn("code", mesh.encode(F.col("ref.lat"), F.col("ref.lon")))
    same = F.col("mesh").eqNullSafe(F.col("code"))
    blocked = F.when(~F.col("supported"), "unsupported").when(F.col("epsg").isNull() | F.col("lat").isNull(), "incomplete metadata").when(F.col("ref").isNull(), "no base point")
    kept = F.when(F.col("mesh").isNull(), "Not stored yet").when(same, "Stored value is current").otherwise("Stored value is stale")
    status = F.coalesce(blocked, kept if source == "survey" else F.lit("Inspection only"))
    can_save = F.coalesce(F.col("ref.persistable") & ~same, F.lit(False))
    return rows.withColumns({"mesh_status": status, "can_save": can_save})


def inspect_mesh(rows: DataFrame, source: str = "survey") -> DataFrame:
    """project_id, title, code, mesh_status, can_save, for the chosen reference."""
    return inspected(rows, source).select("project_id", F.col("ref.title").alias("title"), "code", "mesh_status", "can_save")


def import_reference(rows: DataFrame, prefer: Column) -> DataFrame:
    """Anchor of an import: project_id, title, epsg, crs_name, easting, northing, x, y, z (feet). `prefer` is true for the working point.

    The stored working point, else the base point's estimate, if preferred; else the canonical origin. Rows without
    CRS or origin have none and are left out.
    """
    rows = rows.filter(F.col("epsg").isNotNull() & F.col("lat").isNotNull())
    stored = prefer & valid_point(working_point())
    estimate = prefer & ~stored & F.col("est_lat").isNotNull()
    rows = rows.withColumns({"__stored": stored, "__est": estimate})
    rows = rows.withColumns({"plat": F.when(F.col("__est"), F.col("est_lat")).otherwise(F.col("lat")), "plon": F.when(F.col("__est"), F.col("est_lon")).otherwise(F.col("lon"))})
    rows = project(with_crs(rows, crs_table(rows.sparkSession)), "plat", "plon")
    local = F.col("__stored") | F.col("__est")
    pick = lambda a, b: F.when(local, F.col(f"bp_{a}")).otherwise(F.col(f"sp_{a}")).alias(b)
    return rows.select(
        "project_id",
        F.when(F.col("__stored"), "working").when(F.col("__est"), "base").otherwise("canonical").alias("title"),
        F.when(F.col("__stored"), F.col("wp_epsg")).otherwise(F.col("epsg")).alias("epsg"),
        F.when(F.col("__stored"), F.col("wp_name")).otherwise(F.col("crs_name")).alias("crs_name"),
        F.when(F.col("__stored"), F.col("wp_easting")).otherwise(F.col("easting")).alias("easting"),
        F.when(F.col("__stored"), F.col("wp_northing")).otherwise(F.col("northing")).alias("northing"),
        *(pick(a, a) for a in "xyz"),
    )


def default_import_source(last: Column, working: Column, estimate: Column) -> Column:
    """The last one used, else the working point if there is any local point, else the canonical origin."""
    return F.coalesce(last, F.when(working | estimate, "WorkingProjectBasePoint").otherwise("CanonicalOrigin"))


def format_crs(epsg: Column, name: Column) -> Column:
    return F.when(epsg.isNull(), "Not stored").otherwise(F.concat(F.lit("EPSG:"), epsg.cast("string"), F.lit("  "), name))


def format_origin(lat: Column, lon: Column, elevation: Column) -> Column:
    return F.when(lat.isNull(), "Unknown").otherwise(F.format_string("Lat %.6f, Lon %.6f, Elev %.3f m", lat, lon, elevation))


def format_projected(easting: Column, northing: Column) -> Column:
    return F.when(easting.isNull() | northing.isNull(), "none captured").otherwise(F.format_string("E %.4f m, N %.4f m", easting, northing))


def format_angle(degrees: Column) -> Column:
    return F.format_string("%.3f°", degrees)


def format_mode(mode: Column) -> Column:
    return _named(MODES, mode)


def format_anchor(anchor: Column) -> Column:
    """0 is no choice: the survey point, said to be the default."""
    return F.concat(_named(ANCHORS, anchor), F.when(anchor == 0, " (default)").otherwise(""))


def format_confidence(confidence: Column, source: Column) -> Column:
    return F.concat_ws(" / ", F.coalesce(_named(CONFIDENCE, confidence), F.lit("Unknown")), F.when(blank(source), "No source note").otherwise(source))


def proposed_angle(mode: Column, angle: Column, current: Column) -> Column:
    return F.when(mode == 2, F.coalesce(angle, current)).otherwise(current)


def format_working_point(p: Column) -> Column:
    """Reference system, projected coordinate and origin of a working point that is complete."""
    parts = (format_crs(p["epsg"], p["name"]), format_projected(p["easting"], p["northing"]), format_origin(p["lat"], p["lon"], p["elevation"]))
    return F.when(valid_point(p), F.concat_ws(" / ", *parts)).otherwise("Not stored")


def intended_working_point() -> Column:
    """The working point that an intent would save, if any."""
    i = lambda n: F.col(f"i_{n}")
    return resolve_working_point(working_point(), *map(i, ("anchor", "epsg", "name", "lat", "lon", "easting", "northing")))


def preview(rows: DataFrame) -> DataFrame:
    """Before and after of an intent: project_id, seq, label, current_value, proposed_value, eight rows each.

    The snapshot's columns say what is; i_epsg, i_name, i_lat, i_lon, i_easting, i_northing, i_angle, i_mode, i_anchor,
    i_confidence and i_source say what is intended.
    """
    rows = current_state(rows)
    i = lambda n: F.col(f"i_{n}")
    fields = (
        ("CRS", format_crs(F.col("epsg"), F.col("crs_name")), format_crs(i("epsg"), i("name"))),
        ("origin", format_origin(F.col("current.lat"), F.col("current.lon"), F.col("current.elevation")), format_origin(i("lat"), i("lon"), F.lit(0.0))),
        ("coordinate", F.lit("Not derived from what is stored"), format_projected(i("easting"), i("northing"))),
        ("true north", format_angle(F.col("current_angle")), format_angle(proposed_angle(i("mode"), i("angle"), F.col("current_angle")))),
        ("mode", F.lit("nothing pending"), format_mode(i("mode"))),
        ("anchor", F.lit("none captured"), format_anchor(i("anchor"))),
        ("working point", format_working_point(working_point()), format_working_point(intended_working_point())),
        ("certainty", format_confidence(F.col("confidence"), F.col("setup_source")), format_confidence(i("confidence"), i("source"))),
    )
    array = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(label).alias("label"), a.alias("current_value"), b.alias("proposed_value")) for k, (label, a, b) in enumerate(fields)))
    return rows.select("project_id", F.inline(array))


def preview_ready(rows: DataFrame) -> DataFrame:
    """Add `errors` and `ready` of the same intent."""
    i = lambda n: F.col(f"i_{n}")
    errors = intent_errors(i("epsg"), i("lat"), i("easting"), i("northing"), i("source"), i("mode"), i("angle"), working_point())
    return rows.withColumn("errors", errors).withColumn("ready", F.size("errors") == 0)


#: Notes of a preview, in our words: on the state, then what changes and what stays, by mode.
STATE_NOTES = ("nothing is stored yet; the current values come from the host", "an existing setup would be overwritten", "the current origin comes from: ")
CHANGES = (("metadata",), ("metadata", "location"), ("metadata", "location", "angle"))
STAYS = (("location", "angle", "geometry"), ("angle", "geometry"), ("geometry",))


def preview_notes(rows: DataFrame) -> DataFrame:
    """Add `warnings`, `will_change`, `will_stay` (arrays of text), `persistence`, `impact`, `certainty` (texts) and `ready` of an intent.

    Warnings are the intent's errors, notes on the current state, and what the validator says of the record that the intent
    would make. Lists name what changes by kind: metadata, location, angle, working point, geometry.
    """
    i = lambda n: F.col(f"i_{n}")
    rows = existing_setup(current_state(preview_ready(rows)))
    kept = rows.columns
    angle = proposed_angle(i("mode"), i("angle"), F.col("current_angle"))
    names = dict(zip(("epsg", "lat", "lon", "elevation", "angle", "mesh", "has_info"), (i("epsg"), i("lat"), i("lon"), F.lit(0.0), angle, F.lit(None).cast("string"), F.lit(True)), strict=True))
    # the validator reads a record's own columns: those of the intended one stand in for them
    candidate = rows.select(F.struct("*").alias("now"), *(c.alias(n) for n, c in names.items()))
    candidate = validation(project(with_crs(candidate, crs_table(rows.sparkSession))))
    rows = candidate.select("now.*", F.transform("validation", lambda f: f["message"]).alias("said"))
    state = F.array_compact(F.array(
        F.when(~F.col("has_info"), STATE_NOTES[0]), F.when(F.col("detected"), STATE_NOTES[1]), F.when(F.col("current.source") != "", F.concat(F.lit(STATE_NOTES[2]), "current.source"))
    ))
    wp, lists = intended_working_point(), lambda t: F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in t)), i("mode") + 1)
    point = lambda here: F.when(wp.isNotNull() == F.lit(here), F.array(F.lit("working point"))).otherwise(F.array().cast("array<string>"))
    anchor = format_anchor(F.when(i("anchor") == 0, 1).otherwise(i("anchor")))
    target = F.when(i("mode") == 0, "metadata alone").otherwise(F.concat(F.lit("location at the "), anchor, F.when(i("mode") == 2, " and true north").otherwise("")))
    saved = F.when(wp.isNotNull(), "; working point saved").otherwise("")
    return rows.select(
        *kept,
        F.concat("errors", state, "said").alias("warnings"),
        F.concat(lists(CHANGES), point(True)).alias("will_change"),
        F.concat(lists(STAYS), point(False)).alias("will_stay"),
        F.concat(F.lit("EPSG:"), F.coalesce(i("epsg").cast("string"), F.lit("unknown")), F.lit(", origin, angle, confidence "), _named(CONFIDENCE, i("confidence")), saved).alias("persistence"),
        F.concat(target, saved).alias("impact"),
        format_confidence(i("confidence"), i("source")).alias("certainty"),
    )


def build_intent(epsg: Column, name: Column, point: Column, mode: Column, source: Column, angle: Column) -> dict[str, Column]:
    """The i_* columns of an intent from a chosen system and point: struct(lat, lon, easting, northing, confidence, anchor). Elevation is 0."""
    own = {n: point[n] for n in ("lat", "lon", "easting", "northing", "confidence", "anchor")}
    columns = {"epsg": epsg, "name": name, **own, "elevation": F.when(point.isNotNull(), F.lit(0.0)), "mode": mode, "source": source, "angle": angle}
    return {f"i_{n}": c for n, c in columns.items()}


def audit_summary(title: Column, angle: Column) -> Column:
    """What an applied intent did, in one line."""
    i = lambda n: F.col(f"i_{n}")
    wp = intended_working_point()
    parts = (
        F.concat(title, F.lit(": "), format_mode(i("mode"))),
        F.coalesce(F.concat(F.lit("EPSG:"), i("epsg").cast("string")), F.lit("no CRS")),
        F.coalesce(F.format_string("Lat %.6f, Lon %.6f", i("lat"), i("lon")), F.lit("no origin")),
        F.when(finite(i("easting")) & finite(i("northing")), F.format_string("E %.3f m, N %.3f m", i("easting"), i("northing"))).otherwise("no projected coordinate"),
        format_anchor(F.when(i("anchor") == 0, 1).otherwise(i("anchor"))),
        format_angle(angle),
        format_confidence(i("confidence"), i("source")),
        F.when(valid_point(wp), F.format_string("working point E %.3f m, N %.3f m in EPSG:%s", wp["easting"], wp["northing"], wp["epsg"])),
    )
    return F.concat_ws("; ", *parts)


def apply_placements(rows: DataFrame, applied_at: Column) -> DataFrame:
    """What applying each row's intent would store: project_id, outcome, record, state and audit (JSON; null unless applied).

    Outcomes: applied, or why not (unsupported, read-only, invalid intent). The stored record is a new one, so it has no
    mesh code. One row holds all that one project's change writes: published together or not at all (`commit_placements`).
    """
    i = lambda n: F.col(f"i_{n}")
    rows = current_state(preview_ready(rows))
    outcome = F.when(~F.col("supported"), "unsupported").when(F.col("read_only"), "read-only").when(~F.col("ready"), "invalid intent").otherwise("applied")
    angle, done, wp = proposed_angle(i("mode"), i("angle"), F.col("current_angle")), outcome == "applied", intended_working_point()
    crs = F.struct(i("epsg").alias("EpsgCode"), i("name").alias("NameSnapshot"))
    origin = F.struct(i("lat").alias("Latitude"), i("lon").alias("Longitude"), F.lit(0.0).alias("ElevationMeters"))
    place = [crs.alias("ProjectCrs"), origin.alias("Origin"), angle.alias("TrueNorthAngle"), i("confidence").alias("Confidence"), i("source").alias("SetupSource")]
    record = F.struct(F.lit(SCHEMA_VERSION).alias("SchemaVersion"), *place, applied_at.alias("GeoSetupDate"))
    audit = F.struct(applied_at.alias("AppliedAt"), *place, format_mode(i("mode")).alias("ApplyMode"), audit_summary(F.col("project_id").cast("string"), angle).alias("Summary"))
    return rows.select(
        "project_id",
        outcome.alias("outcome"),
        F.when(done, F.to_json(record)).alias("record"),
        F.when(done & wp.isNotNull(), envelope(F.struct(wp.alias("WorkingPoint"), applied_at.alias("LastUpdated")), "GeoreferenceModuleState")).alias("state"),
        F.when(done, F.to_json(audit)).alias("audit"),
    )


def commit_placements(placed: DataFrame, store: KeyedStore, commit_id: str) -> int:
    """Publish what `apply_placements` says as one commit: records, module states and audit lines together or not at all. Its version.

    A commit id that has been published adds nothing; a writer that was overtaken gets CommitConflict.
    """
    done = placed.filter("outcome = 'applied'").select(F.col("project_id").cast("string").alias("key"), "record", "state", "audit").persist(StorageLevel.DISK_ONLY)
    states = done.filter("state IS NOT NULL").select(state_key(F.col("key"), F.lit(GEOREFERENCE)).alias("key"), F.col("state").alias("value"))
    try:
        return store.commit(commit_id, {"records": done.select("key", F.col("record").alias("value")), "states": states, "audit": done.select("key", F.col("audit").alias("value"))})
    finally:
        done.unpersist()


def save_mesh_code(rows: DataFrame) -> DataFrame:
    """project_id, outcome, mesh: the survey point's mesh code stored where that is allowed; else why not, and the code as it was."""
    outcome = F.when(~F.col("supported"), "unsupported").when(F.col("read_only"), "read-only").when(~F.col("has_info"), "no metadata").when(F.col("epsg").isNull() | F.col("lat").isNull(), "incomplete metadata").otherwise("saved")
    return rows.select("project_id", outcome.alias("outcome"), F.when(outcome == "saved", mesh.encode(F.col("lat"), F.col("lon"))).otherwise(F.col("mesh")).alias("mesh"))


def apply_location(rows: DataFrame) -> DataFrame:
    """Set CRS, origin and angle to the intent's; the mesh code stays only if none of them changes."""
    pairs = (("epsg", "i_epsg"), ("crs_name", "i_name"), ("lat", "i_lat"), ("lon", "i_lon"), ("elevation", "i_elevation"), ("angle", "i_angle"))
    changed = F.lit(False)
    for a, b in pairs:
        changed = changed | ~F.col(a).eqNullSafe(F.col(b))
    rows = rows.withColumn("changed", changed).withColumn("mesh", F.when(F.col("changed"), None).otherwise(F.col("mesh")))
    return rows.withColumns({a: F.col(b) for a, b in pairs})


def migrated(version: Column) -> Column:
    """The version a stored record has after migration; a future one is an error."""
    return F.when(version > SCHEMA_VERSION, F.raise_error(F.concat(F.lit("unsupported schema version "), version.cast("string"))).cast("int")).when(version <= 0, F.lit(SCHEMA_VERSION)).otherwise(version)


def read_record(json: Column) -> Column:
    """A stored record, migrated."""
    r = F.from_json(json, RECORD)
    return r.withField("SchemaVersion", migrated(F.coalesce(r["SchemaVersion"], F.lit(0))))


def project_store(spark: SparkSession, path: str) -> KeyedStore:
    """The store of projects: records and states by key, the audit as a log."""
    return KeyedStore(spark, path, logs=("audit",))


def save_records(records: DataFrame, store: KeyedStore, commit_id: str) -> int:
    """Store records (project_id, record as JSON) in place of those that their projects have."""
    return store.commit(commit_id, {"records": records.select(F.col("project_id").cast("string").alias("key"), F.col("record").alias("value"))})


def load_records(store: KeyedStore, kind: str = "long") -> DataFrame:
    """project_id, record: each project's record, migrated. Projects without one are not in it."""
    return store.read("records").select(F.col("key").cast(kind).alias("project_id"), read_record(F.col("value")).alias("record"))


def has_records(store: KeyedStore, projects: DataFrame) -> DataFrame:
    """`projects` (project_id) with `has_record`."""
    asked = projects.withColumn("key", F.col("project_id").cast("string"))
    return store.exists("records", asked).drop("key").withColumnRenamed("stored", "has_record")


def envelope(payload: Column, kind: str) -> Column:
    """A versioned envelope as JSON, its payload a JSON text."""
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("SchemaVersion"), F.lit(kind).alias("PayloadType"), F.to_json(payload).alias("Payload")))


def opened(json: Column, schema: str) -> Column:
    """struct(version, kind, payload) of an envelope."""
    e = F.from_json(json, "SchemaVersion int, PayloadType string, Payload string")
    return F.struct(migrated(e["SchemaVersion"]).alias("version"), e["PayloadType"].alias("kind"), F.from_json(e["Payload"], schema).alias("payload"))


def merged_states(states: DataFrame, updates: DataFrame) -> DataFrame:
    """Module states (module_id, envelope) with `updates` in place of those they name. A blank id is an error."""
    key = F.when(blank(F.col("module_id")), F.raise_error(F.lit("a module id is blank")).cast("string")).otherwise(F.col("module_id"))
    updates = updates.withColumn("module_id", key)
    return states.join(updates.select("module_id"), "module_id", "left_anti").unionByName(updates)


def state_key(project: Column, module: Column) -> Column:
    """A module state's key: the project, and the module, whose id may not be blank."""
    named = F.when(blank(module), F.raise_error(F.lit("a module id is blank")).cast("string")).otherwise(module)
    return F.concat(project.cast("string"), F.lit("/"), named)


def save_states(states: DataFrame, store: KeyedStore, commit_id: str) -> int:
    """Store module states (project_id, module_id, envelope) in place of those they name."""
    return store.commit(commit_id, {"states": states.select(state_key(F.col("project_id"), F.col("module_id")).alias("key"), F.col("envelope").alias("value"))})


def load_states(store: KeyedStore, wanted: DataFrame) -> DataFrame:
    """`wanted` (project_id, module_id) with `envelope`; null where there is none."""
    asked = wanted.withColumn("key", state_key(F.col("project_id"), F.col("module_id")))
    return asked.join(store.get("states", asked).select("key", F.col("value").alias("envelope")), "key", "left").drop("key")


def audit_lines(store: KeyedStore) -> DataFrame:
    """project_id, version, audit: every line of the log."""
    return store.rows("audit").select(F.col("key").alias("project_id"), "version", F.col("value").alias("audit"))


def latest_audit(store: KeyedStore) -> DataFrame:
    """project_id, audit: each project's last line."""
    return store.read("audit").select(F.col("key").alias("project_id"), F.col("value").alias("audit"))
