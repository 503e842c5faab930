"""Validation, health and readiness of project snapshots (columns: `gridloom.sources.sites.PROJECTS`).

Findings are array(struct(seq, code, severity, message)), severity 0 info, 1 warning, 2 error, in the order in which the
rules emit them. Everything is a Column expression on one row: no shuffle at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import mesh
from gridloom.functions.projection import distance_from_origin, finite, project
from gridloom.functions.text import blank
from gridloom.sources.crs import crs_table, with_crs

# Ranges that a site in Japan lies in, the largest offset in metres, and severities.
LATITUDES, LONGITUDES, ELEVATIONS = (20.0, 46.0), (122.0, 154.0), (-500.0, 5000.0)
LARGE_OFFSET = 100_000.0
INFO, WARNING, ERROR = 0, 1, 2
SEVERITIES = ("Info", "Warning", "Error")
# Tolerances below which a position counts as the default (feet, radians).
OFFSET_TOLERANCE, ANGLE_TOLERANCE = 0.0001, 0.0000001

# Names of the confidence levels.
CONFIDENCE = ("Unknown", "Approximate", "Verified")


def confidence_name(confidence: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), confidence + 1)


#: What each code means, in our words.
MESSAGES = {
    "missing-info": "No geo metadata is stored for this project.",
    "missing-crs": "The project has no coordinate reference system.",
    "invalid-crs": "The stored coordinate reference system is unknown.",
    "missing-origin": "The project has no origin.",
    "outside-japan-range": "The origin lies outside Japan's latitudes and longitudes.",
    "suspicious-elevation": "The origin's elevation is implausible.",
    "invalid-projected-coordinate": "The origin projects to no finite coordinate.",
    "large-offset": "The origin lies over 100 km from its zone's origin.",
    "stale-mesh": "The stored mesh code is not that of the origin.",
    "unsupported-document": "This kind of document can't be checked.",
    "read-only-document": "The document is read-only; checks run, changes don't.",
    "unknown-confidence": "No confidence is recorded for the setup.",
    "missing-primary-mesh": "No mesh code is stored yet.",
}


def _finding(seq: int, code: str, severity: int, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(MESSAGES[code]).alias("message")))


def _outside(x: Column, limits: tuple[float, float]) -> Column:
    """Below or above; a NaN is neither."""
    return ~F.isnan(x) & ((x < limits[0]) | (x > limits[1]))


def located(rows: DataFrame) -> DataFrame:
    """`rows` with easting and northing of their origin (null where it or its zone is missing)."""
    return project(with_crs(rows, crs_table(rows.sparkSession)))


def validation(rows: DataFrame) -> DataFrame:
    """Add `validation`: the findings on the stored metadata. Rows need easting and northing (`located`)."""
    info, origin, known = F.col("has_info"), F.col("lat").isNotNull(), F.col("lat0").isNotNull()
    there, sound = F.col("has_info") & origin, finite(F.col("easting")) & finite(F.col("northing"))
    found = [
        _finding(0, "missing-info", WARNING, ~info),
        _finding(1, "missing-crs", WARNING, info & F.col("epsg").isNull()),
        _finding(2, "invalid-crs", WARNING, info & F.col("epsg").isNotNull() & ~known),
        _finding(3, "missing-origin", WARNING, info & ~origin),
        _finding(4, "outside-japan-range", WARNING, there & (_outside(F.col("lat"), LATITUDES) | _outside(F.col("lon"), LONGITUDES))),
        _finding(5, "suspicious-elevation", WARNING, there & _outside(F.col("elevation"), ELEVATIONS)),
        _finding(6, "invalid-projected-coordinate", WARNING, there & known & ~sound),
        _finding(7, "large-offset", WARNING, there & known & sound & (distance_from_origin(F.col("easting"), F.col("northing")) > LARGE_OFFSET)),
        _finding(8, "stale-mesh", WARNING, there & F.col("mesh").isNotNull() & ~F.col("mesh").eqNullSafe(mesh.encode(F.col("lat"), F.col("lon")))),
    ]
    return rows.withColumn("validation", F.array_compact(F.array(*found)))


def health(rows: DataFrame) -> DataFrame:
    """Add `findings`: the health report, worst first, then by code. Rows need `validation`.

    An unsupported document, and one without metadata, stop the report: those come as emitted. Of one code the worse
    finding stays, or the report's own at a tie.
    """
    info, supported = F.col("has_info"), F.col("supported")
    read_only = _finding(0, "read-only-document", INFO, F.col("read_only"))
    own = F.array_compact(
        F.array(
            read_only,
            _finding(1, "missing-crs", ERROR, F.col("epsg").isNull()),
            _finding(2, "missing-origin", ERROR, F.col("lat").isNull()),
            _finding(3, "unknown-confidence", WARNING, F.col("confidence") == 0),
            _finding(4, "missing-primary-mesh", INFO, F.col("mesh").isNull()),
        )
    )
    codes = F.transform(own, lambda f: f["code"])
    # what the validator repeats (missing-*) is an error there too, so the report's own finding wins the tie
    rest = F.filter("validation", lambda f: ~F.array_contains(codes, f["code"]))
    rest = F.transform(rest, lambda f: F.struct((f["seq"] + 10).alias("seq"), f["code"].alias("code"), f["severity"].alias("severity"), f["message"].alias("message")))
    order = F.transform(F.concat(own, rest), lambda f: F.struct((-f["severity"]).alias("worst"), f["code"].alias("by_code"), f.alias("f")))
    ranked = F.transform(F.array_sort(order), lambda s: s["f"])
    out = F.when(~supported, F.array(_finding(0, "unsupported-document", ERROR, F.lit(True)))).when(~info, F.array_compact(F.array(read_only, _finding(1, "missing-info", ERROR, F.lit(True))))).otherwise(ranked)
    return rows.withColumn("findings", out)


def _once(value: Column, f) -> Column:
    """f(value), with `value` computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _code(findings: Column, *codes: str) -> Column:
    return F.exists(findings, lambda f: f["code"].isin(*codes))


#: What a status means, in our words, by precedence: unsupported, errors, warnings, ready, anything else.
STATUS_MESSAGES = ("Checks do not apply to this document.", "Required geo metadata is missing or wrong.", "Geo metadata is there, but something in it needs a look.", "Geo metadata is ready to be used.", "Nothing is wrong, but exports still lack something.")


def status(rows: DataFrame) -> DataFrame:
    """Add `status_title`, `worst` (highest severity, null without findings) and `status_message`. Rows need `findings`."""

    def judged(f: Column) -> Column:
        worst, note = F.array_max(F.transform(f, lambda x: x["severity"])), _code(f, "missing-primary-mesh", "read-only-document")
        title = F.when(worst == ERROR, "errors stand in the way").when(worst == WARNING, "warnings to look at").otherwise("nothing wrong")
        said = [F.lit(m) for m in STATUS_MESSAGES]
        message = F.when(~F.col("supported"), said[0]).when(worst == ERROR, said[1]).when(worst == WARNING, said[2]).when(note, said[4]).otherwise(said[3])
        return F.struct(worst.alias("worst"), title.alias("status_title"), message.alias("status_message"))

    return rows.withColumn("judged", _once(F.col("findings"), judged)).select(*rows.columns, "judged.*")


#: The checklist's titles, and what is said of each where it is not and where it is satisfied; in our words.
CHECKLIST = (
    ("document", "Open a project document first.", "The document can be used."),
    ("reference system", "Save a reference system first.", "EPSG:%s"),
    ("origin", "Save an origin first.", "%.6f, %.6f"),
    ("confidence", "Record how sure the setup is.", "%s"),
    ("mesh code", "No mesh code is stored.", "%s"),
)
STALE = "The stored mesh code is stale."


def readiness(rows: DataFrame) -> DataFrame:
    """Add `readiness` (Blocked, NeedsAttention, Ready) and `items`, five of struct(seq, title, satisfied, detail). Rows need `findings`.

    The findings are reduced to a few flags once; all else is made from those.
    """
    no_crs, no_origin = ~F.col("has_info") | F.col("epsg").isNull(), ~F.col("has_info") | F.col("lat").isNull()
    sure, coded = F.col("has_info") & (F.col("confidence") != 0), F.col("has_info") & F.col("mesh").isNotNull()
    flags = _once(
        F.col("findings"),
        lambda f: F.struct(
            F.coalesce(F.array_max(F.transform(f, lambda x: x["severity"])), F.lit(-1)).alias("worst"),
            _code(f, "invalid-crs").alias("invalid"),
            _code(f, "stale-mesh").alias("stale"),
            _code(f, "missing-primary-mesh", "read-only-document").alias("note"),
        ),
    )

    def judged(f: Column) -> Column:
        blocked = ~F.col("supported") | no_crs | no_origin | (f["worst"] == ERROR) | f["invalid"]
        tests = (F.col("supported"), ~no_crs & ~f["invalid"], ~no_origin, sure, coded & ~f["stale"])
        shown = (F.col("supported"), ~no_crs, ~no_origin, sure, coded)
        values = ((), (F.col("epsg"),), (F.col("lat"), F.col("lon")), (confidence_name(F.col("confidence")),), (F.col("mesh"),))
        items = []
        for i, ((title, without, with_), ok, there, args) in enumerate(zip(CHECKLIST, tests, shown, values, strict=True)):
            detail = F.when(there, F.format_string(with_, *args)).otherwise(without)
            if title == "mesh code":
                detail = F.when(there & f["stale"], STALE).otherwise(detail)
            items.append(F.struct(F.lit(i).alias("seq"), F.lit(title).alias("title"), ok.alias("satisfied"), detail.alias("detail")))
        state = F.when(blocked, "Blocked").when((f["worst"] == WARNING) | f["note"], "NeedsAttention").otherwise("Ready")
        return F.struct(state.alias("readiness"), F.array(*items).alias("items"))

    return rows.withColumn("judged", _once(flags, judged)).select(*rows.columns, "judged.*")


def existing_setup(rows: DataFrame) -> DataFrame:
    """Add `detected` and `reasons`: what in a project's position, or its metadata, is no longer the default."""
    reasons = F.array_compact(
        F.array(
            F.when(F.abs("pos_east") > OFFSET_TOLERANCE, "east-west offset"),
            F.when(F.abs("pos_north") > OFFSET_TOLERANCE, "north-south offset"),
            F.when(F.abs("pos_angle") > ANGLE_TOLERANCE, "true north angle"),
            F.when(F.col("has_info"), "stored metadata"),
        )
    )
    return rows.withColumns({"reasons": F.concat_ws(", ", reasons), "detected": F.size(reasons) > 0})


#: Errors of a placement intent in order, in our words.
INTENT_ERRORS = ("no CRS", "no point", "no projected coordinate", "no setup source", "no angle", "angle out of range", "working point without CRS", "working point without origin", "working point without coordinate", "working point in another CRS")


def intent_errors(epsg: Column, lat: Column, easting: Column, northing: Column, source: Column, mode: Column, angle: Column, wp: Column) -> Column:
    """array(string): what keeps an intent from being previewed. `mode` 2 updates the angle; `wp` is a working point struct or null."""
    has = wp.isNotNull()
    tests = (
        epsg.isNull(),
        lat.isNull(),
        ~(finite(easting) & finite(northing)),
        blank(source),
        (mode == 2) & angle.isNull(),
        angle.isNotNull() & _outside(angle, (-360.0, 360.0)),
        has & wp["epsg"].isNull(),
        has & wp["lat"].isNull(),
        has & ~(finite(wp["easting"]) & finite(wp["northing"])),
        has & epsg.isNotNull() & wp["epsg"].isNotNull() & (epsg != wp["epsg"]),
    )
    return F.array_compact(F.array(*(F.when(t, e) for t, e in zip(tests, INTENT_ERRORS, strict=True))))


STEPS = ("current state", "choose CRS", "select point", "review point", "setup intent", "preview")


def gates(step: Column, supported: Column, read_only: Column, crs: Column, point: Column, valid: Column) -> Column:
    """struct(can_next, can_apply) at a step of the setup (0 to 5: STEPS), from what is chosen so far and whether the intent is valid."""
    tests = F.array(supported, crs.isNotNull(), point.isNotNull(), point.isNotNull(), valid, F.lit(False))
    can_next = F.coalesce(F.get(tests, step), F.lit(False))
    return F.struct(can_next.alias("can_next"), ((step == 5) & valid & supported & ~read_only).alias("can_apply"))


def missing_selection(epsg: Column, lat: Column, mode: Column) -> Column:
    """array(string): what must be chosen before an intent can be checked."""
    return F.array_compact(F.array(F.when(epsg.isNull(), "CRS"), F.when(lat.isNull(), "point"), F.when(mode.isNull(), "mode")))
