"""Reports as rows (project_id, seq, label, value) of project snapshots; labels are ours. No shuffle at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import mesh
from gridloom.functions.projection import FOOT
from gridloom.functions.text import blank
from gridloom.operators.rules import confidence_name
from gridloom.operators.workflow import format_anchor, format_crs, format_working_point, inspected, valid_point, working_point


def _rows(rows: DataFrame, *fields: tuple[str, Column]) -> DataFrame:
    """A row for each field whose value isn't null; seq is its place among all fields."""
    array = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(n).alias("label"), v.cast("string").alias("value")) for i, (n, v) in enumerate(fields)))
    return rows.select("project_id", F.inline(F.filter(array, lambda f: f["value"].isNotNull())))


def _yes(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def _crs() -> Column:
    return F.when(F.col("epsg").isNotNull(), format_crs(F.col("epsg"), F.col("crs_name")))


def _place(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.6f, %.6f", lat, lon))


def _origin() -> Column:
    return F.when(F.col("lat").isNotNull(), F.format_string("%.6f, %.6f, elev %.3f m", "lat", "lon", "elevation"))


def _length(feet: Column) -> Column:
    return F.format_string("%.3f ft / %.3f m", feet, feet * FOOT)


def health_rows(rows: DataFrame) -> DataFrame:
    """Nine rows of the health report."""
    none = lambda c, text: F.coalesce(c, F.lit(text))
    info = F.col("has_info")
    return _rows(
        rows,
        ("document", F.col("project_id")),
        ("supported", _yes(F.col("supported"))),
        ("read-only", _yes(F.col("read_only"))),
        ("metadata", _yes(info)),
        ("CRS", none(_crs(), "none")),
        ("origin", none(_origin(), "none")),
        ("confidence", F.when(info, confidence_name(F.col("confidence"))).otherwise("none")),
        ("mesh", none(F.when(info, F.col("mesh")), "none")),
        ("source", F.when(info & ~blank(F.col("setup_source")), F.col("setup_source")).otherwise("not recorded")),
    )


def state_rows(rows: DataFrame) -> DataFrame:
    """The current state: rows for what is there alone."""
    point = lambda p: F.format_string("X %.3f ft, Y %.3f ft, Z %.3f ft", f"{p}_x", f"{p}_y", f"{p}_z")
    wp, info = working_point(), F.col("has_info")
    return _rows(
        rows,
        ("document", F.col("project_id")),
        ("metadata", _yes(info)),
        ("read-only", _yes(F.col("read_only"))),
        ("site", _place(F.col("site_lat"), F.col("site_lon"))),
        ("time zone", time_zone(F.col("site_hours"))),
        ("position", F.concat(F.lit("EW "), _length(F.col("pos_east")), F.lit(", NS "), _length(F.col("pos_north")))),
        ("elevation", _length(F.col("pos_elevation"))),
        ("true north", F.format_string("%.3f°", F.degrees("pos_angle"))),
        ("survey point", point("sp")),
        ("base point", point("bp")),
        ("CRS", _crs()),
        ("origin", _origin()),
        ("working point", F.when(valid_point(wp), format_working_point(wp))),
        ("confidence", F.when(info, confidence_name(F.col("confidence")))),
        ("source", F.when(info & ~blank(F.col("setup_source")), F.col("setup_source"))),
    )


def time_zone(hours: Column) -> Column:
    """UTC with a signed offset of at most two decimals; null without one."""
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.abs(hours)), "0+$", ""), r"\.$", "")
    return F.when(hours.isNotNull(), F.concat(F.lit("UTC"), F.when(hours > 0, "+").when(hours < 0, "-").otherwise(""), F.when(hours == 0, "0").otherwise(number)))


def point_rows(rows: DataFrame) -> DataFrame:
    """The chosen point of an intent (i_* columns); none without a point."""
    i = lambda n: F.col(f"i_{n}")
    return _rows(
        rows.filter("i_lat IS NOT NULL"),
        ("place", _place(i("lat"), i("lon"))),
        ("easting", F.when(i("easting").isNotNull(), F.format_string("%.4f m", i("easting")))),
        ("northing", F.when(i("northing").isNotNull(), F.format_string("%.4f m", i("northing")))),
        ("anchor", F.when(i("anchor") != 0, format_anchor(i("anchor")))),
        ("source", i("source")),
        ("confidence", confidence_name(i("confidence"))),
        ("CRS", F.when(i("epsg").isNotNull(), format_crs(i("epsg"), i("name")))),
    )


def mesh_rows(rows: DataFrame, source: str = "survey") -> DataFrame:
    """The mesh inspector's rows; the status alone where nothing can be inspected."""
    rows = inspected(rows, source).withColumn("around", F.transform(mesh.neighbours(F.col("code")), lambda n: n["code"]))
    there = F.col("code").isNotNull()
    shown = lambda c: F.when(there, c)
    return _rows(
        rows,
        ("reference", shown(F.col("ref.title"))),
        ("place", shown(_place(F.col("ref.lat"), F.col("ref.lon")))),
        ("CRS", shown(_crs())),
        ("origin", shown(_origin())),
        ("stored mesh", shown(F.coalesce("mesh", F.lit("none")))),
        ("mesh", F.col("code")),
        ("status", F.col("mesh_status")),
        ("neighbours", shown(F.array_join("around", " "))),
        ("confidence", shown(confidence_name(F.col("confidence")))),
        ("source", shown(F.when(blank(F.col("setup_source")), "not recorded").otherwise(F.col("setup_source")))),
        ("can save", F.when(F.col("can_save"), "yes")),
    )
