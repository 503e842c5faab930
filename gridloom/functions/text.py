"""Parsers of small texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as the invariant culture writes it.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MESSAGE = "type string, latitude double, longitude double"


def blank(text: Column) -> Column:
    """Null, empty or white space alone."""
    return text.isNull() | ~text.rlike(r"\S")


def trimmed(text: Column) -> Column:
    """Without white space at either end; the empty text for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def number(text: Column) -> Column:
    """A double, or null for what isn't a number."""
    clean = trimmed(text)
    return F.when(clean.rlike(NUMBER), clean.try_cast("double"))


def coordinate_pair(text: Column) -> Column:
    """struct(lat, lon) of two numbers in range, separated by comma, semicolon, slash or spaces; else null."""
    tokens = F.filter(F.split(F.translate(trimmed(text), ";/", ", "), "[, ]"), lambda t: t != "")
    lat, lon = number(F.try_element_at(tokens, F.lit(1))), number(F.try_element_at(tokens, F.lit(2)))
    return F.when((F.size(tokens) == 2) & lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def epsg_of(srs: Column) -> Column:
    """The last run of four or five digits that stands alone in a reference-system text."""
    return F.try_element_at(F.regexp_extract_all(F.coalesce(srs, F.lit("")), F.lit(r"(?<![0-9])([0-9]{4,5})(?![0-9])")), F.lit(-1)).cast("int")


def tile_id_of(path: Column) -> Column:
    """The first run of eight digits that stands alone in a file's name, without folders or extension."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    found = F.regexp_extract(base, r"(?<![0-9])([0-9]{8})(?![0-9])", 1)
    return F.when(found != "", found)


def bridge_message(json: Column) -> Column:
    """struct(type, latitude, longitude) of a map message; a missing type is empty."""
    m = F.from_json(json, MESSAGE)
    return F.struct(F.coalesce(m["type"], F.lit("")).alias("type"), m["latitude"].alias("latitude"), m["longitude"].alias("longitude"))
