"""CityGML buildings and GML codelists as tables. Only the XML itself is parsed in Python, in tasks: large files by ranges (`gml_ranges`)."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.mesh import first_by
from gridloom.functions.text import blank, epsg_of, trimmed
from gridloom.sources import gml_ranges
from gridloom.sources.gml_ranges import GML

# Element names of codelist entries.
ENTRIES = ("definition", "entry", "codeentry")
CODES = "source_path string, pos int, code string, name string, description string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def coordinates(text: Column, dimension: Column) -> Column:
    """array(struct(x, y, z)) of a posList; a number that isn't one is an error, a short list is empty, a partial tuple is left out."""
    tokens = F.filter(F.split(text, r"[ \t\r\n]+"), lambda t: t != "")
    n = F.size(tokens)
    dim = F.when(dimension >= 2, dimension).when(n % 3 == 0, 3).otherwise(2)
    at = lambda i: F.get(tokens, i).cast("double")
    point = lambda i: F.struct(at(i * dim).alias("x"), at(i * dim + 1).alias("y"), F.when(dim > 2, at(i * dim + 2)).otherwise(0.0).alias("z"))
    none = F.array().cast("array<struct<x:double,y:double,z:double>>")
    return F.when(n < 6, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / dim).cast("int") - 1, F.lit(0))), point))


def buildings(spark: SparkSession, path: str, split_bytes: int = gml_ranges.SPLIT_BYTES, tiles: list[str] | None = None) -> DataFrame:
    """The usable buildings of the files below `path` (`buildings_of`), read by byte ranges; of some tiles' files only, if given.

    A blank path is an error, and so is one that isn't there.
    """
    if not path.strip():
        raise ValueError("a path is needed")
    spark.dataSource.register(gml_ranges.GmlSource)
    reader = spark.read.format("citygml").option("split_bytes", split_bytes).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if tiles is not None:
        reader = reader.option("tiles", ",".join(tiles))
    return _usable(reader.load(path))


def buildings_of(files: DataFrame) -> DataFrame:
    """One row for each usable building of `files` (path, content): source_path, srs_name, epsg_code, file_tile_id, building_id, name, ring.

    A building's ring is that of its first polygon; those with fewer than four points are left out. A building without
    an id gets one from its file and ring, the same at every reading.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (row for p, content in zip(batch.column(0), batch.column(1), strict=True) for row in gml_ranges.buildings(p.as_py(), BytesIO(content.as_py()), 0, 1 << 62))
            yield from gml_ranges.batched(found)

    return _usable(files.select("path", "content").mapInArrow(run, gml_ranges.SCHEMA))


def _usable(raw: DataFrame) -> DataFrame:
    ring = coordinates(F.col("pos_list"), F.col("dimension"))
    rows = raw.select("source_path", trimmed(F.col("srs_name")).alias("srs_name"), epsg_of(F.col("srs_name")).alias("epsg_code"), "file_tile_id", "building_id", "name", ring.alias("ring"))
    return rows.filter(F.size("ring") >= 4)


def _codes(path: str, content: bytes) -> Iterator[tuple]:
    local = lambda e: e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""

    def text(e: ET.Element, name: str, gml: bool) -> str | None:
        child = next((c for c in e if gml and c.tag == GML + name), None)
        child = child if child is not None else next((c for c in e if local(c) == name), None)
        return None if child is None else "".join(child.itertext())

    pos = 0
    for e in ET.fromstring(content).iter() if content.strip() else ():
        if local(e) in ENTRIES:
            options = (e.get(GML + "id"), e.get("code"), text(e, "identifier", False), "")
            code = next(x for x in options if x is not None)
            name = text(e, "name", True)
            yield path, pos, code, code if name is None else name, text(e, "description", True) or ""
            pos += 1


def codelist(spark: SparkSession, path: str) -> DataFrame:
    """code, name, description of the codelists below `path`, by code (`codelist_of`)."""
    return codelist_of(_files(spark, path)).orderBy("code")


def codelist_of(files: DataFrame) -> DataFrame:
    """code, name, description of `files` (path, content): blank codes left out, the first of each code, file by file."""

    names = [x.split()[0] for x in CODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = [row for p, content in zip(batch.column(0), batch.column(1), strict=True) for row in _codes(p.as_py(), content.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return first_of_code(files.select("path", "content").mapInArrow(run, CODES))


def first_of_code(entries: DataFrame) -> DataFrame:
    """code, name, description: of entries (source_path, pos, code, name, description) the first of each code that isn't blank."""
    clean = entries.filter(~blank(F.col("code"))).select("source_path", "pos", *(trimmed(F.col(c)).alias(c) for c in ("code", "name", "description")))
    first = F.min_by(F.struct("name", "description"), F.struct("source_path", "pos"))
    return clean.groupBy("code").agg(first.alias("f")).select("code", "f.name", "f.description")
