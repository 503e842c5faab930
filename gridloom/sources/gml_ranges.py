"""A data source that reads large CityGML files by byte ranges.

A file is dealt to tasks by ranges of `split_bytes`. A task owns the members (`cityObjectMember`) that begin in its range: it
looks for the first of them, and reads on to the first one after its range. What stands before the first member, and files
without members, belong to the range at 0. Every range is parsed under the file's own beginning (declaration and root tag), member
by member, so that a task holds one member's elements at a time.

A file's reference system is that of its root, else of its first envelope. Where the part before the first member names none,
each of the file's tasks searches the file for an envelope. Ranges need an encoding that writes `<` as one byte; files that begin with
a UTF-16 mark are read by one task. A member's tag inside a comment or CDATA is taken for a member, and ends in an error
of the parser; `split_bytes` 0 reads such files whole, and cuts nothing.

Filters on `file_tile_id` (equal to, one of) are pushed down where the session allows it (spark.sql.python.filterPushdown.enabled), and
only their files are opened then; the option `tiles` does the same.
"""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from codecs import getincrementaldecoder
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.sax.saxutils import unescape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# Namespaces of GML and of CityGML's buildings, and how a member of a city model begins.
GML = "{http://www.opengis.net/gml}"
BLDG = "{http://www.opengis.net/citygml/building/2.0}"
MEMBER = re.compile(rb"<(?:[A-Za-z_][\w.-]*:)?cityObjectMember[\s>/]")
ENVELOPE = re.compile(rb"<(?:[A-Za-z_][\w.-]*:)?Envelope\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\bsrsName\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
ROOT_TAG = re.compile(rb"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
PROLOG = re.compile(rb"(?s)(?:\xef\xbb\xbf)?(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>)*")
SRS = re.compile(r"\ssrsName\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
ENCODING = re.compile(rb"(?:\xef\xbb\xbf)?<\?xml[^>]*?\sencoding\s*=\s*[\"']([\w.-]+)")
#: Encodings that the parser reads itself; others are decoded first.
KNOWN = re.compile("(?i)utf-?8|utf-?16|(us-)?ascii|iso-8859-[0-9]+|windows-125[0-9]")
UTF_16 = (b"\xff\xfe", b"\xfe\xff")
TILE = re.compile(r"(?<![0-9])[0-9]{8}(?![0-9])")

SCHEMA = "source_path string, file_tile_id string, srs_name string, building_id string, name string, pos_list string, dimension int"
FIELDS = pa.schema([(n, pa.int32() if k == "int" else pa.string()) for n, k in (x.split() for x in SCHEMA.split(", "))])
SPLIT_BYTES = 64 << 20
#: Bytes read at once, and looked at again so that a tag on the border is seen; rows and characters of rings in a batch.
CHUNK, BORDER = 1 << 20, 256
BATCH_ROWS, BATCH_CHARS = 10_000, 16 << 20


def tile_of(path: str) -> str | None:
    """The first run of eight digits that stands alone in a file's name."""
    found = TILE.search(re.sub(r"\.[^.]*$", "", re.sub(r"^.*[/\\]", "", path)))
    return found[0] if found else None


def _whole(value: str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


@dataclass
class Beginning:
    """A file up to the end of its root tag, that tag's name and system, whether the file can be cut, and the codec of what the parser doesn't know."""

    prefix: bytes
    root: str
    srs: str | None
    cut: bool
    codec: str | None


def beginning(f: BinaryIO) -> Beginning:
    f.seek(0)
    read = f.read(CHUNK)
    if read[:2] in UTF_16:
        for _, e in ET.iterparse(f_from(f), events=("start",)):
            return Beginning(b"", e.tag, e.get("srsName"), False, None)
    while (tag := ROOT_TAG.match(read, PROLOG.match(read).end())) is None:
        more = f.read(CHUNK)
        if not more:
            ET.fromstring(read)  # says what is wrong
            raise ET.ParseError("no root element")
        read += more
    named = ENCODING.match(read)
    codec = named[1].decode() if named and not KNOWN.fullmatch(named[1].decode()) else None
    text = tag[0].decode(codec or (named[1].decode() if named else "utf-8"))
    name = re.match(r"<([^\s/>]+)", text)[1]
    found = SRS.search(text)
    srs = unescape(found[1] or found[2] or "", {"&quot;": '"', "&apos;": "'"}) if found else None
    return Beginning(read[: tag.end()], name, srs, not tag[0].endswith(b"/>"), codec)


def f_from(f: BinaryIO) -> BinaryIO:
    f.seek(0)
    return f


def first_envelope(f: BinaryIO) -> str:
    """The system of a file's first envelope that names one; else the empty text."""
    f.seek(0)
    held = b""
    while more := f.read(CHUNK):
        held += more
        if found := ENVELOPE.search(held):
            return unescape((found[1] or found[2] or b"").decode("utf-8", "replace"), {"&quot;": '"', "&apos;": "'"})
        held = held[-8 * BORDER :]
    return ""


def pieces(f: BinaryIO, start: int, end: int, body: int) -> Iterator[tuple[int, bytes, bool]]:
    """(place, bytes, whether more follows): what the range [start, end) owns, cut where members begin. `body`: where the root tag ends."""
    at = max(start, body)
    f.seek(at)
    held, base = b"", at  # bytes not given out yet, and their place
    own = body if start == 0 else None  # where the piece in hand begins; None: not ours yet
    looked = 0
    while True:
        more = f.read(CHUNK)
        held += more
        for found in MEMBER.finditer(held, looked):
            place = base + found.start()
            if own is not None and place > own:
                yield own, held[own - base : place - base], True
            if place >= end:
                return
            own = place
        if not more:
            if own is not None:
                yield own, held[own - base :], False
            return
        # keep the piece in hand, and what may be the beginning of a tag
        keep = max(0, len(held) - BORDER) if own is None else own - base
        looked = max(0, len(held) - BORDER - keep)
        if own is not None and looked == 0:
            looked = 1 if held[keep : keep + 1] == b"<" else 0
        held, base = held[keep:], base + keep


def buildings(path: str, f: BinaryIO, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA: the buildings that a range of a file owns, with the ring of their first polygon.

    A building without an id gets one from its file, its place in it, and its ring: the same however a file is cut (in a file that
    isn't cut, the place is the number of buildings before it).
    """
    head = beginning(f)
    whole = end is None or not head.cut
    if whole and start > 0:
        return
    srs = head.srs if head.srs is not None else first_envelope(f)
    pull = ET.XMLPullParser(events=("start", "end"))
    if whole:
        f.seek(0)
        parts = ((0, more, False) for more in iter(lambda: f.read(CHUNK), b""))
    else:
        parts = pieces(f, start, end, len(head.prefix))
    decoder = getincrementaldecoder(head.codec)() if head.codec else None
    decoded = (lambda x: decoder.decode(x)) if decoder else (lambda x: x)
    if not whole:
        pull.feed(decoded(head.prefix))
    tile, tops = tile_of(path), []
    place = count = depth = 0

    def read() -> Iterator[tuple]:
        nonlocal count, depth
        for event, e in pull.read_events():
            if event == "start":
                depth += 1
                if depth <= 1:
                    tops.append(e)
                continue
            depth -= 1
            if e.tag == BLDG + "Building":
                polygon = next(e.iter(GML + "Polygon"), None)
                ring = next(polygon.iter(GML + "LinearRing"), None) if polygon is not None else None
                places = ring.find(GML + "posList") if ring is not None else None
                if places is not None:
                    text, name = "".join(places.itertext()), e.find(GML + "name")
                    own = e.get(GML + "id") or hashlib.sha256(f"{path}|{place}|{count}|{text}".encode()).hexdigest()[:32]
                    yield path, tile, srs, own, "".join(name.itertext()) if name is not None else "Building", text, _whole(places.get("srsDimension"))
                    count += 1
                e.clear()
            if depth == 1 and tops:
                tops[0].clear()  # a member that has been read

    more = None
    for at, part, more in parts:
        if not whole:
            place, count = at, 0
        pull.feed(decoded(part))
        pull.flush()
        yield from read()
    if more:
        pull.feed(f"</{head.root}>")  # the range ends before the file does
    if more is not None:
        pull.close()
        yield from read()
    elif start == 0:
        raise ET.ParseError(f"nothing in {path} after its root tag")


def batched(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA as batches of bounded size."""
    held, chars = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), FIELDS.types, strict=True)], schema=FIELDS)
    for row in rows:
        held.append(row)
        chars += len(row[5])
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield made()
            held, chars = [], 0
    if held:
        yield made()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None


class GmlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        tiles = options.get("tiles")
        self.tiles = None if tiles is None else {t.strip() for t in tiles.split(",")}

    def only(self, tiles: set[str]) -> None:
        self.tiles = tiles if self.tiles is None else self.tiles & tiles

    def partitions(self) -> list[Range]:
        fs, path = _filesystem(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        out: list[Range] = []
        for x in sorted((x for x in files if x.type == pafs.FileType.File and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
            if self.tiles is None or tile_of(x.path) in self.tiles:
                step = self.split if self.split > 0 else x.size
                out += [Range(x.path, at, at + step if self.split > 0 else None) for at in range(0, max(x.size, 1), max(step, 1))]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            fs, _ = _filesystem(self.path)
            with fs.open_input_file(partition.path) as f:
                yield from batched(buildings(partition.path, f, partition.start, partition.end))


class PushingGmlReader(GmlReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for x in filters:
            if isinstance(x, EqualTo) and x.attribute == ("file_tile_id",):
                self.only({x.value})
            elif isinstance(x, In) and x.attribute == ("file_tile_id",):
                self.only(set(x.value))
            else:
                yield x


class GmlSource(DataSource):
    """Format `citygml`. Options: path, split_bytes, tiles (ids separated by commas), pushdown."""

    @classmethod
    def name(cls) -> str:
        return "citygml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PushingGmlReader(self.options) if self.options.get("pushdown") == "true" else GmlReader(self.options)
