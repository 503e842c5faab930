"""A sink for files that frame pieces of text: a head, pieces with a separator between them, a foot.

Tasks stream their pieces to staged files and close one when it holds `max_bytes`, or when the `file` column names another;
the commit moves the staged files to their names, and only those of tasks that succeeded. A job that fails leaves none.
A FeatureCollection is such a file, and so is a CityGML model. Files go to a folder that driver and executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MAX_BYTES = 128 << 20
# What stands around and between the features of a FeatureCollection.
GEOJSON = {"head": '{"type":"FeatureCollection","features":[', "separator": ",", "foot": "]}", "extension": "geojson"}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    #: (staged file, name) of each file that a task has closed.
    files: list[tuple[str, str]] = field(default_factory=list)


class FramedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.head, self.separator, self.foot = (options.get(k, "").encode() for k in ("head", "separator", "foot"))
        self.extension, self.most = options.get("extension", "txt"), int(options.get("max_bytes", MAX_BYTES))
        self.job = uuid.uuid4().hex

    def _staged(self) -> str:
        return f"{filesystem(self.path)[1].rstrip('/')}/_staged-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = filesystem(self.path)
        done, out, at, size, current = Written(), None, "", 0, None

        def close() -> None:
            out.write(self.foot)
            out.close()
            done.files.append((at, f"{current or at.rsplit('/', 1)[-1]}.{self.extension}"))

        for batch in iterator:
            names = batch.column(batch.schema.get_field_index("file")).to_pylist() if "file" in batch.schema.names else [None] * len(batch)
            for name, text in zip(names, batch.column(batch.schema.get_field_index("text")), strict=True):
                piece = text.as_py().encode()
                if out is not None and (name != current or (name is None and size + len(piece) > self.most)):
                    close()
                    out = None
                if out is None:
                    fs.create_dir(self._staged(), recursive=True)
                    at, size, current = f"{self._staged()}/{uuid.uuid4().hex}", 0, name
                    out = fs.open_output_stream(at)
                    out.write(self.head)
                elif self.separator:
                    out.write(self.separator)
                out.write(piece)
                size += len(piece)
        if out is not None:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = filesystem(self.path)
        new = [x for m in messages if m for x in m.files]
        names = [name for _, name in new]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one file must lie in one partition, together")
        fs.create_dir(path, recursive=True)
        old = [] if not self.overwrite else [x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.File]
        for staged, name in new:
            fs.move(staged, f"{path.rstrip('/')}/{name}")
        for x in old:
            if x.rsplit("/", 1)[-1] not in names:
                fs.delete_file(x)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        if fs.get_file_info(self._staged()).type != pafs.FileType.NotFound:
            fs.delete_dir(self._staged())


class FramedSink(DataSource):
    """Format `framed`: rows (text[, file]). Options: path, head, separator, foot, extension, max_bytes."""

    @classmethod
    def name(cls) -> str:
        return "framed"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return FramedWriter(self.options, overwrite)


def write_framed(rows: DataFrame, path: str, mode: str = "append", **options: str | int) -> None:
    """Write `rows` (text, and file if they name their files: then sorted by it within partitions that hold whole files)."""
    rows.sparkSession.dataSource.register(FramedSink)
    writer = rows.write.format("framed").mode(mode).option("path", path)
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.save()


def write_features(features: DataFrame, path: str, mode: str = "append", max_bytes: int = MAX_BYTES) -> None:
    """Write features (text: a GeoJSON feature a row) as FeatureCollection files of about `max_bytes` at most."""
    write_framed(features.select("text"), path, mode, max_bytes=max_bytes, **GEOJSON)


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The features of FeatureCollection files, one a row, with the fields of `schema`. A file is parsed by one task: `max_bytes` bounds it."""
    whole = spark.read.option("wholetext", True).text(path).selectExpr(f"from_json(value, 'type string, features array<struct<{schema}>>') AS c")
    return whole.selectExpr("inline(c.features)")
