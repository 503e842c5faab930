"""Token-id files in Simple-8b.

A 64-bit word holds a 4-bit selector and 60 bits of payload: `COUNTS[s]` ids of `WIDTHS[s]` bits each, the first in
the lowest bits. Selector 15 is the escape: one id too wide for the shared slots. Ids are coded in blocks of
`BLOCK` ids; a file keeps each block's first word, so that blocks decode alone, and decoding a block takes one array
operation for each selector in it.

File: magic, words (little-endian), block offsets (u64), documents' lengths (u64), documents' ids (i64), whether an
id is null (u8), then a fixed footer: ids, blocks, documents (u64 each), magic.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import scratch_path, small_batches
from gridloom.llm.tokens import encoder as shared_encoder

#: Ids in a word and bits for each, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
MAGIC = b"S8BTOK01"
BLOCK = 1 << 16
#: Ids after which a writer begins its next file: about 10 MB.
FILE_IDS = 4 << 20
FOOTER = struct.Struct("<QQQ8s")


def encode_block(ids: np.ndarray) -> np.ndarray:
    """The words of up to BLOCK ids (unsigned, below 2^60)."""
    ids = ids.astype(np.uint64)
    if not len(ids):
        return np.empty(0, np.uint64)
    if int(ids.max()) >> 60:
        raise ValueError("an id needs more than 60 bits")
    n = len(ids)
    bits = np.zeros(n, np.uint8)
    for k in range(int(ids.max()).bit_length()):
        bits += ids >= np.uint64(1 << k)
    # widest[c][i]: bits of the widest of the c ids from i; windows that pass the end see ids of 0 bits
    power, windows = {1: bits}, {}
    c = 1
    while 2 * c <= COUNTS[0]:
        left = power[c]
        power[2 * c] = np.maximum(left, np.concatenate([left[c:], np.zeros(min(c, n), np.uint8)])[:n])
        c *= 2
    for count in COUNTS:
        p = 1 << (count.bit_length() - 1)
        left, shift = power[p], count - p
        windows[count] = left if not shift else np.maximum(left, np.concatenate([left[shift:], np.zeros(min(shift, n), np.uint8)])[:n])
    chosen = np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):
        chosen[windows[COUNTS[s]] <= WIDTHS[s]] = s
    step = np.array(COUNTS)[chosen].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    selector = chosen[starts]
    words = selector.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(COUNTS[0], np.uint64)])
    for s in range(2, 16):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            slots = padded[starts[rows][:, None] + np.arange(COUNTS[s])]
            words[rows] |= np.bitwise_or.reduce(slots << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])), axis=1)
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids in a block's words."""
    selector = (words >> np.uint64(60)).astype(np.intp)
    counts = np.array(COUNTS)[selector]
    begins = np.cumsum(counts) - counts
    out = np.zeros(n + COUNTS[0], np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            width = np.uint64(WIDTHS[s])
            slots = (words[rows][:, None] >> (np.arange(COUNTS[s], dtype=np.uint64) * width)) & np.uint64((1 << WIDTHS[s]) - 1)
            out[begins[rows][:, None] + np.arange(COUNTS[s])] = slots
    return out[:n]


def pack_file(ids: np.ndarray, lengths: list[int], doc_ids: list[int | None]) -> bytes:
    """A whole file: the ids of its documents, one after the other."""
    blocks = [encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.empty(0)
    parts = [MAGIC, *(b.astype("<u8").tobytes() for b in blocks), offsets.astype("<u8").tobytes(), np.array(lengths, "<u8").tobytes()]
    parts += [np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes()]
    return b"".join([*parts, FOOTER.pack(len(ids), len(blocks), len(doc_ids), MAGIC)])


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """The ids, the documents' lengths and the documents' ids of a file."""
    n, blocks, docs, magic = FOOTER.unpack(data[-FOOTER.size :])
    if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    tail = len(data) - FOOTER.size - 17 * docs - 8 * blocks
    words = np.frombuffer(data, "<u8", (tail - len(MAGIC)) // 8, len(MAGIC))
    offsets = np.append(np.frombuffer(data, "<u8", blocks, tail).astype(np.intp), len(words))
    lengths = np.frombuffer(data, "<u8", docs, tail + 8 * blocks).astype(np.int64)
    doc_ids = np.frombuffer(data, "<i8", docs, tail + 8 * blocks + 8 * docs).tolist()
    null = np.frombuffer(data, "u1", docs, tail + 8 * blocks + 16 * docs)
    ids = [decode_block(words[offsets[k] : offsets[k + 1]], min(BLOCK, n - k * BLOCK)) for k in range(blocks)]
    return np.concatenate(ids) if ids else np.empty(0, np.uint64), lengths, [None if z else x for x, z in zip(doc_ids, null, strict=True)]


def _store(path: str, name: str, data: bytes) -> None:
    """Write a file under a name of this attempt, then give it its own name: readers see whole files only."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(part := f"{root}/.{name}.{uuid.uuid4().hex}") as out:
        out.write(data)
    files.move(part, f"{root}/{name}")


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write their ids, each document's closed by `end_id`, in ascending order of the id column.

    `path` gets files part-PPPPPP-FFFFFF.s8b, whose names sort as their documents do, and a table `path`/manifest with
    each file's documents and ids. A task that runs again writes the same files again.

    Cases: a null or empty text is the end id alone; a null id sorts first; rows of one id stay together, in the order
    of their texts' hash. No rows give an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        part, said, total = TaskContext.get().partitionId(), [], 0
        held: list[bytes] = []
        lengths: list[int] = []
        names: list[int | None] = []

        def close() -> None:
            name = f"part-{part:06d}-{len(said):06d}.s8b"
            ids = np.frombuffer(b"".join(held), "<u4")
            _store(f"{path}/ids", name, pack_file(ids, lengths, names))
            said.append((name, len(names), len(ids)))
            for x in (held, lengths, names):
                x.clear()

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                held.append(ids + end)
                lengths.append(len(ids) // 4 + 1)
                names.append(name)
                total += lengths[-1]
                if total >= FILE_IDS:
                    close()
                    total = 0
        if names:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in said], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "docs", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(write, "file string, docs long, ids long").write.parquet(f"{path}/manifest")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids (array), ids_crc32."""
    return _read(spark, path, True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As `read_ids`, without the ids themselves."""
    return _read(spark, path, False)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int64()))] * with_ids])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, lengths, doc_ids = unpack_file(data.as_py())
                raw, ends = ids.astype("<u4"), np.cumsum(lengths)
                crcs = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                step = 20_000 if not with_ids else 500
                for k in range(0, len(doc_ids), step):
                    of = slice(k, k + step)
                    cols = [[name] * len(doc_ids[of]), doc_ids[of], (ends - lengths)[of], lengths[of], crcs[of]]
                    if with_ids:
                        cols.append([ids[e - n : e].tolist() for e, n in zip(ends[of].tolist(), lengths[of].tolist(), strict=True)])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    manifest = spark.read.parquet(f"{path}/manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    begins = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("begin"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(f"{path}/ids")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    ddl = "file string, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = files.mapInArrow(read, ddl).join(begins, "file")
    return rows.select("doc_id", (F.col("begin") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write `docs` as ids to the shared folder and read what the files say of each document."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer_path)
    return read_digests(docs.sparkSession, path)
