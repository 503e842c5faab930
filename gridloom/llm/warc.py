"""A content-addressed WARC archive.

`write_archive` keeps each payload's bytes once, under its SHA-256, and the exact header bytes of every record apart.
`read_records` joins them back to the original records, byte for byte, after verifying each stored payload against the
digest it is filed under. `read_index` reads the rebuilt records as any reader of WARC files does: it cuts them at their
Content-Length, measures and digests the payloads in them, and looks up the records that revisits refer to.

Of records with equal payloads of at least `min_revisit` bytes, that with the largest id is a `response` (rows that repeat that id are
all responses); the others are `revisit` records that refer to it. Shorter payloads are stored once too, but all their records are responses.

Payload bytes that surely occur once are stored without a shuffle (a Bloom filter of the digests tells), and shuffle once to
be joined with their headers; a short payload that a thousandth of all records have is
broadcast instead (a thousand payloads below `min_revisit` bytes at most). Longer ones have one response each, but for rows that repeat an id.

Cases: a null payload is empty, a null url leaves its header out, line ends in a url are percent-encoded. A null id
loses to any other, and leaves its header out. Repeated rows are records of their own: every record has its own
WARC-Record-ID, whatever its page's id. Very long payloads are kept whole. No rows give no records. Columns beside id, url
and payload are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bloom
from gridloom.llm.common import HOT_KEYS, hot_join, scratch_path, written

#: Payloads below this many bytes are never revisits.
MIN_REVISIT = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _headers(date: str) -> tuple[Column, Column]:
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _line("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    response = F.col("record_type") == "response"
    urn = lambda c: F.concat(F.lit("<urn:x-record:"), c.cast("string"), F.lit(">"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", urn(F.col("record_no"))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        _line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(~response, F.concat(_line("WARC-Refers-To", urn(F.col("original"))), F.lit(f"WARC-Profile: {PROFILE}{CRLF}"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", (F.octet_length("http") + F.when(response, F.col("bytes")).otherwise(0)).cast("string")),
        F.lit(CRLF),
    )
    return http, warc


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write `pages` as two tables: `path`/payloads (sha256, payload, records) and `path`/headers (sha256, warc, http).

    `records` is the number of responses that a payload is in.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    facts = [F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")]
    # a record's number is fixed once it is written
    rows = written(base.select("page_id", "url", *facts).withColumn("record_no", F.monotonically_increasing_id()), "records")
    first = F.struct("page_id", (-F.col("record_no")).alias("no"))
    chosen = rows.groupBy("sha256").agg(F.max(first).alias("top"), F.count(F.lit(1)).alias("n")).select("sha256", "n", F.col("top.page_id").alias("chosen"), (-F.col("top.no")).alias("original"))
    total = rows.count()
    named = hot_join(rows, written(chosen, "chosen"), "sha256", "n", total)
    http, warc = _headers(date)
    (
        named.withColumn("record_type", F.when((F.col("bytes") < min_revisit) | F.col("page_id").eqNullSafe(F.col("chosen")), "response").otherwise("revisit"))
        .withColumn("http", http)
        .withColumn("warc", warc)
        .select("sha256", F.encode("warc", "UTF-8").alias("warc"), F.encode("http", "UTF-8").alias("http"), (F.col("record_type") == "revisit").alias("revisit"))
        .write.parquet(f"{path}/headers")
    )
    # payloads that surely occur once are stored where they are; the others meet, pre-aggregated
    slots = bloom.slots_for(total)
    marked = written(bloom.marks(rows.select(F.xxhash64("sha256").alias("h")), slots, 2), "marks")
    payloads = base.select(F.sha2("payload", 256).alias("sha256"), "payload").withColumn("h", F.xxhash64("sha256"))
    straight, maybe = bloom.parted(payloads, marked, "h", slots)
    stored = maybe.groupBy("sha256").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("records"))
    stored = stored.withColumn("records", F.when(F.octet_length("payload") < min_revisit, F.col("records")).otherwise(1))
    straight.select("sha256", "payload", F.lit(1).cast("long").alias("records")).unionByName(stored).write.parquet(f"{path}/payloads")


def _verified(payloads: DataFrame) -> Column:
    """The digest that a payload is filed under, once its bytes have been checked against it."""
    return F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("sha256"))))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """`record`: every record's original bytes, header, block and the two line ends that close it."""
    payloads = spark.read.parquet(f"{path}/payloads")
    headers = spark.read.parquet(f"{path}/headers")
    responses = headers.filter("NOT revisit")
    # the payloads that many records have are short; their rows stay where they are
    often = F.col("records") * HOT_KEYS >= responses.count()
    hot = payloads.filter((F.col("records") > 1) & often)
    hot_ids = F.broadcast(hot.select("sha256"))
    checked = lambda p: p.select(_verified(p).alias("sha256"), "payload")
    near = responses.join(F.broadcast(checked(hot)), "sha256")
    rest = responses.join(hot_ids, "sha256", "left_anti").join(checked(payloads.filter((F.col("records") == 1) | ~often)), "sha256")
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    full = near.unionByName(rest).select(F.concat("warc", "http", "payload", end).alias("record"))
    return full.unionByName(headers.filter("revisit").select(F.concat("warc", "http", end).alias("record")))


def _field(head: Column, name: str) -> Column:
    value = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def _error(of: str, row: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{of}: record "), F.coalesce(row, F.lit("without an id"))))


def parsed_records(records: DataFrame) -> DataFrame:
    """What each record's own bytes say: record_id, page_id, record_type, refers_to_id, target_uri, said (its digest), payload_bytes, and payload_digest of responses."""
    blank = CRLF * 2
    head = F.substring_index(F.col("record").cast("string"), blank, 1)
    rows = records.select("record", head.alias("head"))
    length, begin = _field(F.col("head"), "Content-Length").cast("int"), F.octet_length("head") + 4
    rows = rows.withColumn("block", F.substring("record", begin + 1, length))
    whole = (F.octet_length("record") == begin + length + 4) & (F.substring("record", begin + length + 1, F.lit(4)) == F.encode(F.lit(blank), "UTF-8"))
    http = F.substring_index(F.col("block").cast("string"), blank, 1)
    rows = rows.withColumn("http", http).withColumn("payload", F.expr("substring(block, octet_length(http) + 5)"))
    says = _field(F.col("http"), "Content-Length").cast("long")
    rows = rows.select(
        _field(F.col("head"), "WARC-Record-ID").alias("record_id"),
        _field(F.col("head"), "X-Page-ID").cast("long").alias("page_id"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        _field(F.col("head"), "WARC-Refers-To").alias("refers_to_id"),
        _field(F.col("head"), "WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "").alias("said"),
        says.alias("payload_bytes"),
        F.octet_length("payload").cast("long").alias("found"),
        F.sha1("payload").alias("sha1"),
        whole.alias("whole"),
    )
    response = F.col("record_type") == "response"
    good = F.col("whole") & F.when(response, (F.col("found") == F.col("payload_bytes")) & (F.col("sha1") == F.col("said"))).otherwise(F.col("found") == 0)
    checked = F.when(good, F.col("record_id")).otherwise(_error("header and bytes differ", F.col("record_id")))
    return rows.select(checked.alias("record_id"), "page_id", "record_type", "refers_to_id", "target_uri", "said", "payload_bytes", F.when(response, F.col("sha1")).alias("payload_digest"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What the rebuilt records say: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    A response's bytes and digest are measured on its payload; a revisit's are those of the response that it refers to. A
    header that says otherwise is an error, and so is a revisit of what isn't there.
    """
    rows = written(parsed_records(read_records(spark, path)), "records-read")
    responses, revisits = rows.filter("record_type = 'response'"), rows.filter("record_type = 'revisit'")
    asked = revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n"))
    facts = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), "payload_digest")
    asked = written(asked.join(facts, "refers_to_id", "left"), "revisited")
    met = hot_join(revisits.drop("payload_digest"), asked, "refers_to_id", "n", revisits.count())
    same = (F.col("said") == F.col("payload_digest")) & (F.col("payload_bytes") == F.col("bytes"))
    met = met.withColumn("payload_digest", F.when(same, F.col("payload_digest")).otherwise(_error("revisit and response differ", F.col("record_id"))))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(met.select(*columns))


def archived(pages: DataFrame) -> DataFrame:
    """Write `pages` to a new archive in the shared folder and read its index back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    return read_index(spark, path)
