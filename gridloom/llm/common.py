"""What the operators share: the scratch folder, written tables, joins with hot keys, row digests, and word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case and lower-case letters that count as equal, and white space between words.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: A key with one of so many parts of all rows or more is hot. There are so many hot keys at most.
HOT_KEYS = 1000
#: Rows that a task passes to Python at once.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.setdefault(sc.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='shared-')}"
        _LOCAL[sc.applicationId] = base
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


#: Folders of the scratch scopes that are open, the innermost last; and the folder that a local application without a shared one uses.
_SCOPES: list[str] = []
_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's scratch tables."""
    return f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, within the innermost scope."""
    return f"{_SCOPES[-1] if _SCOPES else scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Within, scratch tables lie in a folder of their own, which this gives: it may be deleted when nothing reads them any more."""
    _SCOPES.append(scratch_path(spark, "scope"))
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read again: later work starts from those files."""
    return written_at(df, name)[0]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, tasks pass rows to Python in batches of BATCH_ROWS at most: whole texts are long, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = int(before)
    spark.conf.set(key, BATCH_ROWS if rows <= 0 else min(rows, BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `written`, and the path, for whoever deletes it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Results that haven't been written or collected are lost with them."""
    deleted(spark, scratch_root(spark))


def hot_join(rows: DataFrame, groups: DataFrame, on: str | list[str], n: str, total: int) -> DataFrame:
    """`rows` joined with `groups`, which has one row a key, its rows in `rows` counted in column `n`.

    Keys with a thousandth of all `total` rows or more, a thousand keys at most, are broadcast, so that the rows of a hot
    key stay where they are. Both sides should be written tables.
    """
    names = [on] if isinstance(on, str) else on
    hot = groups.filter(F.col(n) * HOT_KEYS >= total)
    cold = groups.filter(F.col(n) * HOT_KEYS < total)
    near = rows.join(F.broadcast(hot), on)
    return near.unionByName(rows.join(F.broadcast(hot.select(*names)), on, "left_anti").join(cold, on))


def row_hashes(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Two 64-bit hashes of a row, over all columns or some: together they stand for what the row holds."""
    parts = [F.lit(0)]
    for c, kind in df.dtypes:
        if columns is None or c in columns:
            parts.append(F.to_json(F.col(f"`{c}`")) if "map<" in kind or "variant" in kind else F.col(f"`{c}`"))
            parts.append(F.col(f"`{c}`").isNull())  # a null alone would leave the hash as it is
    return [F.xxhash64(F.lit(k), *parts[1:]) for k in (1, 2)]


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z only in lower case. A text of ASCII alone takes Spark's fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_names(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """`docs` with its columns named c0, c1, ... in order, so that no name of its own meets one of ours."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def place_of(docs: DataFrame, column: str) -> str:
    """The plain name of a column."""
    return f"c{docs.columns.index(column)}"
