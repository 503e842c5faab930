"""Keyed tables that change by commits: staged folders, published by one manifest, read by what manifests name.

A commit writes the changes of all its tables to folders of their own, then puts one small manifest, named by its version,
where none stands yet. Readers see the folders that the latest manifest names: a job that dies halfway shows nothing, a commit id that
has been published adds nothing when it runs again, and of two writers that started from one version the second gets
`CommitConflict`. Publishing is as atomic as the file system's rename to a name that is free (HDFS's is).

A table is a log-structured merge: every commit adds a delta, partitioned into buckets of the key's hash; of a key's rows the last wins, by
(version, seq); a row marked `deleted` removes its key. `compact` merges the deltas into one folder, and publishes that by the same
protocol. Tables named in `logs` keep all their rows. Reading takes the last row by partial maxima, so that a key with
very many changes isn't sorted in one task. A key that is null or blank is an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import blank

ROWS = "key string, version long, seq long, value string, deleted boolean, bucket int"
#: Commit ids that a manifest remembers: a commit may be repeated while as many others are published.
REMEMBERED = 1000


class CommitConflict(RuntimeError):
    """Another writer has published first."""


@dataclass(frozen=True)
class Snapshot:
    """Version 0 is the empty store. `tables`: the folders of each; `ids`: versions of the last commits."""

    version: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)


class KeyedStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, logs: tuple[str, ...] = ()):
        self.spark, self.root, self.buckets, self.logs = spark, root.rstrip("/"), buckets, logs

    # --- files ---

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        fs, path = self._fs(), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _put_new(self, name: str, text: str) -> bool:
        """Put a file where none is; False if there is one."""
        jvm, fs = self.spark._jvm, self._fs()
        staged, final = self._path(f"_staged/{uuid.uuid4().hex}"), self._path(name)
        out = fs.create(staged, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(final.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, final, plain)
        except Exception as e:  # noqa: BLE001  py4j gives the Java class as text
            fs.delete(staged, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def _read_text(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    # --- commits ---

    def snapshot(self, version: int | None = None) -> Snapshot:
        """What has been published, up to now or to a version."""
        if version is None:
            published = [int(n.removesuffix(".json")) for n in self._listed("_commits") if n.endswith(".json") and not n.startswith(".")]
            version = max(published, default=0)
        return Snapshot(**json.loads(self._read_text(f"_commits/{version:020d}.json"))) if version else Snapshot()

    def _publish(self, base: Snapshot, commit_id: str, tables: dict[str, list[str]]) -> int:
        version = base.version + 1
        ids = dict(list(base.ids.items())[-REMEMBERED + 1 :]) | {commit_id: version}
        if not self._put_new(f"_commits/{version:020d}.json", json.dumps({"version": version, "tables": tables, "ids": ids})):
            won = self.snapshot()
            if commit_id in won.ids:
                return won.ids[commit_id]
            raise CommitConflict(f"version {version} has been published by another writer")
        return version

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _stage(self, name: str, rows: DataFrame, version: int) -> str:
        folder = f"{name}/{version:020d}-{uuid.uuid4().hex}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, commit_id: str, changes: dict[str, DataFrame], base: Snapshot | None = None) -> int:
        """Publish `changes` (table: rows of key, value, and seq and deleted where they have them) as one. The version they have.

        With `base`, nothing may have been published since that snapshot was taken.
        """
        now = self.snapshot()
        if commit_id in now.ids:
            return now.ids[commit_id]
        if base is not None and base.version != now.version:
            raise CommitConflict(f"version {now.version} has been published since version {base.version}")
        version, tables = now.version + 1, dict(now.tables)
        for name, rows in changes.items():
            key = F.when(blank(F.col("key").cast("string")), F.raise_error(F.lit("a key is blank")).cast("string")).otherwise(F.col("key").cast("string"))
            given = lambda c, other: F.coalesce(F.col(c), other) if c in rows.columns else other  # noqa: B023, E731
            rows = rows.select(key.alias("key"), F.lit(version).cast("long").alias("version"), given("seq", F.lit(0).cast("long")).cast("long").alias("seq"), F.col("value").cast("string").alias("value"), given("deleted", F.lit(False)).alias("deleted"))
            tables[name] = [*tables.get(name, []), self._stage(name, rows.withColumn("bucket", self._bucket(F.col("key"))), version)]
        return self._publish(now, commit_id, tables)

    # --- reading ---

    def rows(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """All rows of a table that have been published and not been merged away."""
        folders = (snapshot or self.snapshot()).tables.get(name, [])
        if not folders:
            return self.spark.createDataFrame([], ROWS)
        # every folder is a root of its own partitions
        out = self.spark.read.schema(ROWS).parquet(f"{self.root}/{folders[0]}")
        for folder in folders[1:]:
            out = out.unionByName(self.spark.read.schema(ROWS).parquet(f"{self.root}/{folder}"))
        return out

    def _last(self, rows: DataFrame) -> DataFrame:
        order = F.struct("version", "seq", "value")
        last = rows.groupBy("key").agg(F.max_by(F.struct("version", "seq", "value", "deleted"), order).alias("r"))
        return last.filter("NOT r.deleted").select("key", "r.version", "r.seq", "r.value")

    def read(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """key, version, seq, value: the last row of each key."""
        return self._last(self.rows(name, snapshot))

    def get(self, name: str, keys: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """The last rows of some keys (a column `key`): buckets without any of them aren't opened where the keys are few."""
        wanted = keys.select(F.col("key").cast("string").alias("key")).distinct().withColumn("bucket", self._bucket(F.col("key")))
        return self._last(self.rows(name, snapshot).join(wanted, ["bucket", "key"], "left_semi"))

    def exists(self, name: str, keys: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """`keys` with a column `stored`."""
        there = self.get(name, keys, snapshot).select(F.col("key").alias("stored_key"))
        return keys.join(there, F.col("key").cast("string") == F.col("stored_key"), "left").withColumn("stored", F.col("stored_key").isNotNull()).drop("stored_key")

    # --- upkeep ---

    def compact(self, *names: str) -> int:
        """Merge the deltas of some tables, or of all, into one folder each. The version that has them."""
        now = self.snapshot()
        version, tables = now.version + 1, dict(now.tables)
        for name in names or tuple(now.tables):
            rows = self.rows(name, now)
            if name not in self.logs:
                rows = self._last(rows).withColumn("deleted", F.lit(False)).withColumn("bucket", self._bucket(F.col("key")))
            tables[name] = [self._stage(name, rows.select(*(c.split()[0] for c in ROWS.split(", "))), version)]
        return self._publish(now, f"compact-{uuid.uuid4().hex}", tables)

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders of commits that were never published or have been merged away, but for those that the last `keep` versions name. How many."""
        now = self.snapshot()
        named = {f for v in range(max(1, now.version - keep + 1), now.version + 1) for folders in self.snapshot(v).tables.values() for f in folders}
        old = [f"{t}/{f}" for t in self._listed("") if not t.startswith(("_", ".")) for f in self._listed(t) if int(f.split("-")[0]) <= now.version]
        gone = [f for f in old if f not in named]
        for f in gone:
            self._fs().delete(self._path(f), True)
        return len(gone)
