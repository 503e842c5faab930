"""A Merkle manifest of a dataset: every row a leaf, a tree for each group, and a tree over the groups' roots.

A tree grows level by level. A window over (tree, place of the parent), ordered by place and over its whole frame, collects the
digests of a run; that list is the parent's preimage and holds each member's siblings. Each run's first member then stands for
the parent, so that the next level has one row a parent. Levels are written, and lineage ends there. Proofs are put together on
the way down: a node's proof is its siblings and its parent's proof. A window holds `fan` rows, a join `fan` children, whatever
the groups' sizes, and places within a group come from offsets of range partitions, so that a group with most rows is as good as any other.

A digest is a SHA-256; preimages hold digests as lower-case hex. A field of a leaf is `-` if null, else its number of UTF-8 bytes, `:`, and its text.

Cases: rows with equal keys (or null ones, which come first) go by their leaves, and equal leaves are interchangeable. A null group is a group, and the first;
groups go by their UTF-8 bytes. A group of one row has its leaf as root. Very long texts are hashed whole. No rows give no rows. Columns that aren't fields
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import written
from gridloom.llm.order import in_order, numbered

#: Fixed value: bytes of a digest.
DIGEST = 32
#: Levels that a job goes down before their paths are written.
JOINED = 4
PATH = "array<struct<pos: int, siblings: binary>>"


def field(value: Column) -> Column:
    """One field of a leaf's preimage."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """A leaf's digest in hex."""
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def fold(digest: Column, path: Column) -> Column:
    """The root in hex that a leaf's digest and its path (positions and siblings, upwards) lead to."""

    def up(d: Column, step: Column) -> Column:
        cut = step["pos"] * DIGEST
        before, after = F.substring(step["siblings"], F.lit(1), cut), F.substring(step["siblings"], cut + 1, F.octet_length(step["siblings"]))
        return F.sha2(F.concat(hexed(before), d, hexed(after)).cast("binary"), 256)

    return F.aggregate(path, digest, up)


def siblings_of(path: Column) -> Column:
    """The digests of a path's siblings in hex, one after the other."""
    return F.array_join(F.transform(path, lambda s: hexed(s["siblings"])), "")


@dataclass
class Manifest:
    """`proofs`: a row for each leaf with `key`, `leaf`, `subroot` (hex), `path`, and the columns carried. `root`: hex, None without rows."""

    proofs: DataFrame
    root: str | None


def _grown(nodes: DataFrame, most: int, fan: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of trees from `nodes` (tree, idx, n, digest, and more for leaves); the largest tree has `most`. Also each level's finished trees (tree, digest)."""
    run = Window.partitionBy("tree", F.floor(F.col("idx") / fan)).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = [F.get("run", F.lit(i)) for i in range(fan)]
    none = F.lit(b"")
    others = F.concat(*(F.when(F.col("pos") == i, none).otherwise(F.coalesce(m, none)) for i, m in enumerate(member)))
    preimage = F.concat(*(F.coalesce(hexed(m), F.lit("")) for m in member)).cast("binary")
    levels, tops = [], [nodes.filter("n = 1").select("tree", "digest")]
    while most > 1:
        level = nodes.filter("n > 1").withColumn("run", F.collect_list("digest").over(run)).withColumn("pos", (F.col("idx") % fan).cast("int"))
        first = F.when(F.col("pos") == 0, F.unhex(F.sha2(preimage, 256)))
        level = written(level.withColumn("siblings", others).withColumn("parent", first).drop("run"), "merkle-level")
        levels.append(level)
        # a run's first member stands for its parent
        nodes = level.filter("pos = 0").select("tree", F.floor(F.col("idx") / fan).alias("idx"), F.floor((F.col("n") + fan - 1) / fan).alias("n"), F.col("parent").alias("digest"))
        tops.append(nodes.filter("n = 1").select("tree", "digest"))
        most = -(-most // fan)
    return levels, tops


def _descended(levels: list[DataFrame], tops: dict[int, DataFrame], fan: int) -> DataFrame:
    """Nodes of the lowest level with their paths. `tops` has the roots of each height (tree, subroot, path)."""
    paths = tops[len(levels)].withColumn("idx", F.lit(0).cast("long"))
    for k in range(len(levels) - 1, -1, -1):
        step = F.array(F.struct("pos", "siblings"))
        above = paths.select("tree", F.col("idx").alias("up"), "subroot", F.col("path").alias("rest"))
        paths = levels[k].withColumn("up", F.floor(F.col("idx") / fan)).join(above, ["tree", "up"]).withColumn("path", F.concat(step, "rest")).drop("up", "rest", "pos", "siblings", "parent")
        if k:
            paths = paths.select("tree", "idx", "subroot", "path")
            if k in tops:
                paths = paths.unionByName(tops[k].select("tree", F.lit(0).cast("long").alias("idx"), "subroot", "path"))
            if (len(levels) - k) % JOINED == 0:
                paths = written(paths, "merkle-paths")
    return paths


def manifest(rows: DataFrame, key: str, group: str, fields: list[str], fan: int = 2, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of `rows`. `carry`: further columns of the proofs, as expressions over `rows`."""
    carry = carry or {}
    own = lambda c: F.col(f"`{c}`")
    tree = F.coalesce(F.concat(F.lit("="), own(group).cast("string")), F.lit(""))
    leaves = rows.select(own(key).alias("key"), tree.alias("tree"), F.unhex(leaf([own(c) for c in fields])).alias("digest"), *(e.alias(f"carry_{c}") for c, e in carry.items()))
    leaves = written(leaves.withColumn("uid", F.monotonically_increasing_id()), "merkle-leaves")
    placed = numbered(in_order(leaves, "merkle-order", "tree", F.col("key").asc_nulls_first(), "digest", "uid"), "tree").drop("uid")
    placed = written(placed, "merkle-placed")
    kept = [F.col("key"), hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), F.col("path"), *(F.col(f"carry_{c}").alias(c) for c in carry)]
    most = placed.agg(F.max("n")).first()[0]
    if most is None:
        return Manifest(placed.withColumn("subroot", F.col("digest")).withColumn("path", F.array().cast(PATH)).select(*kept), None)
    levels, tops = _grown(placed, most, fan)
    roots = tops[0].withColumn("height", F.lit(0))
    for k, t in enumerate(tops[1:], 1):
        roots = roots.unionByName(t.withColumn("height", F.lit(k)))
    # the tree over the groups' roots, in the groups' order
    roots = in_order(roots.withColumn("all", F.lit("")).withColumnRenamed("tree", "group"), "merkle-roots", "group")
    crowns = written(numbered(roots, "all").withColumnRenamed("all", "tree"), "merkle-crowns")
    upper, ends = _grown(crowns, crowns.count(), fan)
    root = ends[-1].first()["digest"]
    start = ends[-1].select("tree", F.col("digest").alias("subroot"), F.array().cast(PATH).alias("path"))
    over = _descended(upper, {len(upper): start}, fan) if upper else crowns.withColumn("path", F.array().cast(PATH))
    over = written(over.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "path", "height"), "merkle-tops")
    ended = {k: over.filter(F.col("height") == k).drop("height") for k in range(len(levels) + 1)}
    lone = placed.filter("n = 1").join(ended[0], "tree").select(*kept)
    proofs = _descended(levels, ended, fan).select(*kept).unionByName(lone) if levels else lone
    return Manifest(proofs, root.hex())
