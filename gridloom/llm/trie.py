"""A trie of conversations' prefixes, as a table of its distinct nodes with intervals in preorder.

Distinct conversations, as arrays of turn digests, are ranked lexicographically by a range partition. What a conversation shares with
the one before it (the longest common prefix) exists already; the rest of it are new nodes. So prefix sums of the new
nodes number all nodes in preorder, and a node's subtree ends where its last member ends: one maximum a node, with
partial aggregation. Leaves and savings of a subtree are differences of prefix sums at the ends of its interval.

Only digests and sizes travel, not texts. A conversation's digests (some 24 bytes a turn) meet in one row. Copies are
grouped before anything else; the root, a first turn or a last node that most conversations share is a hot key, and joined as one.

Cases: a null role or text is empty. Turns of a conversation with equal numbers (or null ones, which come first) go by
the SHA-256 of role and text; repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. Very
long texts are hashed whole. A conversation without turns is a member of the root. No rows give no nodes. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import hot_join, written
from gridloom.llm.order import in_order, running, sequential_sha256

#: Ids joined into one piece before they are hashed, and positions whose sums are taken in one window.
PIECE = 4096
BLOCK = 65_536
#: Bytes of a turn's or node's digest. Rows that Python returns at once.
DIGEST = 16
AT_ONCE = 10_000
TURNS = "array<struct<digest: binary, size: int>>"
NODES = "node binary, parent binary, depth long, pos long, last long, members long, conv_id long, size long, ends string"
#: Fixed value: the SHA-256 of nothing.
NOTHING = hashlib.sha256().hexdigest()


def conversations_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the digests and sizes of each conversation's turns, in order."""
    said, by = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (text, role))
    whole = F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said).cast("binary")
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, DIGEST)
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.octet_length(said).alias("size")).alias("t"))
    listed = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("all"))
    return listed.select("conv_id", F.transform("all", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).cast(TURNS).alias("turns"))


def regenerated(convs: DataFrame, share: Column, every: int, most: int) -> DataFrame:
    """Each conversation c rebuilt: the first `share` turns (`most` at most) of conversation c - c % every, then its own after that many."""
    base = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    rows = convs.withColumn("share", share.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    empty = F.array().cast(TURNS)
    own = F.when(F.size("turns") > F.col("share"), F.slice("turns", F.col("share") + 1, F.size("turns"))).otherwise(empty)
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("first", empty), F.lit(1), F.col("share")), own).alias("turns"))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on each distinct conversation's way, from the root; a node's name is the digest of its way."""
    schema = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[k]) for n, k in (x.split() for x in NODES.split(", "))])
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for r in batch.to_pylist():
            turns, shared, last = r["turns"], r["shared"], r["last"]
            name, parent, size = hashlib.sha256().digest()[:DIGEST], None, 0
            for depth in range(len(turns) + 1):
                if depth:
                    t = turns[depth - 1]
                    name, parent, size = hashlib.sha256(name + t["digest"]).digest()[:DIGEST], name, t["size"]
                pos = last - (len(turns) - depth) if depth > shared else None  # new here
                out.append((name, parent, depth, pos, last, r["members"], r["conv_id"], size, r["ends"] if depth == len(turns) else None))
                if len(out) >= AT_ONCE:
                    yield made()
    if out:
        yield made()


def ranked(convs: DataFrame) -> DataFrame:
    """Distinct sequences of turns in order: turns, members, conv_id (smallest), ends (digest of members), shared (turns shared with the one before; -1 for the first), last (preorder position of its end)."""
    key = F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "").cast("binary"), 256)
    convs = written(convs.withColumn("key", key), "trie-convs")
    # members' ids, in order, joined into pieces that are hashed one after the other
    ids = in_order(convs.select("key", "conv_id"), "trie-ids", "key", "conv_id")
    pieces = ids.groupBy("key", "part", F.floor(F.col("at") / PIECE).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").cast("binary").alias("ends"))
    ends = sequential_sha256(pieces, "key", ["part", "piece"], ["ends"], b",")
    groups = convs.groupBy("key").agg(F.first("turns").alias("turns"), F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("conv_id"))
    way = F.transform("turns", lambda t: t["digest"])
    rows = in_order(groups.join(ends, "key").withColumn("way", way), "trie-order", "way")
    # the sequence before: within the part, or the last of the part before
    closing = rows.groupBy("part").agg(F.max("way").alias("closing"))
    closing = closing.select(F.lead("part").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("part"), "closing").filter("part IS NOT NULL")
    before = F.coalesce(F.lag("way").over(Window.partitionBy("part").orderBy("at")), F.col("closing"))
    differs = F.array_position(F.zip_with("before", "way", lambda a, b: a.eqNullSafe(b)), False) - 1
    rows = rows.join(closing, "part", "left").withColumn("before", before)
    rows = rows.withColumn("shared", F.when(F.col("before").isNull(), -1).otherwise(differs).cast("int")).drop("before", "closing", "way", "key")
    rows = running(written(rows, "trie-shared"), "part", "at", {"new": F.size("turns") - F.col("shared")})
    return rows.withColumn("last", F.col("new") - 1).drop("part", "at", "new")


def trie(convs: DataFrame) -> DataFrame:
    """The distinct nodes of all prefixes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes that the subtree needn't hold again), ends_sha256, and the interval pos to end_pos in preorder."""
    met = ranked(convs).mapInArrow(_nodes, NODES)
    top = lambda c: F.max(c).alias(c)
    nodes = met.groupBy("node").agg(top("parent"), top("depth"), top("pos"), F.max("last").alias("end_pos"), F.sum("members").alias("n_convs"), F.min("conv_id").alias("conv_id"), top("size"), top("ends"))
    leaf, saved = (F.col("end_pos") == F.col("pos")).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    nodes = nodes.withColumn("leaf", leaf).withColumn("saved", saved).withColumn("block", F.floor(F.col("pos") / BLOCK))
    nodes = written(running(written(nodes, "trie-nodes"), "block", "pos", {"leaves_to": F.col("leaf"), "saved_to": F.col("saved")}), "trie-sums")
    total = nodes.count()
    # what has been summed up where the subtree ends: many nodes may end at one place
    endings = nodes.groupBy("end_pos").agg(F.count(F.lit(1)).alias("n"))
    endings = endings.join(nodes.select(F.col("pos").alias("end_pos"), F.col("leaves_to").alias("leaves_end"), F.col("saved_to").alias("saved_end")), "end_pos")
    nodes = hot_join(nodes, written(endings, "trie-endings"), "end_pos", "n", total).drop("n")
    children = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).filter("parent IS NOT NULL").withColumnRenamed("parent", "node")
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-ended")
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    root = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("n", F.lit(0).cast("long"))
    whole = hot_join(nodes.filter("depth > 0"), parents, "parent", "n", total).unionByName(root)
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves_end") - F.col("leaves_to") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
        "pos",
        "end_pos",
    )
