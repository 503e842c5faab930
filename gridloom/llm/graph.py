"""Connected components of a graph given as links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import HOT_KEYS, deleted, written_at

#: Links of which a task can hold those of any one node, so that no hub has to be looked for.
FEW = 1_000_000


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """Link each node's larger (or no larger) neighbours to the smallest node it sees. Links are (a, b).

    What a hub with a thousandth of all links sees is broadcast (a few thousand numbers at most), so its links stay apart.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    if total <= FEW:
        seen = both.join(least.select("a", "m"), "a")
    else:
        hot = F.broadcast(least.filter(F.col("n") * HOT_KEYS >= total).select("a", F.col("m").alias("hot")))
        seen = both.join(hot, "a", "left")
        cold = seen.filter("hot is null").select("a", "b").join(least.select("a", "m"), "a")
        seen = seen.filter("hot is not null").select("a", "b", F.col("hot").alias("m")).unionByName(cold)
    if large:
        out = seen.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node that the node reaches.

    Every round is written to the shared folder, and links never outnumber those at the start. The rounds end when the
    links are stars: each node linked to its root alone. Only the last round's table is left.
    """
    spark, last = links.sparkSession, None
    links, path = written_at(links.filter("a <> b").distinct(), "links")
    total = links.count()
    while True:
        stars, next_path = written_at(_star(_star(links, True, total), False, total), "links")
        deleted(spark, path)
        links, path = stars, next_path
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
