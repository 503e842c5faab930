"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat, exact_dedup, hilbert_ann, merkle, mixing, packing, quality, simhash, simple8b, toxicity, trie, url_filter, warc
from gridloom.llm.common import LOWER, UPPER, scratch_path, table


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("target_uri")


def op8_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; where 7 divides the checksum of an id, the proof is tried on a row whose n_chars has grown by 1."""
    docs, fields = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    longer = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = merkle.leaf([longer if c == "n_chars" else F.col(c) for c in fields])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)
    made = merkle.manifest(docs, "doc_id", "lang", fields, carry={"tampered": tampered})
    proofs = made.proofs.withColumn("root", F.lit(made.root)).withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = F.sha2(merkle.siblings_of(F.col("path")).cast("binary"), 256)
    return proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation begins with up to eight turns of one in five, so that many share their first turns."""
    convs = trie.conversations_of(table(spark, sf_dir, "conversations"))
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return trie.trie(trie.regenerated(convs, share, 5, 8)).drop("pos", "end_pos")


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, written as windows and read back."""
    said = "</s>[INST] ok [/INST]"
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    path = scratch_path(spark, "chat-windows")
    chat.write_windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd), path)
    return chat.digests(chat.read_turns(spark, path))


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_simhash, op3_mixing, op4_exact_dedup, op5_packing, op6_toxicity, op7_warc, op8_hilbert_ann, op9_quality, op10_url_filter, op11_merkle, op12_trie, op13_chat)}


def _crc32(of: str) -> str:
    """SQL for the unsigned CRC-32 of a number's decimal digits, four bits at a time. The table follows from the reflected polynomial."""
    nibbles = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        nibbles.append(x)
    look = "(" + str(nibbles) + "::BIGINT[])"
    half = lambda c: f"xor(({c}) >> 4, {look}[(({c}) & 15) + 1])"
    step = f"lambda c, d: {half(half('xor(c, d)'))}"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({of}::VARCHAR, ''), lambda d: ascii(d)::BIGINT), {step}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _merkle_sql() -> str:
    leaf = lambda n: "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", n, "text"])) + ")"
    grow = "idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))"
    climb = """w.uid, w.tree, w.lvl + 1, w.idx // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''),
               sha256(CASE WHEN w.idx % 2 = 1 THEN coalesce(s.h, '') || w.h ELSE w.h || coalesce(s.h, '') END)"""
    return f"""
        WITH RECURSIVE src AS (
          SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("n_chars")} AS leaf,
                 CASE WHEN {_crc32("doc_id")} % 7 = 0 THEN {leaf("n_chars::HUGEINT + 1")} END AS changed
          FROM documents),
        leaves AS (
          SELECT *, row_number() OVER () AS uid, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
          FROM src),
        nodes AS (
          SELECT tree, 0::BIGINT AS lvl, idx, n, leaf AS h FROM leaves
          UNION ALL SELECT tree, lvl + 1, {grow} FROM nodes WHERE n > 1 GROUP BY tree, lvl, idx // 2, n),
        subs AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops AS (
          SELECT 0::BIGINT AS lvl, idx, n, h FROM subs
          UNION ALL SELECT lvl + 1, {grow} FROM tops WHERE n > 1 GROUP BY lvl, idx // 2, n),
        inner_walk AS (
          SELECT uid, tree, 0::BIGINT AS lvl, idx, n, '' AS proof, coalesce(changed, leaf) AS h FROM leaves
          UNION ALL
          SELECT {climb} FROM inner_walk w LEFT JOIN nodes s ON s.tree = w.tree AND s.lvl = w.lvl AND s.idx = xor(w.idx, 1) WHERE w.n > 1),
        outer_walk AS (
          SELECT w.uid, w.tree, 0::BIGINT AS lvl, b.idx, b.n, w.proof, w.h FROM inner_walk w JOIN subs b ON b.tree = w.tree WHERE w.n = 1
          UNION ALL
          SELECT {climb} FROM outer_walk w LEFT JOIN tops s ON s.lvl = w.lvl AND s.idx = xor(w.idx, 1) WHERE w.n > 1)
        SELECT l.doc_id, l.leaf, b.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
        FROM leaves l JOIN subs b ON b.tree = l.tree JOIN outer_walk w ON w.uid = l.uid AND w.n = 1 JOIN tops r ON r.n = 1"""


TRIE_SQL = f"""
        WITH own AS (
          SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                               ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
          FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        sized AS (SELECT *, {_crc32("conv_id")} % 9 AS h FROM own),
        full_way AS (
          SELECT c.conv_id, coalesce(b.turns, [])[1:c.h] || c.turns[c.h + 1:] AS way
          FROM sized c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
        met AS (SELECT conv_id, way, d, way[1:d] AS node FROM (SELECT conv_id, way, unnest(range(len(way) + 1)) AS d FROM full_way)),
        nodes AS (
          SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(way) = d), '')) AS ends_sha256
          FROM met GROUP BY node),
        kids AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.node[1:n.depth] = n.node) AS n_children
                 FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1])
        SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, k.ends_sha256,
               count(*) FILTER (b.n_children = 0) AS n_leaves,
               sum(CASE WHEN b.depth = 0 THEN 0 ELSE (b.n_convs - 1) * strlen(b.node[b.depth].text) END)::BIGINT AS saved_tokens
        FROM kids k JOIN kids b ON b.depth >= k.depth AND b.node[1:k.depth] = k.node
        GROUP BY ALL"""

ORACLE_SQL = {
    "op11_merkle": _merkle_sql(),
    "op12_trie": TRIE_SQL,
    "op4_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
        WINDOW g AS (PARTITION BY norm)""",
    "op7_warc": """
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                     max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
              FROM pages)""",
}
