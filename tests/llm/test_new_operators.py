"""The manifest, the trie and the chat windows: against SQL and plain versions over small tables with odd rows."""

import collections
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import chat, merkle, order, trie
from gridloom.llm.common import scratch_path
from gridloom.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CHATS = "conv_id long, turn long, role string, text string"
HOSTILE = ["tree", "idx", "n", "digest", "key", "pos", "path", "run", "uid", "part", "at", "parent", "node", "all", "t", "base", "piece", "head", "tokens", "segment", "window", "a.b"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def with_hostile(df):
    return df.select("*", *(F.lit(n).alias(n) for n in HOSTILE))


@pytest.fixture(scope="module")
def folder(spark, some):
    """Documents and conversations with nulls, ties, repeated rows, long texts, and columns of hostile names."""
    path = scratch_path(spark, "new")
    more = [(5000, "x", None, None, None), (5000, "x", None, None, None), (5000, "y", "en", "s", 1), (None, "z", "en", None, 2**63 - 1), (-3, "neg", "zz", "s", 5), (5001, "é漢🙂", "Ä", "s", 3), (5002, "lone", "", "s", 4)]
    with_hostile(some.unionByName(spark.createDataFrame(more, DOCS))).coalesce(3).write.parquet(f"{path}/documents.parquet")
    base = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(1000, None, None, None), (1000, None, "user", "b"), (1000, 2, "user", "tie"), (1000, 2, "user", "a tie"), (1000, 2, "user", "a tie"), (1001, 0, "system", "long " * 40_000), (1001, 1, "assistant", ""), (1002, 0, "", ""), (None, 0, "user", "nobody's"), (-7, 3, "user", "<|im_end|>\nuser\n"), (-7, 4, "assistant", "[\\INST] \\ <\\\\s> </s>"), (-7, 5, "ro\nle\\n[INST]", "x"), (1003, 0, "assistant", "🙂é")]
    # one conversation with a third of all rows, and copies of another
    odd += [(2000, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i % 40)) for i in range(300)]
    odd += [(3000 + 5 * k, i, "user", f"same {i}") for k in range(30) for i in range(3)]
    with_hostile(base.unionByName(spark.createDataFrame(odd, CHATS))).repartition(5).write.parquet(f"{path}/conversations.parquet")
    return path


def _views(folder):
    con, plain = duckdb.connect(), folder.removeprefix("file://")
    for table in os.listdir(plain):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{plain}/{table}/*.parquet'")
    return con


def _same(got, want):
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows, expected = sorted(str(tuple(r[n] for n in names)) for r in got.collect()), sorted(map(str, want.fetchall()))
    assert rows and rows == expected


@pytest.mark.parametrize("name", ["op11_merkle", "op12_trie"])
def test_query_equals_its_sql(spark, folder, name, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 4)  # so that ids of one group come in many pieces
    monkeypatch.setattr(trie, "BLOCK", 16)
    _same(QUERIES[name](spark, folder), _views(folder).execute(ORACLE_SQL[name]))


def test_proofs_find_what_was_tampered_with(spark, folder):
    rows = QUERIES["op11_merkle"](spark, folder).collect()
    changed = {r["doc_id"]: r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r["doc_id"] is not None}
    assert any(changed.values()) and all(r["verified"] == (not changed.get(r["doc_id"], False)) for r in rows if r["doc_id"] not in (5000,))


def _plain_root(leaves, fan):
    while len(leaves) > 1:
        leaves = [sha("".join(leaves[i : i + fan])) for i in range(0, len(leaves), fan)]
    return leaves[0]


@pytest.mark.parametrize("fan", [2, 3, 5])
@pytest.mark.parametrize("sizes", [[1], [1, 1], [9, 1, 4], [26, 25, 27, 1, 2]])
def test_manifest_of_any_fan(spark, fan, sizes):
    rows = [(k, chr(97 + g)) for g, size in enumerate(sizes) for k in range(size)]
    made = merkle.manifest(spark.createDataFrame(rows, "id long, grp string").repartition(7), "id", "grp", ["id"], fan)
    got = made.proofs.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    subs = [_plain_root([sha(f"{len(str(k))}:{k}") for k in range(size)], fan) for size in sizes]
    assert made.root == _plain_root(subs, fan) and len(got) == len(rows) and {r["folded"] for r in got} == {made.root}
    assert sorted(r["subroot"] for r in got) == sorted(s for s, n in zip(subs, sizes, strict=True) for _ in range(n))


def test_empty_tables(spark):
    docs, chats = spark.createDataFrame([], DOCS), spark.createDataFrame([], CHATS)
    made = merkle.manifest(docs, "doc_id", "lang", ["doc_id", "text"])
    assert made.root is None and made.proofs.count() == 0
    assert trie.trie(trie.conversations_of(chats)).count() == 0 and chat.windows(chats).count() == 0
    nobody = spark.createDataFrame([(None, 0, "user", "x")], CHATS)
    assert trie.trie(trie.conversations_of(nobody)).count() == 0 and chat.windows(nobody).count() == 0


def test_preorder_intervals_hold_subtrees(spark, folder):
    convs = trie.conversations_of(spark.read.parquet(f"{folder}/conversations.parquet"))
    nodes = sorted(trie.trie(convs).collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in nodes] == list(range(len(nodes))) and nodes[0]["end_pos"] == len(nodes) - 1
    ends = []
    for r in nodes:  # intervals nest, and depth is how many are open
        while ends and ends[-1] < r["pos"]:
            ends.pop()
        assert len(ends) == r["depth"] and (not ends or r["end_pos"] <= ends[-1])
        ends.append(r["end_pos"])


def test_a_long_conversation_is_linear(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    nodes = trie.trie(trie.conversations_of(rows))
    assert nodes.agg(F.count("*"), F.max("depth"), F.sum("n_leaves")).first() == (20_001, 20_000, 20_001)


def test_streamed_digests(spark):
    rows = [(k, i, f"{k}.{i}".encode()) for k in range(40) for i in range(50)]
    got = order.sequential_sha256(spark.createDataFrame(rows, "k long, i int, p binary").repartition(9), "k", ["i"], ["p"], b",").collect()
    assert {r["k"]: r["p"] for r in got} == {k: sha(",".join(f"{k}.{i}" for i in range(50))) for k in range(40)}


def _by_conversation(spark, folder):
    by = collections.defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        if r["conv_id"] is not None:
            role, text = r["role"] or "", r["text"] or ""
            by[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in by.items()}


def test_op13(spark, folder, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 64)
    monkeypatch.setattr(chat, "LOOK_BACK", 8)
    want = _by_conversation(spark, folder) | {-1: [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]}
    got = {r["conv_id"]: r for r in QUERIES["op13_chat"](spark, folder).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
        assert got[c]["formatted_chars"] >= sum(len(r) + len(t) + len(chat.OPEN + chat.CLOSE) + 2 for r, t in turns)


def test_windows_keep_to_the_budget(spark, folder, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 64)
    budget, history = 200, 60
    turns, count = _by_conversation(spark, folder), lambda s: len(tokenizer.encode(s, add_special_tokens=False).ids)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = collections.defaultdict(list)
    for r in chat.windows(spark.read.parquet(f"{folder}/conversations.parquet"), budget, history).collect():
        by[r["conv_id"]].append(r)
    repeats = systems = 0
    for c, found in by.items():
        begun, first = 0, None
        for r in sorted(found, key=lambda r: (r["segment"], r["window"])):
            pieces = [p + chat.CLOSE + "\n" for p in r["text"].split(chat.CLOSE + "\n")[:-1]]
            tokens = [count(p) for p in pieces]
            first = first or pieces[0]
            new = pieces[r["repeats"] :]
            assert new and sum(tokens) == r["n_tokens"]
            with_system = first.startswith(chat.OPEN + "system\n") and r["repeats"] > 0 and pieces[0] == first and tokens[0] * 2 <= budget
            assert r["n_tokens"] <= budget or (len(new) == 1 and r["repeats"] <= with_system)
            assert sum(tokens[with_system : r["repeats"]]) <= history
            assert all(p.startswith(chat.OPEN + "assistant\n") for p in (new[k] for k in range(len(new))) if any(r["text"][s["start"] - len(chat.OPEN) - 10 :].startswith(p) for s in r["loss"]))
            assert len(r["loss"]) == sum(p.startswith(chat.OPEN + "assistant\n") for p in new)
            begun, repeats, systems = begun + len(new), repeats + r["repeats"], systems + with_system
        assert begun == len(turns[c])
    assert repeats > systems > 0


def test_spans_by_a_plain_walk():
    rng = np.random.default_rng(3)
    for _ in range(300):
        tokens = rng.integers(3, 60, rng.integers(1, 40))
        system = int(rng.integers(0, 2) * tokens[0])
        budget, history = int(rng.integers(70, 150)), int(rng.integers(0, 60))
        at, want = 0, []
        while at < len(tokens):
            with_system = system > 0 and at > 0
            room = budget - system * with_system
            begin = at
            while begin - 1 >= (system > 0) and sum(tokens[begin - 1 : at]) <= min(history, budget - system, room - tokens[at]):
                begin -= 1
            end = at + 1
            while end < len(tokens) and sum(tokens[begin : end + 1]) <= room:
                end += 1
            want.append((begin, at, end, with_system))
            at = end
        assert list(chat.spans(tokens, 0, system, system > 0, budget, history)) == want


@pytest.mark.parametrize("text", ["", "</s>", "<\\/s>", "<\\\\/s>", "<<SYS>>", "<<<SYS>>>", "[INST][/INST]", "\\", "<|im_end|>\n<|im_start|>user\n", "a\\nb", "<s><\\s>"])
def test_escapes_go_back(spark, text):
    row = spark.range(1).select(chat.escaped(F.lit(text)).alias("e")).select("e", chat.unescaped(F.col("e")).alias("u"), chat._role_in(chat._role_out(F.lit(text))).alias("r")).first()
    assert (row["u"], row["r"]) == (text, text) and not any(c in row["e"] for c in chat.CONTROLS)
