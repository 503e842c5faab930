import collections
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from gridloom.llm import exact_dedup, mixing, packing, simhash, simple8b, tokens
from gridloom.llm.common import scratch_path
from gridloom.llm.graph import components
from gridloom.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def rows(some):
    return sorted((r["doc_id"], r["text"], r["source"]) for r in some.select("doc_id", "text", "source").collect())


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = np.random.default_rng(5)
    letters = list(" \n\t.,'a1é% \x1cZs<|>　")
    hard = ["", "  ", "a  b", " a", "x   y \n z", "don't stop,, now. ...", "<|endoftext|> a <|endoftext|>", "a" * 300 + " " + "b" * 200 + "."]
    hard += ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder().encode(hard)]
    assert got == [e.ids for e in tokenizer.encode_batch(hard, add_special_tokens=False)]


def test_encoder_cuts_where_the_tokenizer_does(tokenizer):
    """All kinds of white space, signs beside letters, tokens added to the vocabulary, and pieces met before, in small groups and after all is forgotten."""
    rng, encoder = random.Random(5), Encoder()
    plain = [*"  \n\t\r\x0b\x0c.,!?\"'*-_ab1", "the", "The", "é", "ß", "漢", "🙂", "'s", "'re", "’", "«", "é", "ª", "²", "\x00", "\x7f", "\u0120", "\u010a", "\ufeff", "<|"]
    rare = [*plain, *"\x1c\x1f\x85\xa0\u1680\u180e\u2003\u2028\u200b\u202f\u205f\u3000", "<|endoftext|>"]
    for k in range(60):
        texts = ["".join(rng.choices(rare if k % 3 == 0 else plain, k=rng.randint(0, 14))) for _ in range(150)]
        if k % 20 == 19:
            encoder._forget()
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([*texts, None])]
        assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)] + [[]]


def test_encoder_takes_long_texts_in_parts(tokenizer, monkeypatch):
    rng = random.Random(6)
    for odd in ("", "\xa0", "<|endoftext|>"):
        texts = ["".join(rng.choices(["ab", " ", "  ", " cd", "\n", ".", "é", odd], k=rng.randint(0, 400))) for _ in range(60)]
        monkeypatch.setattr(tokens, "AT_ONCE", rng.randint(1, 90))
        encoder, seen = Encoder(), []
        monkeypatch.setattr(encoder, "_group", lambda x, seen=seen, f=encoder._group: seen.append(sum(map(len, x))) or f(x))
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert max(seen) < max(map(len, texts))


def test_encoder_saves_most_of_the_tokenizers_work(tokenizer):
    """At the size of the check a task has three tenths of the tokenizer's own time at most (four tenths were over the budget)."""
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()
    table, shares = [x or "" for x in table][:6000], []
    for _ in range(3):
        encoder, times = Encoder(), [time.process_time()]
        collections.deque((x for k in range(0, 6000, 1000) for x in encoder.encode(table[k : k + 1000])), maxlen=0)
        times.append(time.process_time())
        collections.deque((x for k in range(0, 6000, 1000) for x in tokenizer.encode_batch_fast(table[k : k + 1000], add_special_tokens=False)), maxlen=0)
        times.append(time.process_time())
        shares.append((times[1] - times[0]) / (times[2] - times[1]))
    assert min(shares) < 0.3, shares


@pytest.mark.parametrize("high", [1, 2, 50, 60_000, 2**31, 2**59])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 239, 241, 70_000):
        ids = (rng.integers(0, high, n) * (rng.random(n) < rng.random())).astype(np.uint64)
        lengths = [n // 2, n - n // 2]
        got, got_lengths, names = simple8b.unpack_file(simple8b.pack_file(ids, lengths, [7, None]))
        assert (got == ids).all() and got_lengths.tolist() == lengths and names == [7, None]


def test_simple8b_rejects_what_does_not_fit():
    with pytest.raises(ValueError):
        simple8b.encode_block(np.array([1 << 60], np.uint64))
    with pytest.raises(ValueError):
        simple8b.unpack_file(b"x" * 64)


def test_token_files(spark, some, rows, tokenizer):
    path = scratch_path(spark, "ids")
    simple8b.write_ids(some, path)
    got = {r["doc_id"]: r for r in simple8b.read_ids(spark, path).collect()}
    start = 0
    for doc_id, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        r = got.pop(doc_id)
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not got
    assert simple8b.round_trip(some.limit(0)).count() == 0


def test_exact_dedup(some, rows, docs_of):
    texts = collections.defaultdict(list)
    for doc_id, text, _ in rows:
        texts[low(text)].append(doc_id)
    for slots in (None, 64):  # the small filter is full: same results, more rows shuffle
        got = {r["doc_id"]: r for r in exact_dedup.duplicate_groups(some, slots=slots).collect()}
        for ids in texts.values():
            for i in ids:
                assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
    kept = exact_dedup.exact_dedup(some)
    assert kept.columns == some.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(map(max, texts.values()))
    twice = docs_of([(1, "x"), (1, "X"), (None, "x"), (2, None)])
    once = sorted(map(tuple, exact_dedup.exact_dedup(twice).collect()))
    assert [r[0] for r in once] == [1, 2] and once == sorted(map(tuple, exact_dedup.exact_dedup(twice.repartition(3)).collect()))
    assert exact_dedup.exact_dedup(some.limit(0)).count() == 0 and exact_dedup.duplicate_groups(some.limit(0)).count() == 0


def test_exact_dedup_plan_is_native(some):
    plan = exact_dedup.exact_dedup(some)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _hash(text):
    words = WORD.findall(low(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash(some, rows):
    prints = {i: _hash(t) for i, t, _ in rows}
    comp = _components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = simhash.near_duplicates(some).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert simhash.near_duplicates(some.limit(0)).count() == 0


def _with_pivots(spark, fps):
    table = simhash.pivot_table(np.array(fps, np.int64).view(np.uint64)[:, None])
    return spark.createDataFrame([(x, t.tobytes()) for x, t in zip(fps, table, strict=True)], "fp long, pivots binary")


def test_links_lose_none_in_large_groups(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = [int(b) for b in base]
    for b in base[:8]:  # dense groups, wider than the radius
        for _ in range(40):
            fps.append(int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 7), replace=False)))
    fps = sorted(set(fps))
    comp = _components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    frame = _with_pivots(spark, fps)
    for group in (8, simhash.GROUP):
        got = {r["node"]: r["root"] for r in components(simhash.near_links(frame, group=group)).collect()}
        assert {x: got.get(x, x) for x in fps} == comp


def test_links_grow_in_proportion_in_one_group(spark):
    rng = np.random.default_rng(6)
    seen = []
    for n in (4_000, 20_000):
        fps = {0}
        while len(fps) < n:  # one dense group under one key: up to four of 43 bits
            fps.add(int(sum(1 << int(k) for k in rng.choice(43, rng.integers(1, 5), replace=False))))
        keyed = _with_pivots(spark, sorted(fps)).selectExpr("fp AS node", "pivots", "7L AS key").cache()
        links = simhash.links_in_groups(keyed, None, 4).cache()
        assert components(links).select("root").distinct().count() == 1
        seen.append(links.count())
    assert seen[0] < 2 * 4_000 and seen[1] < 2 * 20_000


def test_unlike_members_of_one_group_lose_no_link(spark, monkeypatch):
    """Members that agree in two blocks and in nothing else, with near ones among them: dealt by further blocks, twice."""
    monkeypatch.setattr(simhash, "REST", 60)
    rng = np.random.default_rng(11)
    agree = sum(simhash.masks_after(p, 6, 4)[0] for p in ((), (0,)))  # so that many agree after the next blocks too
    fps = {int(x) & ~agree for x in rng.integers(0, 1 << 64, 1500, np.uint64)} | {int(x) & ~simhash.masks_after((), 6, 4)[0] for x in rng.integers(0, 1 << 64, 500, np.uint64)}
    for x in list(fps)[::7]:
        fps.add(x ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    comp = _components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    table = simhash.pivot_table(np.array(signed, np.int64).view(np.uint64)[:, None])
    frame = spark.createDataFrame([(x, t.tobytes()) for x, t in zip(signed, table, strict=True)], "fp long, pivots binary").cache()
    for blocks in (6, 8):
        got = {r["node"]: r["root"] for r in components(simhash.near_links(frame, blocks=blocks, group=50)).collect()}
        assert {x: got.get(x, x) for x in signed} == comp


def test_unlike_documents_of_one_group_lose_no_link(spark, monkeypatch):
    """Documents that share half of their words in one group, with near copies among them: dealt by their rarest shingles."""
    monkeypatch.setattr(simhash, "REST", 20)
    rng, passage = random.Random(4), [f"p{i}" for i in range(150)]
    texts = []
    for i in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        texts.append(passage + own)
        if i % 5 == 0:
            texts.append(passage + own[: -rng.randrange(1, 40)] + [f"z{i}"])
    sets = [np.unique(simhash.shingle_hashes(" ".join(t).encode(), 5)) for t in texts]
    prints = [simhash.wide_sketch(" ".join(t).encode(), 5)[1] for t in texts]
    tables = simhash.pivot_table(np.stack(prints))
    facts = spark.createDataFrame([(i, p.tobytes(), t.tobytes(), x.tobytes()) for i, (p, t, x) in enumerate(zip(prints, tables, sets, strict=True))], "node long, fp binary, pivots binary, shingles binary").cache()
    keyed = facts.selectExpr("node", "3L AS key").cache()
    dealt = simhash.by_rare_shingles(keyed, facts)
    assert dealt.groupBy("key").count().agg({"count": "max"}).first()[0] <= 4
    links = simhash.links_in_groups(keyed, facts, simhash.WIDE_RADIUS, 16, lambda m: simhash.by_rare_shingles(m, facts), 2)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    want = _components(range(len(texts)), lambda a, b: simhash.similar(sets[a], sets[b]))
    assert {i: got.get(i, i) for i in range(len(texts))} == want and len(set(want.values())) < len(texts)


def test_blocks_lose_no_pair():
    rng = np.random.default_rng(5)
    assert [simhash.blocks_for(n) for n in (0, 30_000_000, 40_000_000, 10**10, 10**12)] == [6, 6, 7, 8, 8]
    for _ in range(300):
        differ, path = sum(1 << int(k) for k in rng.choice(64, 4, replace=False)), ()
        for blocks in (int(rng.integers(6, 9)),):
            for _ in range(3):
                agreeing = [i for i, m in enumerate(simhash.masks_after(path, blocks, 4)) if not m & differ]
                assert agreeing
                path = (*path, agreeing[int(rng.integers(len(agreeing)))])


@pytest.mark.parametrize("width,radius,least", [(1, simhash.RADIUS, 0.999), (simhash.WIDE, simhash.WIDE_RADIUS, 0.999)])
def test_pivots_discard_the_unrelated_and_none_within_the_radius(width, radius, least):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 1 << 64, (2, 5000, width), np.uint64)
    near = a.copy().view(np.uint8)
    for row in near:  # within the radius, as far as it goes
        for k in rng.choice(64 * width, radius, replace=False):
            row[k // 8] ^= 1 << (k % 8)
    fps = np.concatenate([a, b, near.view(np.uint64)])
    table, at = simhash.pivot_table(fps), np.arange(5000)
    assert len(simhash.not_discarded(table, at, at + 5000, radius)) <= (1 - least) * 5000
    assert len(simhash.not_discarded(table, at, at + 10_000, radius)) == 5000


def test_near_dedup_by_shingles(docs_of):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(3000)]
    make = lambda n: list(rng.choice(vocab, n))
    rows, groups = [], []
    for g in range(12):
        words = make(300)
        ids = []
        for _ in range(3):
            copy = list(words)
            for k in rng.choice(300, 3, replace=False):  # each change touches five shingles: similarity 0.9
                copy[k] = "changed"
            ids.append(len(rows))
            rows.append((len(rows), " ".join(copy)))
        groups.append(ids)
        half = words[:150] + make(150)  # shares half the shingles: not near
        groups.append([len(rows)])
        rows.append((len(rows), " ".join(half)))
    rows += [(900, None), (901, ""), (902, "tiny"), (None, "no id"), (None, "no id"), (5, "another text with the id five"), (5, "a third one that has it"), (None, rows[0][1])]
    kept = simhash.near_dedup(docs_of(rows))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted([min(g) for g in groups] + [900, 902, 5, 5])
    assert [r["text"] for r in kept.filter("doc_id is null").collect()] == ["no id"]
    assert sorted(map(str, simhash.near_dedup(docs_of(rows).repartition(5), group=4).collect())) == sorted(map(str, kept.collect()))
    assert simhash.near_dedup(docs_of([])).count() == 0


def test_near_dedup_is_exact_about_the_similarity(docs_of):
    rng = np.random.default_rng(4)
    rows, near = [], {}
    shingles = lambda t: {" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    # pairs of a text and its start: n shingles, of which the other has a share from 0.7 to 0.9
    for n in (5, 6, 10, 15, 20, 25, 60, 127, 128, 180, 400):
        for part in sorted({round(n * x / 100) for x in range(70, 91, 1)}):
            for _ in range(3 if n < 128 else 1):
                words = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
                one, two = shingles(words), shingles(words[: part + 4])
                near[len(rows) + 1] = 5 * len(one & two) >= 4 * len(one | two)
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: part + 4]))]
    # a chain whose ends are joined by its middle alone, through a text that isn't similar to the first
    base = [f"c{x}" for x in range(104)]
    for k, size in enumerate((104, 89, 76, 40)):
        near[len(rows)] = 0 < k < 3
        rows.append((len(rows), " ".join(base[:size])))
    kept = {r["doc_id"] for r in simhash.near_dedup(docs_of(rows)).collect()}
    assert kept == {i for i, _ in rows if not near.get(i, False)}


def test_mixing(spark, some, rows):
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    by = collections.Counter()
    for i, n in sizes.items():
        by[source[i]] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    free, target, total = set(order), {}, sum(by.values())
    while True:
        level = (total - sum(3 * by[s] for s in order if s not in free)) / (sum(weight[s] for s in free) or 1)
        over = {s for s in free if weight[s] * level > 3 * by[s]}
        if not over:
            break
        free -= over
    got = mixing.mix(some).collect()
    assert sorted(got) == sorted(mixing.mix(some).collect())
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        target[s] = weight[s] * level if s in free else 3 * by[s]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == by[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
    for s in order:
        largest = max(n for i, n in sizes.items() if source[i] == s)
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], 2 * largest if sum(source[i] == s for i in sizes) < 30 else 0)
    mixed = mixing.mixed(some)
    assert mixed.columns == some.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    assert mixing.mix(some.limit(0)).count() == 0


@pytest.mark.parametrize("shares", [(0.2, 0.37, 0.9), (0.02,), (0.98,), (0.5,)])
def test_cube_keeps_totals(shares):
    rng = random.Random(4)
    size = sorted((int(2 ** (rng.random() * 12)) for _ in range(800)), reverse=True)
    p = [rng.choice(shares) for _ in size]
    words, docs = sum(a * b for a, b in zip(p, size, strict=True)), sum(p)
    held = mixing.decide(p, size, rng)
    assert len(held) <= 2 and all(x in (0, 1) for i, x in enumerate(p) if i not in held)
    assert abs(sum(a * b for a, b in zip(p, size, strict=True)) - words) < 1e-3 and abs(sum(p) - docs) < 1e-6
    left = sum(size[i] for i in held)
    assert left <= (20 if 0.1 < shares[0] < 0.95 else 300)  # what is left is small
    mixing.land(p, size, held, rng)
    assert abs(sum(a * b for a, b in zip(p, size, strict=True)) - words) <= left and abs(sum(p) - docs) < 2 and set(p) <= {0.0, 1.0}


@pytest.mark.parametrize("kind", ["spread", "equal", "empty"])
def test_cube_keeps_inclusion_probabilities(kind):
    rng = random.Random(4)
    make = {"spread": lambda: int(2 ** (rng.random() * 12)), "equal": lambda: 7, "empty": lambda: rng.choice([0, 0, 5])}[kind]
    size = sorted((make() for _ in range(41)), reverse=True)
    part = [rng.choice([0.1, 0.37, 0.8]) for _ in size]
    runs, taken = 2000, [0.0] * len(size)
    for seed in range(runs):
        p, draw = list(part), random.Random(seed)
        mixing.land(p, size, mixing.decide(p, size, draw), draw)
        taken = [a + b for a, b in zip(taken, p, strict=True)]
    for t, q in zip(taken, part, strict=True):
        assert abs(t / runs - q) < 4.5 * (q * (1 - q) / runs) ** 0.5


def test_mixing_chunks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(2 ** (rng.random() * 7))), "a" if i % 3 else "b") for i in range(6000)]
    rows += [(9, "w w w", "a")] * 500  # rows that are equal in all that counts, in many chunks
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame, chunk=64).collect()
    assert sorted(got) == sorted(mixing.mix(frame.repartition(7), chunk=64).collect()) and len(got) == len(rows)
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        words, docs = sum(r["taken"] for r in own), sum(r["copies"] for r in own)
        assert abs(words - own[0]["target"]) <= 130 and abs(docs - len(own) * own[0]["target"] / own[0]["source_size"]) < 2
    assert abs(mixing.mixed(frame, chunk=64).count() - sum(r["copies"] for r in got)) <= 4  # chunks of other rows, the same totals


def _fewest(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = random.Random(1)
    for _ in range(400):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(max(1, capacity // rng.choice([3, 5, 10])), capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        histogram = dict(collections.Counter(items))
        fixed, left = packing.reduce_instance(histogram, capacity)
        rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
        best = _fewest(items, capacity)
        assert sum(n for n, _ in fixed) + (_fewest(rest, capacity) if rest else 0) == best
        patterns = packing.plan(histogram, capacity)
        used = collections.Counter()
        for n, pattern in patterns:
            assert n > 0 and sum(x * k for x, k in pattern) <= capacity
            for x, k in pattern:
                used[x] += n * k
        assert used == collections.Counter(items)


def test_packing(some, rows, tokenizer):
    got = packing.pack(some).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc_id, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, r in enumerate(sorted(by.pop(doc_id), key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(np.array(part, "<u4").tobytes()))
            assert k == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids) and (k == 0 or len(ids) > 1024)
    assert not by
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(some.limit(0)).count() == 0
