import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from gridloom.llm import hilbert_ann, quality, toxicity, url_filter, warc
from gridloom.llm.common import scratch_path
from gridloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_matcher_is_levenshtein():
    rng = np.random.default_rng(3)
    letters = list("abcde")
    words = ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(25)]
    begins = ["zz", "abcdead"]
    match = toxicity.Matcher(words, begins, keep=500)
    for i in range(4000):
        t = "".join(rng.choice(letters, rng.integers(0, 9)))
        if i % 4 == 0:  # something that begins nearly as the long beginning does
            at = rng.integers(0, 7)
            t = "abcdead"[:at] + "".join(rng.choice(letters, rng.integers(0, 3))) + "abcdead"[at + rng.integers(0, 2) :] + t
        exact = t in words or any(t.startswith(b) for b in begins)
        near = any(len(w) >= toxicity.FUZZY_FROM and lev(w, t) <= 1 for w in words)
        near = near or any(len(b) >= toxicity.FUZZY_BEGINNING and lev(b, t[:k]) <= 1 for b in begins for k in range(len(t) + 1))
        assert match(t) == (1 if exact else 2 if near else 0), t
    assert match("zzab") == 1 and match("za") == 0


@pytest.mark.parametrize("text,want", [('he said "you idiot" then', True), ("you idiot said", False), ('"a" idiot "b"', False), ("> idiot\n", True), ("x\n> y\nidiot", False), ("« idiot »", True), ('"idiot', False)])
def test_quoted(text, want):
    at = text.index("idiot")
    assert toxicity.quoted(text, at, at + 5) is want


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(truth[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in truth]
    hits = sum(t and p for t, p in held)
    assert hits / sum(t for t, _ in held) > 0.85 and hits / sum(p for _, p in held) > 0.9


def test_toxicity_learns_and_catches_misspellings(spark, docs_of):
    rng = np.random.default_rng(0)
    vocab = [f"{a}{b}{c}" for a in ("ka", "mo", "ti") for b in ("ran", "sel", "du") for c in ("", "ing", "or", "al")]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(vocab, 30))
        if i % 6 == 0:
            words[rng.integers(30)] = "grobulent"
            words[rng.integers(30)] = "vexnosh"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000, "you are grobulemt and vexnsh again"), (1001, "karan model tisel"), (1002, None), (1003, "")]
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[1000]["exact"] + got[1000]["misspelled"] == 2 and got[1000]["misspelled"] and got[1000]["score"] > got[1001]["score"]
    assert got[1002]["score"] == got[1003]["score"] < 0.3 and got[1001]["score"] < 0.3 and got[1000]["predicted"] == 1
    assert all(got[i]["predicted"] == (i % 6 == 0) for i in range(600))


def test_misspelled_insults_stay_toxic(spark, tmp_path):
    """The whole query over sf0.1, with copies of its toxic rows in which one letter of each English insult is changed; and very long texts and words."""
    insults, rng = "idiot|stupid|pathetic|worthless|disgusting|loser|trash|clown", np.random.default_rng(8)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))

    def other(m):
        at = int(rng.integers(1, len(m[0])))
        return m[0][:at] + "x" + m[0][at + 1 :]

    toxic = docs.join(labels.filter("toxic = 1").select("doc_id"), "doc_id").filter(f"text RLIKE '(?i)\\\\b({insults})\\\\b'").collect()
    rows = [(10**7 + r["doc_id"], re.sub(rf"(?i)\b({insults})\b", other, r["text"])) for r in toxic]
    long = [(2 * 10**7, "plain " * 300_000), (2 * 10**7 + 1, "p" * 2_000_000), (2 * 10**7 + 2, None)]
    extra = spark.createDataFrame(rows + long, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, str(tmp_path)).collect()}
    base = [r["doc_id"] for r in toxic if got[r["doc_id"]]["predicted"]]
    assert len(base) > 150 and sum(got[10**7 + i]["predicted"] for i in base) >= 0.97 * len(base)
    assert all(got[i]["predicted"] == 0 for i, _ in long)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    clean = [i for i in truth if truth[i] == 0]
    assert sum(got[i]["misspelled"] > 0 for i in clean) <= 0.002 * len(clean)


def test_quotations_are_told_from_abuse(spark, docs_of):
    rng = np.random.default_rng(1)
    vocab = [f"{a}{b}" for a in ("ka", "mo", "ti", "re") for b in ("ran", "sel", "dun", "lor", "mip")]
    rows, labels = [], []
    for i in range(900):
        words = " ".join(rng.choice(vocab, 25))
        said = (f"you {rng.choice(vocab)} grobulent", f'{rng.choice(vocab)} said "{rng.choice(vocab)} grobulent" there', "")[i % 3 if i % 2 else 2]
        rows.append((i, f"{words} {said} {rng.choice(vocab)}"))
        labels.append((i, 1, int(said.startswith("you"))))
    rows += [(2000, "moran you ransel grobulent tisel"), (2001, 'moran said "ransel grobulent" tisel'), (2002, "> ransel grobulent tisel"), (2003, "moran you ransel grobulemt tisel")]
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [got[i]["predicted"] for i in (2000, 2001, 2003)] == [1, 0, 1] and got[2002]["score"] < got[2000]["score"] and got[2001]["quoted"] == 1
    assert np.mean([got[i]["predicted"] == t for i, _, t in labels]) > 0.97


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs_of([(1, "a"), (None, None), (1, "a")]), none).collect()
    assert len(got) == 3 and all(r["predicted"] == 0 for r in got)
    assert toxicity.score(docs_of([]), none).count() == 0


def test_quality(spark, docs_of):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r["accepted"] for r in quality.score(docs).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = [got[i] for i, q in truth.items() if q == 1], [got[i] for i, q in truth.items() if q == 0]
    assert sum(good) / len(good) > 0.98 and 1 - sum(bad) / len(bad) > 0.9
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, a in got.items() if a)


def test_quality_is_fitted_on_all_rows(spark, monkeypatch):
    """More rows than any sample of 10,000: weights, cut and scores are those of all of them, repeated rows once."""
    rng, n = np.random.default_rng(6), 13_000
    bad = rng.random(n) < 0.3
    patterns = np.where(bad, 1 + 3 + 9, 2 + 6 + 18) + 27 * rng.integers(0, 3, n)
    rows = []
    for i in range(n):
        x = np.bincount(rng.integers(0, 40, 30) + (20 if bad[i] else 0), minlength=quality.FEATURES)
        at = np.flatnonzero(x)
        rows.append((i, i, int(patterns[i]), at.astype("<u2").tobytes() + x[at].astype("<u4").tobytes(), 15))
    voted = spark.createDataFrame(rows + rows[:50], "doc_id long, h long, pattern int, x binary, n long").repartition(5)
    held, of_all = [], quality._curve_of_all
    monkeypatch.setattr(quality, "_curve_of_all", lambda rows, *more: held.append(rows.count()) or of_all(rows, *more))
    w, share, cut = quality.fitted(voted)
    kinds, counts = np.unique(np.append(patterns, patterns[:50]), return_counts=True)
    good, _, same = quality.label_model(kinds, counts.astype(float))
    y, x = good[np.searchsorted(kinds, patterns)], quality.dense([r[3] for r in rows], np.full(n, 15))
    want = quality._linear(x, y)
    scores = quality.chance(x, np.full(n, 15), want, share)
    assert set(held) == {n} and share == same and np.abs(w - want).max() < 1e-6
    assert cut == pytest.approx(min(0.5, np.quantile(scores[y > quality.SURE], quality.LOSS)), abs=1e-9)
    numbers = [0.25, 0.1, 0.1, 0.9, 0.5, 0.7, 1e-9]
    keys = spark.createDataFrame([(int(np.float64(v).view(np.int64)),) for v in numbers], "key long")
    assert [quality.quantile(keys, q) for q in (0, 0.1, 0.3, 0.5, 1)] == pytest.approx([np.quantile(numbers, q) for q in (0, 0.1, 0.3, 0.5, 1)], rel=1e-12)
    assert quality.quantile(keys.limit(0), 0.5) is None


def test_quality_odd_rows(docs_of):
    few = docs_of([(1, None), (1, None), (None, ""), (2, " \n"), (3, "A plain sentence that is fine.")])
    assert quality.accepted(few).count() == 5
    assert quality.accepted(docs_of([])).count() == 0 and quality.score(docs_of([])).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(8)
    n, k = 20_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.85
    hit = np.linspace(0.3, 0.8, k)
    cast = rng.random((n, k)) < 0.9
    bad = np.where(good[:, None], rng.random((n, k)) < 0.001, rng.random((n, k)) < hit)
    votes = np.where(cast, np.where(bad, 1, 2), 0)
    patterns, counts = np.unique((votes * 3 ** np.arange(k)).sum(axis=1), return_counts=True)
    _, chance, share = quality.label_model(patterns, counts.astype(float))
    assert abs(share - 0.85) < 0.02 and np.abs(chance[0] - hit).max() < 0.05


def test_warc(spark, tmp_path):
    long = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a/1", long, "x"), (2, "http://a/2", long, "x"), (3, None, long, "x"), (4, "http://b/\r\nX: y", "short", "x"), (5, "http://b", "short", "x"), (6, "u", None, "x"), (7, "u", "", "x"), (8, "u", "z" * 1000, "x"), (8, "u", "z" * 1000, "x"), (9, "u", "z" * 999, "x"), (10, "u", "z" * 999, "x"), (None, "u", "n" * 2000, "x"), (None, "v", "n" * 2000, "x"), (12, "u", "n" * 3000, "x"), (None, "v", "n" * 3000, "x"), (13, "v", "a\r\n\r\nb" * 200, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "warc")
    warc.write_archive(pages, path)
    payloads = {r["sha256"]: bytes(r["payload"]) for r in spark.read.parquet(f"{path}/payloads").collect()}
    assert len(payloads) == len({(r[2] or "") for r in rows}) and all(hashlib.sha256(v).hexdigest() == k for k, v in payloads.items())
    got = collections.defaultdict(list)
    for r in warc.read_index(spark, path).collect():
        got[r["page_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for page, url, html, _ in rows:
        body = (html or "").encode()
        for r in got[page] if page is not None else ():
            assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
    assert [(p, got[p][0]["record_type"], got[p][0]["refers_to"]) for p in (1, 2, 3, 4, 5, 8, 9)] == [(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None), (8, "response", None), (9, "response", None)]
    all_records = [bytes(r["record"]) for r in warc.read_records(spark, path).collect()]
    field = lambda r, name: re.search(rf"\r\n{name}: ([^\r\n]*)".encode(), r.partition(b"\r\n\r\n")[0])
    assert len({field(r, "WARC-Record-ID")[1] for r in all_records}) == len(all_records) == len(rows)
    records = {int(field(r, "X-Page-ID")[1]): r for r in all_records if field(r, "X-Page-ID")}
    head, _, rest = records[3].partition(b"\r\n\r\n")
    block = rest[: -len(b"\r\n\r\n")]
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI" not in head
    assert int(head.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0]) == len(block)
    assert block.partition(b"\r\n\r\n")[2] == long.encode()
    assert [(r["record_type"], r["refers_to"]) for r in got[None] if r["payload_bytes"] == 2000] == [("response", None)] * 2
    assert [(r["record_type"], r["refers_to"]) for r in got[None] if r["payload_bytes"] == 3000] == [("revisit", 12)]
    assert b"\r\nX: y" not in records[4] and records[1].endswith(b"\r\n\r\n\r\n\r\n")
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_refuses_a_changed_payload(spark):
    path = scratch_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "encode('other', 'UTF-8') AS payload", "records").collect()
    spark.createDataFrame(bad, "sha256 string, payload binary, records long").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_index(spark, path).collect()


def test_hilbert_curve_is_a_curve():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_ann.hilbert_keys(cells, 3)
    order = np.argsort(keys)
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def _brute(ids, vecs, every, k):
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        far = np.sqrt(((vecs - vecs[ids == q][0]) ** 2).sum(axis=1))
        near = np.flatnonzero(ids != q)
        order = near[np.lexsort((ids[near], far[near]))][:k]
        out[q] = [(int(ids[i]), float(far[i])) for i in order]
    return out


def test_ann_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in sorted(QUERIES["op8_hilbert_ann"](spark, "/root/testdata/sf0.1").collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    data = rows.collect()
    ids, vecs = np.array([r["vec_id"] for r in data]), np.array([r["embedding"] for r in data], np.float32).astype(float)
    want = _brute(ids, vecs, 100, 10)
    assert got.keys() == want.keys()
    by = dict(zip(ids.tolist(), vecs, strict=True))
    for q, found in got.items():
        assert [len(found), [s for _, s in found]] == [10, sorted(s for _, s in found)]
        assert all(abs(s - math.sqrt(((by[v] - by[q]) ** 2).sum())) < 1e-12 for v, s in found)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9


@pytest.mark.parametrize("small", [False, True])
def test_ann_recall_at_thirty_thousand(spark, monkeypatch, small):
    if small:  # ranges and queries in many parts: the same neighbours
        monkeypatch.setattr(hilbert_ann, "RANGE", 200)
        monkeypatch.setattr(hilbert_ann, "QUERIES", 20)
    rng = np.random.default_rng(12)
    n, every = (3_000, 20) if small else (30_000, 100)
    vecs = rng.normal(size=(n, 64)).astype(np.float32)
    vecs[::2] += 4 * rng.normal(size=(20, 64)).astype(np.float32)[rng.integers(0, 20, len(vecs[::2]))]  # half of them in clusters
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": vecs.tolist()}), "vec_id long, embedding array<float>").repartition(8)
    got = collections.defaultdict(set)
    for r in hilbert_ann.nearest(frame, query_every=every).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = _brute(np.arange(n), vecs.astype(float), every, 10)
    recall = np.mean([len(got[q] & {v for v, _ in want[q]}) / 10 for q in want])
    assert len(want) == n // every and recall >= 0.9, recall


@pytest.mark.parametrize("spread,far", [(0.01, False), (0.003, True)])
def test_ann_recall_in_a_dense_cluster(spark, spread, far):
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(6000, 64))
    dense = np.arange(0, 6000, 3)
    vecs[dense] = rng.normal(size=64) + spread * rng.normal(size=(2000, 64))
    if far:
        vecs[1] *= 1e6
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in hilbert_ann.nearest(frame, query_every=30).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = _brute(np.arange(6000), vecs, 30, 10)
    recall = np.mean([len(got[q] & {v for v, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9, recall


def test_ann_odd_rows(spark):
    nan = float("nan")
    rows = [(i, [float(i % 7), 1.0, 2.0]) for i in range(1, 40)] + [(100, [1.0, 1.0, 2.0]), (200, [1.0, 1.0, 2.0]), (200, [1.0, 1.0, 2.0]), (300, None), (400, [0.0, 0.0, 0.0]), (500, [nan, 1.0, 1.0]), (600, [None, 1.0, 1.0]), (700, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(hilbert_ann.nearest(frame).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ok = [(i, v) for i, v in dict((i, v) for i, v in rows if i and v and len(v) == 3 and i not in (400, 500, 600)).items()]
    assert got == _brute(np.array([i for i, _ in ok]), np.array([v for _, v in ok]), 100, 10)
    assert hilbert_ann.nearest(frame.limit(0)).count() == 0
    assert hilbert_ann.nearest(spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0


def test_url_rules(spark):
    rows = [
        (1, "http://www.EXAMPLE.com/en/7x?q", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        (3, "x://com/en/", "com", "/en/", "com/en/", "block"),
        (4, "http://a.net/de/1#f", "a.net", "/de/1", "net/de/", "allow"),
        (5, "http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        (6, "http://internet/de/", "internet", "/de/", None, None),
        (7, None, "", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, "http://h.org?x=/es/", "h.org", "", None, None),
        (10, "http://h.org:80/es/", "h.org:80", "/es/", None, None),
        (11, "a://b\n/c://d", "b\n", "/c://d", None, None),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "html", "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for page, _, host, path, rule, verdict in rows:
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_models(spark):
    model = url_filter.CharModel(2)
    for t in ("abab", "abba", "aab"):
        model.learn(t)
    # the chances of all characters that may follow a context, seen or not, sum up to one
    for context in ("ab", "ba", "zz"):
        seen = [model.chance(context + c) for c in ("a", "b", url_filter.END)]
        rest = model.chance(context + "q") * (65536 - 3)
        assert abs(sum(seen) + rest - 1) < 1e-9
    rows = [(i, f"http://s{i}.com/en/{i}") for i in range(200)] + [(1000 + i, f"http://s{i}.net/de/{i}") for i in range(200)] + [(5000, "http://q.com/fr/5"), (5001, "http://q.net/fr/5")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[5000] == "block" and got[5001] == "allow"


def test_url_models_count_all_labelled_urls(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh漢"), rng.integers(3, 9)))
    # 12,000 rows of each kind, more than fixed samples of 8000 hold
    urls = [f"http://{word()}.com/en/{word()}" for _ in range(12_000)] + [f"http://{word()}.net/de/{word()}" for _ in range(12_000)] + [f"http://{word()}.{t}/fr/{word()}" for t in ("com", "net") for _ in range(200)]
    monkeypatch.setattr(url_filter, "BLOCK", 1000)
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = url_filter.judge(rows).join(rows, "page_id").selectExpr("*", "xxhash64(url) AS hash").collect()
    text = lambda r: r["url"]
    labelled = {text(r): r for r in got if r["rule"] is not None}
    models, held = {}, {}
    for verdict in ("allow", "block"):
        own = [r for r in labelled.values() if r["verdict"] == verdict]
        low, high = (f(r["hash"] for r in own) for f in (min, max))
        held[verdict] = [r["score"] for r in own if r["hash"] == high or r["hash"] % 2 and r["hash"] != low]
        models[verdict] = url_filter.CharModel()
        for r in own:
            if not (r["hash"] == high or r["hash"] % 2 and r["hash"] != low):
                models[verdict].learn(text(r))
    chance = {v: lambda g, m=m: math.log(m.chance(g)) for v, m in models.items()}
    for r in got[::50]:
        grams = url_filter.grams(text(r))
        want = sum(chance["allow"](g) - chance["block"](g) for g in grams) / (len(text(r)) + 1)
        assert abs(r["score"] - want) < 1e-9
    # the cut is the best for all held-out urls
    wrong = lambda cut: sum(x < cut for x in held["allow"]) / len(held["allow"]) + sum(x >= cut for x in held["block"]) / len(held["block"])
    free = [r for r in got if r["rule"] is None]
    low, high = max(r["score"] for r in free if r["verdict"] == "block"), min(r["score"] for r in free if r["verdict"] == "allow")
    assert low < high and min(map(wrong, (low, high))) <= min(map(wrong, sorted(held["allow"])[:: len(held["allow"]) // 200])) + 0.01


def test_url_models_see_the_whole_url(spark):
    rows = [(i, f"http://s{i}.com/en/{i}?casino={i}#win") for i in range(200)] + [(1000 + i, f"http://s{i}.net/de/{i}?lesson={i}#top") for i in range(200)]
    rows += [(5000, "http://q.at/fr/5?casino=7#win"), (5001, "http://q.at/fr/5?lesson=7#top"), (5002, "s9.com/en/9?casino=9#win"), (5003, None), (5004, "")]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i]["verdict"] for i in range(5000, 5005)] == ["block", "allow", "block", "allow", "allow"]
    assert (got[5000]["host"], got[5000]["path"], got[5000]["rule"]) == ("q.at", "/fr/5", None) and got[5002]["host"] == got[5002]["path"] == ""
    assert got[5000]["score"] != got[5001]["score"] and got[5003]["score"] == got[5004]["score"]


def test_url_threshold():
    rng = np.random.default_rng(1)
    bins = sorted((float(x), float(x), int(a), int(b)) for x, a, b in zip(rng.normal(size=50), rng.integers(0, 3, 50), rng.integers(0, 3, 50), strict=True))
    allowed, blocked = sum(x[2] for x in bins), sum(x[3] for x in bins)
    wrong = lambda cut: sum(x[2] for x in bins if x[0] < cut) / allowed + sum(x[3] for x in bins if x[0] >= cut) / blocked
    assert abs(wrong(url_filter.threshold(bins)) - min(wrong(x[0] + d) for x in bins for d in (0, 1e-9))) < 1e-12
    assert url_filter.threshold([(0.0, 1.0, 0, 3), (2.0, 3.0, 2, 0)]) == 1.5
