"""Files read by ranges and written by tasks, stores that change by commits, imports, solids, held messages."""

import io
import json
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import mesh
from gridloom.operators import extrusion, importing, migrations, snapshots
from gridloom.operators.store import CommitConflict, KeyedStore
from gridloom.sources import citygml, framed, gml_ranges
from gridloom.streaming import messages

HEAD = '<?xml version="1.0" encoding="{}"?>\n<!-- <m:notAMember> --><m:CityModel xmlns:m="http://www.opengis.net/citygml/2.0" xmlns:g="http://www.opengis.net/gml" xmlns:x="http://www.opengis.net/citygml/building/2.0"{}>'


def _member(i, envelope=""):
    own = "" if i % 3 == 0 else f' g:id="b{i}"'
    ring = " ".join(str(i + k) for k in range(12 + i % 5 * 3))
    return f"<m:cityObjectMember><x:Building{own}><g:name>n{i} 東京</g:name>{envelope}<g:Polygon><g:exterior><g:LinearRing><g:posList>{ring}</g:posList></g:LinearRing></g:exterior></g:Polygon></x:Building></m:cityObjectMember>\n"


def _model(members, srs=' srsName="EPSG:6677"', encoding="UTF-8", inside=None):
    env = '<g:boundedBy><g:Envelope srsName="EPSG:1&amp;2"/></g:boundedBy>'
    return (HEAD.format(encoding, srs) + "<g:boundedBy/>" + "".join(_member(i, env if i == inside else "") for i in range(members)) + "</m:CityModel>").encode(encoding)


# --- files ---


@pytest.mark.parametrize("step", [61, 700, 4096, 10**6])
@pytest.mark.parametrize("doc", [_model(40), _model(40, "", inside=25), _model(40, encoding="Shift_JIS"), _model(40, "", "Shift_JIS", inside=3), _model(0), _model(3, encoding="UTF-16")])
def test_ranges_hold_what_the_whole_file_holds(monkeypatch, doc, step):
    monkeypatch.setattr(gml_ranges, "CHUNK", 300)
    whole = list(gml_ranges.buildings("/p/53394611_bldg.gml", io.BytesIO(doc), 0, 1 << 62))
    cut = [r for at in range(0, len(doc), step) for r in gml_ranges.buildings("/p/53394611_bldg.gml", io.BytesIO(doc), at, at + step)]
    assert cut == whole and len(whole) == doc.decode("utf-16" if doc[:2] in gml_ranges.UTF_16 else "shift_jis" if b"Shift" in doc else "utf-8").count("<x:Building")
    assert {r[2] for r in whole} <= {"EPSG:6677", "EPSG:1&2"} and len({r[3] for r in whole}) == len(whole)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a_53394611.gml").write_bytes(_model(400))
    (tmp_path / "a_53394612.gml").write_bytes(b"<broken>")
    at_once = citygml.buildings(spark, str(tmp_path), tiles=["53394611"]).collect()
    uncut = citygml.buildings(spark, str(tmp_path), split_bytes=0, tiles=["53394611"]).drop("building_id").collect()
    assert sorted(uncut) == sorted(r[:4] + r[5:] for r in at_once)
    rows = citygml.buildings(spark, str(tmp_path), split_bytes=10_000, tiles=["53394611"])
    assert len(at_once) == 400 and sorted(rows.collect()) == sorted(at_once)
    assert rows.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 5
    with pytest.raises(Exception, match="ParseError|no element|unclosed"):
        citygml.buildings(spark, str(tmp_path)).collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:  # the filter opens its own file alone
        assert citygml.buildings(spark, str(tmp_path)).filter("file_tile_id = '53394611'").count() == 400
        assert citygml.buildings(spark, str(tmp_path)).filter("file_tile_id IN ('53394611', '1') AND name LIKE 'n1%'").count() == 111
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_feature_files(spark, tmp_path):
    rows = spark.range(200).select(mesh.encode(30 + F.col("id") / 100, 135 + F.col("id") / 90).alias("code"), "id").repartition(3)
    features = mesh.overlay_features(rows, ["id"], "code").select(F.explode("features").alias("text"))
    framed.write_features(features, str(tmp_path / "out"), max_bytes=20_000)
    files = [f for f in (tmp_path / "out").iterdir() if f.is_file()]
    assert len(files) > 10 and len(files) == len(list((tmp_path / "out").iterdir())) and all(f.stat().st_size < 21_000 for f in files)
    got = [json.dumps(x, separators=(",", ":")) for f in files for x in json.loads(f.read_text())["features"]]
    assert len(got) == 1800 and sorted(json.loads(x)["properties"]["meshCode"] for x in got) == sorted(json.loads(r["text"])["properties"]["meshCode"] for r in features.collect())
    framed.write_features(features.limit(5), str(tmp_path / "out"), mode="overwrite")
    assert sum(len(json.loads(f.read_text())["features"]) for f in (tmp_path / "out").iterdir()) == 5
    bad = features.withColumn("text", F.when(F.rand(1) > 0.99, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        framed.write_features(bad, str(tmp_path / "failed"))
    assert not (tmp_path / "failed").exists() or not list((tmp_path / "failed").iterdir())


def test_overlays_of_other_codes(spark):
    rows = spark.createDataFrame([("5339",), ("53394611",), ("00000000",), ("x",)], "code string")
    got = {r["code"]: r["features"] for r in mesh.overlay_features(rows, ["code"], "code").collect()}
    assert [len(got[c]) for c in ("5339", "53394611", "00000000", "x")] == [1, 9, 9, 0]
    near = spark.createDataFrame([("53394611",)], "code string").select(F.transform(mesh.neighbours(F.col("code")), lambda n: n["code"])).first()[0]
    assert [json.loads(f)["properties"]["meshCode"] for f in got["53394611"]] == ["53394611", *near]


# --- stores ---


def _upserts(rng, count, keys):
    return [(f"k{rng.randrange(keys)}", i, f"v{rng.random()}", rng.random() < 0.1) for i in range(count)]


def test_a_store_is_a_dictionary(spark, tmp_path):
    store, plain, rng = KeyedStore(spark, f"file://{tmp_path}/s", buckets=4, logs=("log",)), {}, random.Random(5)
    for k in range(6):
        rows = _upserts(rng, 2000, 700)
        df = spark.createDataFrame(rows, "key string, seq long, value string, deleted boolean")
        store.commit(f"c{k}", {"t": df, "log": df.drop("deleted")})
        for key, _, value, deleted in rows:
            plain.pop(key, None) if deleted else plain.__setitem__(key, value)
        if k == 3:
            store.compact()
    read = lambda: {r["key"]: r["value"] for r in store.read("t").collect()}
    assert read() == plain and store.rows("log").count() == 12_000
    early = {r["key"]: r["value"] for r in store.read("t", store.snapshot(2)).collect()}
    store.compact("t")
    assert read() == plain and store.rows("t").count() == len(plain) and early == {r["key"]: r["value"] for r in store.read("t", store.snapshot(2)).collect()}
    assert store.vacuum() > 0 and read() == plain and store.rows("log").count() == 12_000
    asked = spark.createDataFrame([(f"k{i}",) for i in range(0, 900, 7)], "key string")
    assert {r["key"] for r in store.exists("t", asked).filter("stored").collect()} == {r["key"] for r in asked.collect() if r["key"] in plain}
    with pytest.raises(Exception, match="blank"):
        store.commit("blank", {"t": spark.createDataFrame([(None, "x")], "key string, value string")})


def test_commits_are_whole_and_repeatable(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), buckets=2)
    good = spark.createDataFrame([("a", "1")], "key string, value string")
    broken = good.withColumn("value", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        store.commit("first", {"records": good, "audit": broken})  # dies when half of it has been written
    assert store.snapshot().version == 0 and store.read("records").count() == 0
    assert [store.commit("first", {"records": good}) for _ in range(3)] == [1, 1, 1] and store.rows("records").count() == 1
    assert store.vacuum() == 1  # what the first try left


def test_two_writers_conflict(spark, tmp_path):
    store, one = KeyedStore(spark, str(tmp_path / "s"), buckets=2), spark.createDataFrame([("a", "1")], "key string, value string")
    base = store.snapshot()
    store.commit("x", {"t": one})
    with pytest.raises(CommitConflict):
        store.commit("y", {"t": one}, base)
    assert store._put_new("_commits/" + f"{2:020d}.json", "{}") and not store._put_new("_commits/" + f"{2:020d}.json", "{}")
    # a writer that is overtaken while it writes
    other, both = KeyedStore(spark, str(tmp_path / "o"), buckets=2), threading.Barrier(2)
    stage, results = KeyedStore._stage, []

    class Slow(KeyedStore):
        def _stage(self, *args):
            folder = stage(self, *args)
            both.wait(60)
            return folder

    def run(name):
        try:
            results.append(Slow(spark, other.root, buckets=2).commit(name, {"t": one}))
        except CommitConflict:
            results.append("conflict")

    threads = [threading.Thread(target=run, args=(n,)) for n in "pq"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, results)) == ["1", "conflict"] and other.rows("t").count() == 1


# --- imports ---


def test_history_equals_imports_one_by_one(spark):
    rng, state = random.Random(2), {"tiles": ["z", "b"]}
    rows = [(1, 100 + i // 3, i, rng.choice(["a", "b", "c", " ", None, f"t{rng.randrange(300)}"]), f"p{i}", "CanonicalOrigin", i % 9) for i in range(20_000)]
    for r in rows:
        if r[3] and r[3].strip() and r[3] not in state["tiles"]:
            state["tiles"].append(r[3])
    imports = spark.createDataFrame([*rows, (2, 1, 1, None, "q", "WorkingProjectBasePoint", 4)], "project_id long, at long, seq long, tile string, path string, source string, count int").withColumn("at", F.timestamp_seconds("at")).repartition(6)
    was = spark.createDataFrame([(1, (["z", "b"], None, "old", "s", 1)), (3, (["y"], None, "kept", "s", 2))], f"project_id long, state struct<{importing.STATE.replace(' array', ': array').replace(' timestamp', ': timestamp').replace(' string', ': string').replace(' int', ': int')}>")
    got = {r["project_id"]: r["state"] for r in importing.import_history(imports, was).collect()}
    assert got[1]["tiles"] == state["tiles"] and (got[1]["last_path"], got[1]["last_count"]) == ("p19999", 19_999 % 9)
    assert got[2]["tiles"] == [] and got[3]["last_path"] == "kept" and got[3]["tiles"] == ["y"]


def test_imports_are_committed_with_their_elements(spark, tmp_path):
    facts = [(1, True, False, 2, 1, "a", "f1"), (1, True, False, 1, 2, "b", "f2"), (2, False, False, 1, 3, "a", "f1"), (3, True, True, 1, 4, "a", "f1"), (4, True, False, 0, 5, "a", "f1")]
    rows = spark.createDataFrame(facts, "project_id long, supported boolean, read_only boolean, solids int, seq long, tile string, path string").selectExpr("*", "timestamp_seconds(seq) AS at", "'CanonicalOrigin' AS source", "solids AS count")
    rows = importing.import_outcome(rows)
    assert [r["outcome"] for r in rows.orderBy("seq").collect()] == ["imported", "imported", "unsupported", "read-only", "nothing to import"]
    elements = spark.createDataFrame([(1, "f1", "b1"), (1, "f1", "b2"), (1, "f2", "b1"), (2, "f1", "x")], "project_id long, path string, source_id string")
    store = KeyedStore(spark, str(tmp_path / "s"), buckets=2)
    assert importing.commit_imports(rows, elements, store, "one") == importing.commit_imports(rows, elements, store, "one") == 1
    states = importing.load_import_states(store).collect()
    assert [(r["project_id"], r["state"]["tiles"], r["state"]["last_path"]) for r in states] == [(1, ["a", "b"], "f2")] and store.read("elements").count() == 3
    again = rows.filter("path = 'f1'").withColumn("tile", F.lit("c")).withColumn("at", F.timestamp_seconds(F.lit(99)))
    importing.commit_imports(again, elements, store, "two")
    assert importing.load_import_states(store).first()["state"]["tiles"] == ["a", "b", "c"] and store.read("elements").count() == 3


# --- solids ---


def _area(points):
    x, y = np.array(points, float).T
    return abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2


@pytest.mark.parametrize("ring", [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], [(0, 0), (2, 0), (4, 0), (4, 4), (4, 4), (2, 4), (0, 4), (0, 2)], [(0, 0), (10, 0), (10, 10), (9, 1), (8, 10), (7, 1), (6, 10), (5, 1), (4, 10), (3, 1), (2, 10), (1, 1)]])
@pytest.mark.parametrize("turn", [1, -1])
def test_faces_add_up(ring, turn):
    faces = list(extrusion.faces_of(np.array(ring[::turn], float), 1.0, 3.0))
    flat = [[(p["x"], p["y"]) for p in f[2:]] for f in faces if f[0] == "top"]
    assert sum(map(_area, flat)) == pytest.approx(_area(ring)) and all(extrusion._cross(*(np.array(p) for p in t)) > 0 for t in flat)
    corners = len(extrusion.simple_ring(np.array(ring, float)))
    assert [sum(f[0] == s for f in faces) for s in ("top", "bottom", "wall")] == [corners - 2, corners - 2, 2 * corners]


def test_random_stars_are_cut():
    rng = np.random.default_rng(4)
    for n in rng.integers(3, 60, 60):
        angles = np.sort(rng.random(n)) * 2 * np.pi
        ring = np.stack([np.cos(angles), np.sin(angles)], axis=1) * rng.uniform(0.2, 5, (n, 1))
        if _area(ring) < 1e-3 or max(np.diff(np.append(angles, angles[0] + 2 * np.pi))) >= np.pi:
            continue
        cut = extrusion.triangles(extrusion.simple_ring(ring))
        assert len(cut) == n - 2 and sum(_area(extrusion.simple_ring(ring)[list(t)]) for t in cut) == pytest.approx(_area(ring))


@pytest.mark.parametrize("ring,fault", [([(0, 0), (4, 4), (4, 0), (0, 4)], "no area"), ([(0, 0), (4, 4), (4, 0), (0, 5)], "crosses"), ([(0, 0), (1, 1)], "fewer"), ([(0, 0), (1, 1), (2, 2)], "no area"), ([], "fewer"), ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], "touches")])
def test_rings_that_cannot_be_extruded(spark, ring, fault):
    rows = spark.createDataFrame([(1, [{"x_feet": float(x), "y_feet": float(y)} for x, y in ring], 0.0, 1.0)], "id long, footprint array<struct<x_feet: double, y_feet: double>>, base_feet double, height_feet double")
    got = extrusion.extruded(rows, "id", strict=False).collect()
    assert len(got) == 1 and fault in got[0]["fault"] and got[0]["side"] is None
    with pytest.raises(Exception, match="can't be extruded"):
        extrusion.extruded(rows, "id").collect()


def test_many_rings_are_cut_together(spark):
    """Rings of all sizes and faults in one batch: each gets the faces that it gets alone, and 20,000 of them take seconds, not half a minute."""
    rng, rings = np.random.default_rng(5), [None, [], [(0, 0), (1, 1)], [(0, 0), (4, 4), (4, 0), (0, 5)], [(0, 0), (1, 1), (2, 2)]]
    for n in rng.integers(3, 30, 200):
        angles = np.sort(rng.random(n)) * 2 * np.pi
        rings.append(np.round(np.stack([np.cos(angles), np.sin(angles)], axis=1) * rng.uniform(0.2, 5, (n, 1)), 1)[:: rng.choice([-1, 1])].tolist())
    corners = [None if r is None else [{"x_feet": float(x), "y_feet": float(y)} for x, y in r] for r in rings]
    rows = spark.createDataFrame([(i, x, 1.0, None if i == 9 else 2.0) for i, x in enumerate(corners)], "id long, footprint array<struct<x_feet: double, y_feet: double>>, base_feet double, height_feet double").coalesce(1)
    got = {}
    for f in extrusion.extruded(rows, "id", strict=False).collect():
        got.setdefault(f["id"], []).append((f["side"], f["pos"], *(f[v] and f[v].asDict() for v in "abc")) if f["fault"] is None else f["fault"])
    for i, ring in enumerate(rings):
        try:
            want = list(extrusion.faces_of(np.array(ring or [], float), 1.0, 2.0))
        except ValueError as e:
            want = [str(e)]
        assert got[i] == (["no base or no height"] if i == 9 and len(want) > 1 else want)
    ell, m = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float), 20_000
    began = time.process_time()
    solid, faces = extrusion._solids(np.tile(ell, (m, 1)), np.full(m, 6), np.zeros(m), np.ones(m))
    assert np.bincount(solid).tolist() == [20] * m and faces[0].slice(0, 20).to_pylist() == ["top"] * 4 + ["bottom"] * 4 + ["wall"] * 12
    assert time.process_time() - began < 6


# --- messages ---


def test_messages_wait_until_their_map_is_ready(spark, tmp_path):
    source, name = tmp_path / "in", "held"
    source.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def put(k, rows):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"map_id": m, "seq": s, "body": json.dumps({"type": t})}) for m, s, t in rows))

    def run():
        stream = spark.readStream.schema("map_id string, seq long, body string").option("maxFilesPerTrigger", 1).json(str(source))
        out = messages.held_until_ready(stream)
        query = out.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    def seen(m):
        rows = spark.read.schema(messages.OUT).json(str(tmp_path / "out")).filter(F.col("map_id") == m).collect() if (tmp_path / "out").exists() else []
        return sorted(r["seq"] for r in rows if r["outcome"] == "delivered")

    try:
        put(1, [("a", 2, "x"), ("a", 1, "x"), ("b", 1, "x"), ("c", 1, "READY"), ("c", 2, "x")])
        run()
        assert (seen("a"), seen("b"), seen("c")) == ([], [], [2])
        put(2, [("a", 4, "ready"), ("a", 3, "x"), ("a", 5, "x"), ("b", 2, "x")])  # after a restart
        run()
        assert (seen("a"), seen("b")) == ([1, 2, 3, 5], [])
        put(3, [("b", 3, "Ready"), ("a", 6, "x"), ("a", 7, "ready")])
        run()
        assert (seen("a"), seen("b"), seen("c")) == ([1, 2, 3, 5, 6], [1, 2], [2])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


# --- records and exports ---


def test_records_of_three_versions(spark):
    from gridloom.plans.store_queries import CHAIN

    texts = ['{"Epsg":6677,"Lat":1,"Lon":2,"Turn":3.141592653589793}', '{"SchemaVersion":-1,"Epsg":6677,"Lat":1,"Lon":2,"Turn":3.141592653589793}', '{"SchemaVersion":1,"Crs":{"Code":6677},"Lat":1,"Lon":2,"Turn":3.141592653589793}', '{"SchemaVersion":2,"Crs":{"Code":6677,"Name":"EPSG:6677"},"Origin":{"Lat":1,"Lon":2},"Angle":180}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(CHAIN.read(F.col("t")).alias("r")).collect()
    assert {str(r["r"]) for r in rows} == {"Row(Crs=Row(Code=6677, Name='EPSG:6677'), Origin=Row(Lat=1.0, Lon=2.0), Angle=180.0)"}
    assert spark.range(1).select(CHAIN.read(F.lit("not json"))).first()[0] is None and spark.range(1).select(CHAIN.read(F.lit(None).cast("string"))).first()[0] is None
    with pytest.raises(Exception, match="unsupported schema version 3"):
        spark.range(1).select(CHAIN.read(F.lit('{"SchemaVersion":3}'))).collect()
    with pytest.raises(ValueError):
        migrations.Chain({0: "a int", 2: "a int"}, {0: lambda r: {"a": r["a"]}})


@pytest.mark.parametrize("text,fault", [('{"ProjectId":1}', None), ('{"ProjectId":1,"Title":null,"More":[1]}', None), ('{"ProjectId":1', "not a whole"), ("[1]", "not a whole"), ("", "not a whole"), (None, "not a whole"), ("{}", "missing"), ('{"ProjectId":null}', "missing"), ('{"ProjectId":"1"}', "wrong type: ProjectId"), ('{"ProjectId":1,"ReadOnly":1,"AngleRadians":[2]}', "wrong type: ReadOnly, AngleRadians"), ('{"ProjectId":1,"Title":5}', "wrong type: Title"), ('{"ProjectId":1.5}', "wrong type: ProjectId")])
def test_exports(spark, text, fault):
    r = spark.createDataFrame([(text,)], "value string").select(snapshots.snapshot(F.col("value")).alias("s")).first()["s"]
    assert (r["supported"], r["fault"]) == (True, None) if fault is None else not r["supported"] and r["fault"].startswith(fault)


def test_a_table_of_exports_is_parsed_once(spark):
    """Exports of a table read as each does alone, and the plan parses each text once."""
    texts = [None, "", "[1]", '"x"', "{}", '{"ProjectId":1', '{"ProjectId":7,"Title":"t","ReadOnly":true,"AngleRadians":0.5,"EastWestFeet":1}', '{"ProjectId":"1"}', '{"ProjectId":1,"Title":5,"ElevationFeet":"far"}', '{"ProjectId":1.5,"ReadOnly":null}', '{"ProjectId":1,"ReadOnly":1,"AngleRadians":[2]}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, value string")
    read = snapshots.snapshots(rows)
    alone = rows.select("id", "value", snapshots.snapshot(F.col("value")).alias("s")).select("id", "value", "s.*")
    assert read.columns == alone.columns and read.orderBy("id").collect() == alone.orderBy("id").collect()
    faults = snapshots.quarantine(read)
    assert sum(r["exports"] for r in faults.collect()) == read.filter("NOT supported").count() == 10
    for plan in (read, faults):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
