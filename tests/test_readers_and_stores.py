import pytest
from pyspark.sql import functions as F

from gridloom.functions import mesh, projection
from gridloom.operators import importing, reports, workflow
from gridloom.plans.catalogue import _intents
from gridloom.sources import citygml, crs
from gridloom.streaming.sites import clicks

SF = "/root/testdata/sf0.001"
HEAD = '<m:CityModel xmlns:m="http://www.opengis.net/citygml/2.0" xmlns:g="http://www.opengis.net/gml" xmlns:x="http://www.opengis.net/citygml/building/2.0" srsName="urn:ogc:def:crs:EPSG::6677">'
FOOT = "<x:lod0FootPrint><g:MultiSurface><g:surfaceMember><g:Polygon><g:exterior><g:LinearRing><g:posList>{}</g:posList></g:LinearRing></g:exterior></g:Polygon></g:surfaceMember></g:MultiSurface></x:lod0FootPrint>"
SQUARE = "100 150 0 120 150 0 120 170 10 100 170 10 100 150 0"


def _gml(*buildings):
    return HEAD + "".join(f"<m:cityObjectMember>{b}</m:cityObjectMember>" for b in buildings) + "</m:CityModel>"


def test_citygml_file_to_solids(spark, tmp_path):
    nested = f'<x:Building g:id="outer"><g:name>Outer</g:name><x:consistsOfBuildingPart><x:BuildingPart g:id="p">{FOOT.format(SQUARE)}</x:BuildingPart></x:consistsOfBuildingPart></x:Building>'
    (tmp_path / "plateau_53394611_bldg.gml").write_text(
        _gml(f'<x:Building g:id="b1"><g:name>A</g:name>{FOOT.format(SQUARE)}</x:Building>', f"<x:Building>{FOOT.format(SQUARE)}</x:Building>", '<x:Building g:id="no polygon"/>', f'<x:Building g:id="short">{FOOT.format("1 2 3 4 5 6 7 8 9")}</x:Building>', nested)
    )
    rows = citygml.buildings(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and {r["building_id"] for r in rows} >= {"b1", "outer"} and {r["name"] for r in rows} == {"A", "Building", "Outer"}
    assert all((r["epsg_code"], r["file_tile_id"], len(r["ring"])) == (6677, "53394611", 5) for r in rows)
    assert sorted(rows) == sorted(citygml.buildings(spark, str(tmp_path)).collect())  # ids that are made up stay
    anchor = spark.createDataFrame([(6677, 0.0, 0.0, 0.0, 0.0, 0.0)], "epsg int, easting double, northing double, x double, y double, z double").withColumn("k", F.lit(1))
    solid = importing.plan_solids(citygml.buildings(spark, str(tmp_path)).withColumn("k", F.lit(1)), anchor, ["k"]).filter("source_id = 'b1'").first()
    assert (round(solid["footprint"][0]["x_feet"], 3), round(solid["footprint"][0]["y_feet"], 3), round(solid["height_feet"], 3), len(solid["footprint"])) == (328.084, 492.126, 32.808, 4)
    with pytest.raises(Exception, match="CRS"):
        importing.plan_solids(citygml.buildings(spark, str(tmp_path)).withColumn("k", F.lit(1)), anchor.withColumn("epsg", F.lit(6670)), ["k"]).collect()


def test_citygml_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "none.gml").write_text(_gml())
    assert citygml.buildings(spark, str(tmp_path)).count() == 0
    (tmp_path / "none.gml").write_text("<a><b></a>")
    with pytest.raises(Exception, match="mismatched tag"):
        citygml.buildings(spark, str(tmp_path)).count()
    (tmp_path / "none.gml").write_text(_gml(f'<x:Building g:id="b">{FOOT.format(SQUARE.replace("170", "x"))}</x:Building>'))
    with pytest.raises(Exception, match="cannot be cast|CAST_INVALID"):
        citygml.buildings(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        citygml.buildings(spark, " ")


@pytest.mark.parametrize("text,dimension,want", [("0 0 1 1", None, []), ("0 0 1 1 2 2", None, [(0, 0, 1), (1, 2, 2)]), ("0 0 1 1 2 2", 2, [(0, 0, 0), (1, 1, 0), (2, 2, 0)]), ("1\t2\r\n3 4 5 6 7 8", 4, [(1, 2, 3), (5, 6, 7)]), ("1 2 3 4 5 6 7", None, [(1, 2, 0), (3, 4, 0), (5, 6, 0)])])
def test_pos_lists(spark, text, dimension, want):
    got = spark.createDataFrame([(text, dimension)], "t string, d int").select(citygml.coordinates(F.col("t"), F.col("d")).alias("c")).first()["c"]
    assert [tuple(p) for p in got] == [tuple(map(float, p)) for p in want]


def test_codelist_file(spark, tmp_path):
    g = 'xmlns:g="http://www.opengis.net/gml"'
    (tmp_path / "usage.xml").write_text(
        f"<g:Dictionary {g}><g:dictionaryEntry><g:Definition g:id='401'><g:name>Residential Building</g:name></g:Definition></g:dictionaryEntry><g:Definition g:id='402'><g:description>d</g:description></g:Definition>"
        "<g:Definition g:id='401'><g:name>again</g:name></g:Definition><g:Definition g:id='' code='9'/><entry code=' 7 '><name> seven </name></entry></g:Dictionary>"
    )
    assert [tuple(r) for r in citygml.codelist(spark, str(tmp_path)).collect()] == [("401", "Residential Building", ""), ("402", "402", "d"), ("7", "seven", "")]


def test_preview_strings(spark):
    one = _intents(spark, SF).filter("supported AND has_info AND wp_epsg IS NULL").limit(1)
    now = {"i_easting": F.lit(-5992.9196), "i_northing": F.lit(320.0), "i_angle": F.lit(12.5), "i_mode": F.lit(2), "i_anchor": F.lit(0)}
    rows = {r["label"]: r["proposed_value"] for r in workflow.preview(one.withColumns(now)).collect()}
    assert rows["true north"] == "12.500°" and rows["anchor"] == "Survey Point (default)" and rows["coordinate"] == "E -5992.9196 m, N 320.0000 m"


def test_placements_are_committed_and_read_back(spark, tmp_path):
    placed = workflow.apply_placements(_intents(spark, SF), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    store = workflow.project_store(spark, str(tmp_path / "store"))
    old = placed.filter("outcome = 'applied'").limit(1).select("project_id", F.lit('{"SchemaVersion":0}').alias("record"))
    workflow.save_records(old, store, "old")
    assert [r["record"]["SchemaVersion"] for r in workflow.load_records(store).collect()] == [1]
    for _ in range(2):  # the second adds nothing
        assert workflow.commit_placements(placed, store, "all") == 2
    done = placed.filter("outcome = 'applied'").count()
    records = workflow.load_records(store)
    assert records.count() == done > 0 and records.filter("record.SchemaVersion <> 1 OR record.ProjectCrs IS NULL OR record.PrimaryMeshCode IS NOT NULL").count() == 0
    assert workflow.audit_lines(store).count() == done and workflow.latest_audit(store).count() == done
    has = workflow.has_records(store, placed.select("project_id", "outcome"))
    assert has.filter("has_record <> (outcome = 'applied')").count() == 0 and has.count() == placed.count()
    states = spark.createDataFrame([(1, "georeference", "a"), (1, "mesh", "b")], "project_id long, module_id string, envelope string")
    workflow.save_states(states, store, "states")
    asked = spark.createDataFrame([(1, "mesh"), (2, "mesh")], "project_id long, module_id string")
    assert {(r["project_id"], r["envelope"]) for r in workflow.load_states(store, asked).collect()} == {(1, "b"), (2, None)}
    with pytest.raises(Exception, match="blank"):
        workflow.save_states(states.withColumn("module_id", F.lit(" ")), store, "blank")


def test_future_records_are_errors(spark):
    with pytest.raises(Exception, match="unsupported schema version"):
        spark.range(1).select(workflow.read_record(F.lit('{"SchemaVersion":2}'))).collect()


def test_strict_modes(spark):
    with pytest.raises(Exception, match="not a mesh code"):
        spark.createDataFrame([("12345",)], "c string").select(mesh.bounds(F.col("c"), strict=True)).collect()
    rows = spark.createDataFrame([(999999, 35.0, 139.0)], "epsg int, lat double, lon double")
    assert projection.project(crs.with_crs(rows, crs.crs_table(spark))).first()["easting"] is None
    with pytest.raises(Exception, match="unknown EPSG"):
        projection.project(crs.with_crs(rows, crs.crs_table(spark), strict=True)).collect()


def test_projected_points_can_be_filtered_on(spark):
    rows = spark.range(2000).selectExpr("6669 + int(id % 19) AS epsg", "30 + id / 500 AS lat", "130 + id / 300 AS lon")
    there = projection.unproject(projection.project(crs.with_crs(rows, crs.crs_table(spark))), "easting", "northing", "blat", "blon")
    assert there.filter("abs(blat - lat) < 1e-8 AND abs(blon - lon) < 1e-8 AND easting > -1e7").count() == 2000


def test_time_zones(spark):
    got = spark.createDataFrame([(9.0,), (-3.5,), (0.0,), (5.75,)], "h double").select(reports.time_zone(F.col("h"))).collect()
    assert [r[0] for r in got] == ["UTC+9", "UTC-3.5", "UTC0", "UTC+5.75"]


def test_clicks_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"type":"click","latitude":35.67916666666667,"longitude":139.76875}\n{"latitude":1}\nnot json\n')
    query = clicks(spark.readStream.text(str(tmp_path / "in"))).writeStream.format("memory").queryName("clicks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    assert query.awaitTermination(60)
    assert sorted((r["type"], r["code"] or "") for r in spark.table("clicks").collect()) == [("", ""), ("", ""), ("click", "53394611")]
