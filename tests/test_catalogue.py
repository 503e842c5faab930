import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions import mesh, projection
from gridloom.plans.catalogue import ORACLE_SQL, QUERIES
from gridloom.sources import crs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def _plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted([_plain(r[n]) for n in names] for r in got.collect()) == sorted(list(map(_plain, r)) for r in want.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_mesh_samples(spark):
    rows = spark.createDataFrame([(35.67916666666667, 139.76875, "53394611"), (35.6875, 139.78125, "53394622")], "lat double, lon double, want string")
    assert rows.filter(mesh.encode(F.col("lat"), F.col("lon"), 8) != F.col("want")).count() == 0
    around = spark.createDataFrame([("53394611",), ("53394699",)], "code string").select(F.transform(mesh.neighbours(F.col("code")), lambda n: n["code"])).collect()
    assert around[0][0] == ["53394620", "53394621", "53394622", "53394610", "53394612", "53394600", "53394601", "53394602"]
    assert {"53394790", "53395609", "53395700"} <= set(around[1][0])


def test_projection_samples(spark):
    rows = spark.createDataFrame([(6677, 35.681236, 139.767125, -5992.9196, -35363.2377), (6674, 34.693725, 135.502254, -45602.6213, -144799.9949)], "epsg int, lat double, lon double, e double, n double")
    out = projection.project(crs.with_crs(rows, crs.crs_table(spark)))
    for r in projection.unproject(out, "easting", "northing", "blat", "blon").collect():
        assert abs(r["easting"] - r["e"]) < 0.001 and abs(r["northing"] - r["n"]) < 0.001
        assert abs(r["blat"] - r["lat"]) < 1e-9 and abs(r["blon"] - r["lon"]) < 1e-9
