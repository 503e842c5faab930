"""Deterministic sites and project snapshots derived from the keys of `customer`.

The driver's tables hold no coordinates, so queries need an input that Spark and an oracle derive alike. All arithmetic
is on integers before the last division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a project snapshot: what the rules of `gridloom.operators` read.
#: A null epsg or lat stands for a missing reference or origin; wp_* is the stored working point, est_* the base point's
#: estimate, bp_* and sp_* base and survey point in feet, pos_* the host's position in feet and radians.
PROJECTS = """
    SELECT c_custkey AS project_id,
           c_custkey % 23 <> 0 AS supported,
           c_custkey % 6 = 0 AS read_only,
           c_custkey % 17 <> 0 AS has_info,
           CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 29 = 0 THEN 999999 ELSE CAST(6669 + c_custkey % 19 AS INT) END END AS epsg,
           'zone ' || CAST(c_custkey % 19 + 1 AS STRING) AS crs_name,
           CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 13 <> 0 THEN CASE WHEN c_custkey % 31 = 0 THEN 10.0D ELSE 24 + (c_custkey * 7919 % 200000) / 10000.0D END END AS lat,
           CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 13 <> 0 THEN 123 + (c_custkey * 104729 % 300000) / 10000.0D END AS lon,
           CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 13 <> 0 THEN (c_custkey * 37 % 6000) - 400.0D END AS elevation,
           CAST(c_custkey % 720 AS DOUBLE) - 360 AS angle,
           CAST(c_custkey % 3 AS INT) AS confidence,
           CASE WHEN c_custkey % 10 = 0 THEN '  ' ELSE 'survey ' || CAST(c_custkey % 4 AS STRING) END AS setup_source,
           CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '53394611' ELSE 'current' END AS mesh,
           CASE WHEN c_custkey % 5 = 0 THEN CAST(6669 + c_custkey % 19 AS INT) END AS wp_epsg,
           'zone ' || CAST(c_custkey % 19 + 1 AS STRING) AS wp_name, CAST(0 AS DOUBLE) AS wp_elevation,
           CASE WHEN c_custkey % 5 < 2 THEN 35 + (c_custkey % 1000) / 1000.0D END AS wp_lat,
           CASE WHEN c_custkey % 5 < 2 THEN 139 + (c_custkey % 1000) / 1000.0D END AS wp_lon,
           CASE WHEN c_custkey % 5 = 0 AND c_custkey % 7 <> 0 THEN c_custkey % 5000 / 10.0D END AS wp_easting,
           CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 7000 / -10.0D END AS wp_northing,
           CASE WHEN c_custkey % 3 <> 0 THEN 34 + (c_custkey % 500) / 500.0D END AS est_lat,
           CASE WHEN c_custkey % 3 <> 0 THEN 138 + (c_custkey % 500) / 500.0D END AS est_lon,
           CAST(c_custkey % 100 AS DOUBLE) AS bp_x, CAST(c_custkey % 50 AS DOUBLE) AS bp_y, CAST(c_custkey % 30 AS DOUBLE) AS bp_z,
           CAST(c_custkey % 90 AS DOUBLE) AS sp_x, CAST(c_custkey % 40 AS DOUBLE) AS sp_y, CAST(c_custkey % 20 AS DOUBLE) AS sp_z,
           CASE WHEN c_custkey % 9 <> 0 THEN 33.5D END AS site_lat, CASE WHEN c_custkey % 9 <> 0 THEN 135.25D END AS site_lon,
           CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 105 - 48) / 4.0D END AS site_hours,
           CAST(c_custkey % 3 AS DOUBLE) * 0.00009 AS pos_east, CAST(c_custkey % 4 AS DOUBLE) AS pos_north,
           CAST(c_custkey % 8 AS DOUBLE) AS pos_elevation, CAST(c_custkey % 2 AS DOUBLE) * 0.25 AS pos_angle
    FROM customer
"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each customer: site_id, lat, lon, epsg, east, north (metres)."""
    key = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.alias("site_id"),
        (24 + (key * 7919 % 200000) / F.lit(10000.0)).alias("lat"),
        (123 + (key * 104729 % 300000) / F.lit(10000.0)).alias("lon"),
        (6669 + key % 19).cast("int").alias("epsg"),
        ((key * 31 % 200000) - 100000.0).alias("east"),
        ((key * 17 % 300000) - 150000.0).alias("north"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project snapshots; a stored mesh code of 'current' is the one that belongs to the origin."""
    from gridloom.functions import mesh

    rows = spark.sql(PROJECTS.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return rows.withColumn("mesh", F.when(F.col("mesh") == "current", mesh.encode(F.col("lat"), F.col("lon"))).otherwise(F.col("mesh")))
