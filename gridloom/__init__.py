"""Spark-native geospatial rules, mesh analytics and CityGML ingestion."""
