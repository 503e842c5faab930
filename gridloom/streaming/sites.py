"""Map messages as a stream: the row-local operators run on streams unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import mesh
from gridloom.functions.text import bridge_message


def clicks(messages: DataFrame, json: str = "value") -> DataFrame:
    """type, latitude, longitude, code of map messages, batch or stream."""
    m = messages.select(bridge_message(F.col(json)).alias("m")).select("m.*")
    return m.withColumn("code", mesh.encode(F.col("latitude"), F.col("longitude")))
