"""Endpoint timing in JSON: one document a file with a list ``endpoint_timing`` of node_identifier and T_arr (seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "endpoint_timing array<struct<node_identifier: string, T_arr: double>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, node, arrival_ps); a file without the list has no rows, a time that is missing stays null."""
    found = spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.input_file_name().alias("path"), F.explode("endpoint_timing").alias("e"))
    return found.select("path", F.col("e.node_identifier").alias("node"), (F.col("e.T_arr") * 1e12).alias("arrival_ps"))
