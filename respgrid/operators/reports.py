"""Reports over a whole collection. Bodies are dropped before anything is grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triage_summary(detected: DataFrame) -> DataFrame:
    """file_type, files, wire_bytes, expanded_bytes, compressed."""
    slim = detected.select("file_type", "original_length", F.length("expanded").alias("n"), "decompressed")
    return slim.groupBy("file_type").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.col("original_length").cast("long")).alias("wire_bytes"),
        F.sum(F.col("n").cast("long")).alias("expanded_bytes"),
        F.count_if("decompressed").alias("compressed"),
    )


def open_summary(status: DataFrame) -> DataFrame:
    """file_type, status, files."""
    return status.groupBy("file_type", "status").agg(F.count(F.lit(1)).alias("files"))
