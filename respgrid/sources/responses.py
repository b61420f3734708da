"""Captured responses in, bodies and CSV lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respgrid.functions import scalars as S

RESPONSE = "response_id long, request_path string, content_type string, content_disposition string, body binary"


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Responses of a Parquet table, or one for each file under path (binaryFile). Rows without a body are dropped."""
    if fmt == "binaryFile":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        none = F.lit(None).cast("string")
        found = files.select(
            F.xxhash64("path").alias("response_id"), F.col("path").alias("request_path"), none.alias("content_type"), none.alias("content_disposition"), F.col("content").alias("body")
        )
    else:
        found = spark.read.format(fmt).schema(RESPONSE).load(path)
    return found.where(F.col("body").isNotNull())


def savable(detected: DataFrame) -> DataFrame:
    """What would be saved: response_id, file_type, suggested_name, expanded; unknown and empty bodies are left out."""
    return detected.where((F.col("file_type") != "UNKNOWN") & (F.length("expanded") > 0)).select(
        "response_id", "file_type", S.suggested_name(F.col("file_name"), F.col("file_type")).alias("suggested_name"), "expanded"
    )


def write_bodies(detected: DataFrame, path: str) -> None:
    savable(detected).write.mode("append").partitionBy("file_type").parquet(path)


def write_csv_export(lines: DataFrame, path: str) -> None:
    """lines (response_id, sheet_idx, line_no, line) as CSV text files of many sheets: each line follows its key, a sheet's lines lie together in order."""
    dealt = lines.repartition("response_id", "sheet_idx").sortWithinPartitions("response_id", "sheet_idx", "line_no")
    dealt.select(F.concat_ws(",", "response_id", "sheet_idx", "line_no", "line").alias("value")).write.mode("append").text(path)


def read_csv_export(spark: SparkSession, path: str) -> DataFrame:
    """response_id, sheet_idx, line_no and line of an export in which no field has a line break."""
    parts = F.split("value", ",", 4)
    keys = [parts[k].cast(kind).alias(name) for k, (name, kind) in enumerate((("response_id", "long"), ("sheet_idx", "int"), ("line_no", "int")))]
    return spark.read.text(path).select(*keys, parts[3].alias("line"))
