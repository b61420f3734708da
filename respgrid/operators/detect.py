"""Triage of response bodies: detection, the cheap sniff, and what opening a file would show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respgrid.functions import detection as D
from respgrid.functions import scalars as S
from respgrid.limits import DEFAULT, Limits
from respgrid.operators.inflate import expand_body

# What users are told, in the words that results must have.
TOO_LARGE, UNREADABLE, NOTHING_IN_IT = "File is too large to open as a table", "Could not read this ", "No sheets in this file"
OVER = (" exceeds the ", " parse limit")


def _typed(responses: DataFrame, limits: Limits, limit: int | None = None) -> DataFrame:
    """responses expanded, with file_name and file_type. Bodies are read twice: once for those that may be compressed, once for the others."""
    expanded = expand_body(responses, limits, limit)
    named = expanded.withColumn("file_name", S.file_name(F.col("content_disposition"), F.col("request_path")))
    kind = F.when(D.body_ok(F.col("body"), limits), D.classify(F.col("expanded"), F.col("content_type"), F.col("file_name"))).otherwise("UNKNOWN")
    return named.withColumn("file_type", kind)


def detect(responses: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """response_id, file_type, file_name, decompressed, original_length, expanded for each response.

    What isn't recognised, and bodies that are null, empty or over the cap, are UNKNOWN with an empty
    body, no name and length 0.
    """
    known = F.col("file_type") != "UNKNOWN"
    return _typed(responses, limits).select(
        "response_id",
        "file_type",
        F.when(known, F.col("file_name")).alias("file_name"),
        (known & F.col("decompressed")).alias("decompressed"),
        F.when(known, F.length("body")).otherwise(0).alias("original_length"),
        F.when(known, F.col("expanded")).otherwise(F.lit(b"")).alias("expanded"),
    )


def sniff(responses: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """response_id and file_type by a prefix of compressed bodies: cheaper than detect, and on damaged
    or late-marked files it may differ from it."""
    return _typed(responses, limits, limits.sniff_bytes).select("response_id", "file_type")


def renderable(detected: DataFrame) -> DataFrame:
    return detected.where(F.col("file_type") != "UNKNOWN")


def file_header(detected: DataFrame) -> DataFrame:
    """response_id, type_badge, name, gzip and meta: the strip above an opened file."""
    return detected.select(
        "response_id",
        F.upper(S.caption(F.col("file_type"))).alias("type_badge"),
        F.coalesce("file_name", F.lit("(unnamed)")).alias("name"),
        F.col("decompressed").alias("gzip"),
        S.describe_size(F.length("expanded"), F.col("decompressed"), F.col("original_length")).alias("meta"),
    )


def open_status(detected: DataFrame, outcomes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """response_id, file_type, status, title and detail: what opening each file shows.

    outcomes has response_id, sheets (how many were read) and error (null if none).
    """
    shown: Column = S.caption(F.col("file_type"))
    large = F.length("expanded") > limits.tabular_bytes
    status = (
        F.when(F.col("file_type") == "UNKNOWN", "nothing")
        .when(F.col("file_type") == "PDF", "pdf")
        .when(large, "too_large")
        .when(F.col("error").isNotNull(), "error")
        .when(F.coalesce("sheets", F.lit(0)) == 0, "empty")
        .otherwise("ok")
    )
    joined = detected.join(outcomes.select("response_id", "sheets", "error"), "response_id", "left").withColumn("status", status)
    title = (
        F.when(F.col("status") == "too_large", TOO_LARGE)
        .when(F.col("status") == "error", F.concat(F.lit(UNREADABLE), shown))
        .when(F.col("status") == "empty", NOTHING_IN_IT)
        .otherwise("")
    )
    over = F.concat(
        S.human_bytes(F.length("expanded")), F.lit(OVER[0]), S.human_bytes(F.lit(limits.tabular_bytes)), F.lit(OVER[1])
    )
    detail = F.when(F.col("status") == "too_large", over).when(F.col("status") == "error", F.col("error")).otherwise("")
    return joined.select("response_id", "file_type", "status", title.alias("title"), detail.alias("detail"))
