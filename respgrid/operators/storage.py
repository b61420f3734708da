"""Tables that are written once and read by what follows, and what they leave on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark removes the shuffle files of an execution at its end, and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a few numbers that are broadcast; rows of a task, about, where rows are dealt by a key.
FEW, ROWS = 200_000, 1 << 19


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    """df, written to path. Nothing reads its shuffles again, so that they go with the end of the writing."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").partitionBy(*partition_by).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame) -> DataFrame:
    """df, a stored table of a few numbers a row, marked for broadcasting if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def dealt(rows: DataFrame, *keys: str, most: int = ROWS) -> DataFrame:
    """rows, dealt by keys into so many tasks that none has many more rows than most, where the session's number of tasks doesn't do.

    Then what is made of a task's rows fits into its memory, and sorts of it leave nothing on disk.
    """
    n = -(-rows.count() // most)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
