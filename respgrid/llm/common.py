"""What several operators share: scratch tables in the shared folder, and safe column names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that the operators' contracts name: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
#: Up to so many rows of a few numbers a table is broadcast: some ten MB at most.
BROADCAST_ROWS = 200_000
_own: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only on one machine, as in tests, it may be
    unset: then a temporary folder is made and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = id(spark.sparkContext)
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return f"file://{_own[key]}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "snappy") -> str:
    """The path of a new table in the shared folder, to which df is written."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """df, written to a new table in the shared folder and read again.

    This cuts the lineage: what was computed survives the loss of any executor, and is
    computed once however often it is read.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name, partition_by, codec))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a stored table of a few narrow columns, marked for broadcasting if it has no more than so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(docs: DataFrame, gone: DataFrame, one_each: bool = False) -> DataFrame:
    """The rows of docs whose doc_id and text (by its xxhash64) aren't in gone (doc_id, text_hash), with all their columns.

    one_each: of rows that repeat a doc_id and a text, one stays. Texts move only where so many rows go that their ids
    are too many to be broadcast, or where they repeat.
    """
    names = {"doc_id": "__doc", "text_hash": "__gone"}
    same = (F.col("__hash") == F.col("__gone")) & F.col("doc_id").eqNullSafe(F.col("__doc"))
    rows = docs.withColumn("__hash", F.xxhash64(text_or_empty()))
    gone = stored(gone.select(*[F.col(a).alias(b) for a, b in names.items()]).distinct(), "gone")
    kept = rows.join(small(gone), same, "left_anti")
    if one_each:
        often = rows.groupBy(F.col("doc_id").alias("__doc"), F.col("__hash").alias("__gone")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        often = small(stored(often.drop("n"), "repeated"))
        first = Window.partitionBy("__hash", "doc_id").orderBy("__hash")
        once = kept.join(often, same, "left_semi").withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
        kept = kept.join(often, same, "left_anti").unionByName(once)
    return kept.select(*docs.columns)
