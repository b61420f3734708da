"""Token counts with a digest cache.

The cache is a table of (text digest, digest of the tokenizer's file) -> count. Texts are
digested in the JVM and joined to it; of the digests that it lacks, one text each is encoded, and
the new counts are appended. All rows then take their counts from the cache. A tokenizer whose
file differs has another version digest, so that old counts are never used for it. Writers that run
at once may append a digest twice: a reader takes each once.

With a warm cache no text moves and none is encoded. Where few are missing, their digests go to the
texts; only where many are, the texts are shuffled to them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respgrid.llm import encoding
from respgrid.llm.common import shared_dir, small, stored, text_or_empty

#: Up to so many missing digests are broadcast.
FEW_MISSES = 20_000
CACHE = "text_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding.of_worker(encoding.PieceCounts, path)
        for whole in batches:
            for batch in encoding.slices(whole):
                counts = pa.array(count(encoding.filled(batch)), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("text_digest"), counts], ["text_digest", "n_tokens"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, text_digest, n_tokens.

    cache: the folder of the cache table, made if it isn't there; without it, a new one.

    Defined cases: a null text counts as an empty one, which has no tokens; rows with equal texts,
    whether or not their doc_id repeats, are encoded once; a null doc_id stays null; an empty table
    gives an empty result; further columns are ignored.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    cache = cache or f"{shared_dir(spark)}/llm-token-cache-{uuid.uuid4().hex}"
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_digest", F.unhex(F.sha2("text", 256)))
    rows = stored(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text_digest"), "text-digests")

    def cached() -> DataFrame:
        found = spark.read.schema(CACHE).parquet(cache) if _exists(spark, cache) else spark.createDataFrame([], CACHE)
        return found.where(F.col("tokenizer_digest") == version).groupBy("text_digest").agg(F.min("n_tokens").alias("n_tokens"))

    # Rows become one for each digest before they meet the cache: a digest that many rows have is no hot key.
    distinct = rows.groupBy("text_digest").agg(F.min("doc_id").alias("__doc"))
    misses = stored(distinct.join(cached(), "text_digest", "left_anti").withColumnRenamed("text_digest", "__digest"), "token-misses")
    if not misses.isEmpty():
        # The texts of one row for each missing digest; (digest, doc_id) has no hot value.
        same = (texts["text_digest"] == misses["__digest"]) & texts["doc_id"].eqNullSafe(misses["__doc"])
        wanted = texts.join(small(misses, FEW_MISSES), same, "left_semi").select("text_digest", "text")
        new = wanted.mapInArrow(_counts(tokenizer), "text_digest binary, n_tokens long").groupBy("text_digest").agg(F.min("n_tokens").alias("n_tokens"))
        new.select("text_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    return rows.join(cached(), "text_digest").select("doc_id", "n_bytes", "text_digest", "n_tokens")
