"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes all rows that its predecessor kept. All but the last return the columns
of documents; the last returns one row per piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from respgrid.llm import exact_dedup, mixing, ngram_quality, packing, simhash
from respgrid.llm.common import remove, written
from respgrid.llm.queries import tokenizer

#: Consecutive documents of the mixture that are packed together.
RANGE = 16_384


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules, or lie outside their language's perplexity band, go."""
    return ngram_quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one row stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, laid out in the order of the mixture: files hold contiguous ranges of it."""
    return mixing.in_mix_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a sequence has documents of one range of the mixture, and sequences are numbered in its order."""
    return packing.packed(mixing.with_ranges(docs, RANGE), tokenizer("word_bpe_49k.json"), ranged=True)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources", mix),
    ("packing", pack),
]
#: Hashes, tokens and the model aren't SQL's: tests/llm/test_pipeline_run.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stored before the next; a stage's table goes when the next one's is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = written(docs, f"stage-{k}")
            docs = spark.read.schema(docs.schema).parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
