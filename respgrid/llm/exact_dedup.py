"""Exact deduplication by a tree merge of digest runs (DataFrame functions only).

Every text is normalised and digested once; from then on only digests move. Rows are dealt
into runs by a hash of their doc_id: RUNS of them, or FAN_IN times as many as often as needed for runs of
RUN_ROWS rows. A run is reduced to one entry per digest - size and
best row so far - which Spark does with a sorted, map-side combined aggregation. Then, in
log(runs)/log(FAN_IN) rounds, each run takes over FAN_IN - 1 neighbours (binomial rounds with
a multiway merge), so that a digest which a third of all rows share never meets in one task:
a merge reads at most FAN_IN entries for a digest. The last round leaves one entry per digest.
The result goes down the same tree: an entry of a run learns its final row, and a row then
learns it from its own run, so that this join has no hot key either.

An entry's key is SHA-256, a second and independent 64-bit hash, and the byte length of the
normalised text; rows are merged only if all three agree at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respgrid.llm.common import SPACE, stored, text_or_empty, without

#: Runs at the leaves of the tree at least, their rows at most, and how many of them one merge takes in.
RUNS, RUN_ROWS, FAN_IN = 64, 20_000_000, 8
KEY = ["text_sha256", "check64", "norm_bytes"]


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of its text, the key of the normalised text and its code points."""
    text = text_or_empty()
    return (
        docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.length(text).cast("long").alias("points"), F.regexp_replace(text, f"{SPACE}+", "").alias("norm"))
        .select(
            "doc_id",
            "text_hash",
            "points",
            F.sha2("norm", 256).alias("text_sha256"),
            F.xxhash64("norm").alias("check64"),
            F.octet_length("norm").alias("norm_bytes"),
        )
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and text_hash (xxhash64 of the text).

    Of equal texts (equal after white space is deleted) the row with the most code points
    stays, then the one with the smallest doc_id.

    Defined cases: a null text is an empty one, and all texts without other characters than
    white space are one group. Rows that repeat a doc_id and a text count in group_size; where
    that doc_id stays, each of them is marked kept, for they are the same document. A null
    doc_id loses against any other and is kept only in a group without a doc_id. An empty table
    gives an empty result. Further columns are ignored, whatever their names are.
    """
    rows = stored(digested(docs), "digests")
    n, runs = rows.count(), RUNS
    while n > runs * RUN_ROWS:
        runs *= FAN_IN
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"))
    # ~doc_id falls as doc_id rises and, unlike -doc_id, can't overflow.
    best = F.struct("points", F.bitwise_not("doc_id").alias("inverse"))
    leaves = rows.groupBy(*KEY, "run").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("size"))
    merged, width = leaves, runs
    while width > 1:
        width //= FAN_IN
        merged = (
            merged.withColumn("run", F.col("run") % max(width, 1))
            .groupBy(*KEY, "run")
            .agg(F.max("best").alias("best"), F.sum("size").alias("size"))
        )
    final = merged.select(*KEY, F.bitwise_not("best.inverse").alias("keep_id"), F.col("size").alias("group_size"))
    down = leaves.select(*KEY, "run").join(final, KEY)
    return rows.join(down, [*KEY, "run"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "text_hash",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of exact_groups, with all columns of docs."""
    return without(docs, exact_groups(docs).where(~F.col("kept")), one_each=True)
