"""Line deduplication by range-partitioned hashes.

Each line becomes (hash of its key, doc_id, position); the texts stay where they are. The rows are
range-partitioned and sorted by hash, with doc_id (falling) and position as secondary keys, so
that a stream over a partition meets a line's first occurrence - the document that keeps it - before
all others. A line that fills several partitions is no special case: ranges also split by
doc_id, and what a partition can't know of its first and its last line, because they may
go on elsewhere, it reports as pending together with a summary. Summaries, at most two for each
partition, settle the pending rows. The result is a compressed bitmap of kept lines for each document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respgrid.llm import encoding
from respgrid.llm.common import stored, text_or_empty

MIN_POINTS, MIN_DOCS = 20, 3
#: Stands for a null doc_id, which is less than any other.
NO_ID = -(2**63)
WHITE = " \t\n\v\f\r"
DROP, PENDING, SUMMARY = 0, 1, 2
LINES = "line_key binary, doc_id long, text_hash long, pos int"
FOUND = "kind int, line_key binary, doc_id long, text_hash long, pos int, n_docs long"


def _with_id(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _line_rows(min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in encoding.slices(whole):
                parts = pc.split_pattern(batch.column("text"), "\n")
                keys = pc.ascii_lower(pc.utf8_trim(parts.flatten(), characters=WHITE))
                offsets = parts.offsets.to_numpy()
                row = np.repeat(np.arange(len(batch)), np.diff(offsets))
                pos = np.arange(len(row)) - offsets[:-1][row]
                some = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_points).to_numpy(zero_copy_only=False))
                digests = [xxhash.xxh3_128_digest(k) for k in pc.cast(keys.take(pa.array(some)), pa.binary()).to_pylist()]
                at = pa.array(row[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(pos[some], pa.int32())],
                    ["line_key", "doc_id", "text_hash", "pos"],
                )

    return run


def _settle(min_docs: int, keep_first: bool = True, width: int = 16):
    """A partition's rows, sorted by key (of so many bytes), falling doc_id and position -> rows of FOUND."""

    def goes(docs: np.ndarray, first: int) -> np.ndarray:
        return docs != first if keep_first else np.ones(len(docs), bool)

    names = ["kind", "line_key", "doc_id", "text_hash", "pos", "n_docs"]

    def rows(kind: int, table: pa.Table | pa.RecordBatch, some: np.ndarray) -> pa.RecordBatch:
        t = table.take(pa.array(some))
        n = len(some)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *(t.column(c) for c in names[1:5]), pa.nulls(n, pa.int64())], names
        )

    def summary(key: bytes, doc: int, n: int) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((SUMMARY, key, doc, None, None, n), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The line that goes on into the next batch: key, its first and latest document, documents so far,
        # whether it is the partition's first, and rows that wait for min_docs.
        key, first, latest, n, opening, waiting = None, 0, 0, 0, True, []
        for batch in batches:
            if not len(batch):
                continue
            keys = np.array(batch.column("line_key").to_pylist(), dtype=f"S{width}")
            docs = batch.column("doc_id").to_numpy()
            new = np.r_[True, keys[1:] != keys[:-1]]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(keys)]
            other = np.r_[True, docs[1:] != docs[:-1]] | new
            n_docs = np.add.reduceat(other.astype(np.int64), starts)
            whole_keys = batch.column("line_key")
            for_all = np.zeros(len(keys), bool)
            begin = 0
            if key is not None and whole_keys[0].as_py() == key:
                # The open line goes on.
                part = slice(0, ends[0])
                n += int(n_docs[0]) - int(docs[0] == latest)
                latest = int(docs[ends[0] - 1])
                if opening:
                    yield rows(PENDING, batch, np.arange(ends[0]))
                elif n >= min_docs:
                    yield from (rows(DROP, w, np.flatnonzero(goes(w.column("doc_id").to_numpy(), first))) for w in waiting)
                    waiting = []
                    for_all[part] = goes(docs[part], first)
                else:
                    waiting.append(batch.slice(0, ends[0]))
                begin = 1
            if begin < len(starts):
                # A line ends and others follow: the last of them is open.
                if key is not None and opening:
                    yield summary(key, first, n)
                last = len(starts) - 1
                if begin < last or key is not None:
                    inner = slice(begin + (key is None), last)
                    for a, b, count in zip(starts[inner].tolist(), ends[inner].tolist(), n_docs[inner].tolist(), strict=True):
                        if count >= min_docs:
                            for_all[a:b] = goes(docs[a:b], docs[a])
                if key is None and last > 0:
                    # The partition's first line, all in this batch.
                    yield rows(PENDING, batch, np.arange(ends[0]))
                    yield summary(whole_keys[0].as_py(), int(docs[0]), int(n_docs[0]))
                opening = key is None and last == 0
                a, b = int(starts[last]), int(ends[last])
                key, first, latest, n, waiting = whole_keys[a].as_py(), int(docs[a]), int(docs[b - 1]), int(n_docs[last]), []
                if opening:
                    yield rows(PENDING, batch, np.arange(a, b))
                elif n >= min_docs:
                    for_all[a:b] = goes(docs[a:b], first)
                else:
                    waiting = [batch.slice(a, b - a)]
            if for_all.any():
                yield rows(DROP, batch, np.flatnonzero(for_all))
        if key is not None:
            yield summary(key, first, n)
            yield from (rows(PENDING, w, np.arange(len(w))) for w in waiting)

    return run


def repeated(rows: DataFrame, min_docs: int, keep_first: bool = True, width: int = 16) -> DataFrame:
    """doc_id, text_hash and pos of the rows (LINES, stored) whose key at least min_docs documents have; keep_first: but in the largest doc_id."""
    dealt = rows.repartitionByRange("line_key", F.desc("doc_id")).sortWithinPartitions("line_key", F.desc("doc_id"), "text_hash", "pos")
    found = stored(dealt.mapInArrow(_settle(min_docs, keep_first, width), FOUND), "line-decisions")
    # At most two rows for each partition.
    summaries = found.where(F.col("kind") == SUMMARY).groupBy("line_key").agg(F.sum("n_docs").alias("n"), F.max("doc_id").alias("keeps"))
    summaries = summaries.where(F.col("n") >= min_docs)
    pending = found.where(F.col("kind") == PENDING).join(F.broadcast(summaries), "line_key")
    pending = pending.where(F.col("doc_id") != F.col("keeps")) if keep_first else pending
    columns = ["doc_id", "text_hash", "pos"]
    return found.where(F.col("kind") == DROP).select(*columns).unionByName(pending.select(*columns))


def dropped_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash and pos of each line that goes; docs comes from _with_id."""
    return repeated(stored(docs.mapInArrow(_line_rows(min_points), LINES), "lines"), min_docs)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bitmaps, counts = [], []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[gone or []] = False
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            counts.append(n - int(keep.sum()))
        kept = [batch.column(c) for c in ("doc_id", "text_hash", "n_lines")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(bitmaps, pa.binary())], ["doc_id", "text_hash", "n_lines", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per distinct document: doc_id, text_hash, n_lines, n_dropped, keep_bitmap.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    min_points code points in at least min_docs documents lose all their lines except those in the
    largest doc_id. keep_bitmap has a bit for each line, the first line's highest (1: stays),
    compressed with zlib; text_hash is xxhash64 of the text.

    Defined cases: a null or empty text is one empty line, which always stays; rows that repeat doc_id
    and text are one document; rows that repeat a doc_id with other texts count as one document when
    documents are counted, and each has its own bitmap; a null doc_id is a document less than all others. An empty
    table gives an empty result; further columns are ignored.
    """
    own = _with_id(docs)
    gone = dropped_lines(own, min_points, min_docs).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    listed = own.select("doc_id", "text_hash", n_lines.alias("n_lines")).distinct()
    schema = "doc_id long, text_hash long, n_lines long, n_dropped long, keep_bitmap binary"
    return listed.join(gone, ["doc_id", "text_hash"], "left").mapInArrow(_bitmaps, schema)


def _kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, digests = [], []
        for text, bitmap, dropped in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist(), batch.column("n_dropped").to_pylist(), strict=True):
            if dropped:
                lines = text.split("\n")
                keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
                text = "\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])
            texts.append(text)
            digests.append(hashlib.sha256(text.encode()).hexdigest())
        columns = [batch.column(c) for c in ("doc_id", "n_lines", "n_dropped")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def kept_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, and the SHA-256 of the text that its bitmap leaves."""
    with_text = _with_id(docs).join(bitmaps, ["doc_id", "text_hash", ]).select("doc_id", "text", "n_lines", "n_dropped", "keep_bitmap")
    out = with_text.mapInArrow(_kept_texts, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
