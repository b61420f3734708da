"""Vectors compressed to codes of one byte a part, by codebooks trained on weighted distinct parts.

A vector's components become integers and are cut into parts. Equal parts at a position are one row with a weight, so that
copies, however many, cost nothing more: Lloyd's rounds run over these rows only. A round sends each task the codebooks (a fixed
size), finds each row's nearest entry and brings back weighted sums, at most one row for each entry and task. The last
assignment gives each distinct part its code and error, and both are joined back to the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respgrid.llm.common import BROADCAST_ROWS, small, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components beyond this would take squared distances out of 64 bits.
LARGEST = 2**28
#: Up to this, distances are exact in doubles.
EXACT = 2**22
#: Rows whose distances are in memory at once.
AT_ONCE = 4096


@dataclass(frozen=True)
class Codebooks:
    """entries: parts x entries x components of a part, integers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that can be used, the integers of all their components, and how many each has."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(vectors.flatten(), pa.float64())
    known = np.floor(np.asarray(pc.fill_null(flat, np.nan)) * scale)
    with np.errstate(invalid="ignore"):
        fine = np.abs(known) <= LARGEST
    ends = np.r_[0, np.cumsum(lengths)]
    bad = np.r_[0, np.cumsum(~fine)]
    rows = np.flatnonzero((bad[ends[1:]] == bad[ends[:-1]]) & (lengths > 0))
    use = np.repeat(np.isin(np.arange(len(lengths)), rows), lengths)
    return rows, known[use].astype(np.int64), lengths[rows]


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ints (the components floor(scale * x), 64 bits each, little-endian) of the vectors without null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ints, lengths = _integers(batch.column("embedding"), scale)
            offsets = np.r_[0, np.cumsum(lengths * 8)].astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(ints.astype("<i8").tobytes())])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), packed], ["vec_id", "label", "ints"])

    kinds = dict(vectors.dtypes)
    label = F.col("label") if "label" in kinds else F.lit(None).cast("int").alias("label")
    own = vectors.select("vec_id", label, F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds.get('label', 'int')}, ints binary")


def _smallest(entries: int):
    """The rows with the smallest ids that a task has, one for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        for batch in batches:
            # Only ids that may be among the smallest are looked at one by one.
            top = pc.array_sort_indices(batch.column("vec_id"))
            for k in top.to_pylist():
                key, ints = batch.column("vec_id")[k].as_py(), batch.column("ints")[k].as_py()
                if len(held) >= entries and key not in held and key > max(held):
                    break
                held[key] = min(ints, held.get(key, ints))
                if len(held) > entries:
                    del held[max(held)]
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.binary())], ["vec_id", "ints"])

    return run


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the smallest ids, one vector (of several the one whose packed integers are least) for each id; None if there are none."""
    own = kept.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "ints")
    few = own.mapInArrow(_smallest(entries), "vec_id long, ints binary").groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy("vec_id").limit(entries).collect()
    if not few:
        return None
    width = len(few[0]["ints"])
    found = np.stack([np.frombuffer(r["ints"], "<i8") for r in few if len(r["ints"]) == width])
    if found.shape[1] % parts:
        raise ValueError(f"vectors of {found.shape[1]} components can't be cut into {parts} equal parts")
    return Codebooks(np.ascontiguousarray(found.reshape(len(found), parts, -1).transpose(1, 0, 2)))


def _nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, ties to the lower index, and its squared distance."""
    codes, errors = [], []
    small_numbers = max(np.abs(entries).max(initial=0), np.abs(rows).max(initial=0)) <= EXACT
    for k in range(0, len(rows), AT_ONCE):
        some = rows[k : k + AT_ONCE]
        if small_numbers:  # whole numbers below 2**53: sums of doubles are exact
            x, c = some.astype(np.float64), entries.astype(np.float64)
            distance = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        else:
            distance = np.stack([((some - e) ** 2).sum(1) for e in entries], 1)
        code = distance.argmin(1)
        codes.append(code)
        errors.append(distance[np.arange(len(some)), code].astype(np.int64))
    return np.concatenate(codes) if codes else np.zeros(0, np.int64), np.concatenate(errors) if errors else np.zeros(0, np.int64)


def _by_part(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Part position, the rows that have it, and their integers."""
    part = batch.column("part").to_numpy()
    width = books.entries.shape[2]
    for p in np.unique(part).tolist():
        at = np.flatnonzero(part == p)
        ints = np.frombuffer(b"".join(batch.column("value").take(pa.array(at)).to_pylist()), "<i8").reshape(-1, width)
        yield p, at, ints


def _sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for p, at, ints in _by_part(batch, books):
                code, _ = _nearest(ints, books.entries[p])
                np.add.at(sums[p], code, ints * weights[at][:, None])
                np.add.at(counts[p], code, weights[at])
        p, e = np.nonzero(counts)
        listed = pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), listed], ["part", "entry", "n", "sums"])

    return run


def lloyd_round(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floored mean of the parts that are nearest to it; unused entries stay."""
    parts, entries, width = books.entries.shape
    found = distinct.mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
    new = books.entries.copy()
    for r in totals.collect():  # at most parts x entries rows
        new[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return Codebooks(new)


def _codes(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            for p, at, ints in _by_part(batch, books):
                codes[at], errors[at] = _nearest(ints, books.entries[p])
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("value"), batch.column("weight"), pa.array(codes), pa.array(errors)], ["part", "value", "weight", "code", "error"])

    return run


def _part_rows(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """part and value: a row for each part of each vector, with the vector's columns."""
    cuts = F.array(*[F.substring("ints", 8 * width * p + 1, 8 * width) for p in range(parts)])
    return kept.select(*[c for c in kept.columns if c != "ints"], F.posexplode(cuts).alias("part", "value"))


def _joined(rows: DataFrame, coded: DataFrame, n_rows: Column) -> DataFrame:
    """rows with code and error of their parts. A part that many vectors have is joined by broadcasting: of those with over a
    thousandth of a position's rows there are at most a thousand at each position."""
    often = F.col("weight") * 1000 > n_rows
    hot = coded.where(often).select("part", "value", F.col("code").alias("hot_code"), F.col("error").alias("hot_error"))
    marked = rows.join(F.broadcast(hot), ["part", "value"], "left")
    done = marked.where("hot_code is not null").select(*rows.columns, F.col("hot_code").alias("code"), F.col("hot_error").alias("error"))
    rest = marked.where("hot_code is null").select(*rows.columns)
    return done.unionByName(rest.join(coded.where(~often).select("part", "value", "code", "error"), ["part", "value"]))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, codes (a byte for each part, in order) and error (squared distances, summed) of each vector; and the codebooks.

    vectors has vec_id (a whole number), embedding (an array of numbers) and, if need be, label. Components become floor(scale * x); each part's codebook
    starts as the part of the vectors with the smallest ids and goes through so many rounds of Lloyd's.

    Defined cases: a vector that is null or empty, or has a null or non-finite component or one beyond 2**28 / scale, drops; so does one that has another length
    than the vector with the smallest id. A null id is none of the smallest, but its vector is coded. Rows that repeat an id are vectors of their own, one of
    them can start a codebook. With fewer vectors than entries the codebooks are shorter. An empty table gives an empty result and no
    codebooks; further columns are ignored. A length that the parts don't divide, and over 256 entries, are errors.
    """
    if entries > 256:
        raise ValueError("a code is one byte: at most 256 entries")
    kept = stored(integer_vectors(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "integer-vectors")
    books = first_codebooks(kept, parts, entries)
    if books is None:
        return kept.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")).where(F.lit(False)), None
    width = books.entries.shape[2]
    kept = kept.where(F.length("ints") == 8 * width * parts)
    distinct = stored(_part_rows(kept.select("ints"), parts, width).groupBy("part", "value").agg(F.count(F.lit(1)).alias("weight")), "distinct-parts")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    coded = stored(distinct.mapInArrow(_codes(books), "part int, value binary, weight long, code int, error long"), "coded-parts")
    n = kept.count()
    rows = _joined(_part_rows(kept, parts, width), coded, F.lit(n))
    hexed = [F.max(F.when(F.col("part") == p, F.lpad(F.hex("code"), 2, "0"))) for p in range(parts)]
    # The ids and labels of a row are all the same.
    grouped = rows.groupBy("row", "vec_id", "label").agg(F.unhex(F.concat(*hexed)).alias("codes"), F.sum("error").alias("error"))
    return grouped.select("vec_id", "label", "codes", "error"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded (stored) with label_error: the errors of all vectors with an equal label, summed; null labels are equal."""
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "same_label")
    return coded.join(small(totals, BROADCAST_ROWS), F.col("label").eqNullSafe(F.col("same_label"))).drop("same_label")
