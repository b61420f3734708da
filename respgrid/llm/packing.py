"""Packing documents into token sequences by cutting-stock column generation.

Documents are tokenized where they are read; from then on only piece lengths move. A document
is cut every LENGTH tokens, so that all of its pieces but the last fill a sequence alone. The
lengths, rounded up to UNIT, form a histogram of at most LENGTH/UNIT classes whatever the
number of documents - the only thing that comes to the driver. There a linear program over
cutting patterns is solved by column generation: a knapsack dynamic program over the duals
prices the columns. Rounded down, the patterns say how many sequences are filled in which
way; the pieces that rounding leaves over, a bounded number, are packed largest first. Last,
pieces are ranked within their class and take the places that the patterns have for it.

Documents in an order that matters are packed range by range: each range of consecutive documents has
its own program, solved where Spark deals it, and its own sequences, numbered in the order of the ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respgrid.llm import encoding
from respgrid.llm.common import stored

LENGTH, UNIT, END_ID = 2048, 8, 1
#: Parts into which a class is dealt to be ranked, at least; and rows of a part if all were of one class.
PARTS, PART_ROWS = 256, 2_000_000


def tokenized_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, ranged: bool = False) -> DataFrame:
    """Pieces of at most length tokens: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (binary) and the document's __range."""
    fields = [pa.field("doc_id", pa.int64()), *(pa.field(x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens"))]
    fields += [pa.field("ids", pa.binary())] * with_ids + [pa.field("__range", pa.int64())] * ranged
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.of_worker(encoding.WordIds, tokenizer)
        for whole in batches:
            for batch in encoding.slices(whole):
                data, bounds = encoder(encoding.filled(batch))
                rows: list[list] = [[] for _ in fields]
                at = batch.column("__range").to_pylist() if ranged else [None] * len(batch)
                for doc_id, k, a, b in zip(batch.column("doc_id").to_pylist(), at, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    n = (b - a) // 4 + 1
                    for start in range(0, n, length):
                        stop = min(n, start + length)
                        ids = data[a + 4 * start : min(b, a + 4 * stop)]
                        ids = bytes(ids) + end if stop == n else ids
                        for row, x in zip(rows, (doc_id, start, stop - start, zlib.crc32(ids), n), strict=False):
                            row.append(x)
                        if with_ids:
                            rows[5].append(bytes(ids))
                        if ranged:
                            rows[-1].append(k)
                yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, fields, strict=True)], schema=pa.schema(fields))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", __range long" * ranged
    return docs.select(F.col("doc_id").cast("long"), "text", *["__range"] * ranged).mapInArrow(run, schema)


def _price(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most value that fits into room: an unbounded knapsack."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        n = np.searchsorted(sizes, c, "right")
        best[c], last[c] = best[c - 1], -1
        if n:
            got = value[:n] + best[c - sizes[:n]]
            k = int(got.argmax())
            if got[k] > best[c]:
                best[c], last[c] = got[k], k
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        k = last[c]
        if k < 0:
            c -= 1
        else:
            pattern[k] += 1
            c -= sizes[k]
    return best[room], pattern


def _largest_first(need: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """A basis of patterns, a column for each class: each is filled largest first with what is left, and used until a class runs out.

    A column holds its class and such as run out later, so that the basis is triangular and its plan feasible.
    """
    left, basis = need.copy(), np.diag((room // sizes).astype(float))
    while left.any():
        free, fill = room, np.zeros(len(sizes))
        for i in np.flatnonzero(left)[::-1]:
            fill[i] = min(np.ceil(left[i]), free // sizes[i])
            free -= fill[i] * sizes[i]
        used = np.flatnonzero(fill)
        often = left[used] / fill[used]
        out = used[often.argmin()]
        basis[:, out] = fill
        left = np.where(fill > 0, left - fill * often.min(), left)
        left[out] = 0
        left[left < 1e-9] = 0
    return basis


def patterns_for(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, pieces by class) so that each class's count is placed exactly.

    The program ends when no pattern can lower its value, or when the bound that the duals give - their value over that of the best pattern - says that
    no plan has fewer sequences than the value rounded up.
    """
    sizes = np.array(sorted(k for k, v in histogram.items() if v))
    if not len(sizes):
        return []
    need = np.array([histogram[int(k)] for k in sizes], float)
    # Slightly unequal needs have no ties: each step lowers the value, so that none comes back.
    eased = need * (1 + 1e-12 * np.arange(len(sizes))) + 1e-9 * (1 + np.arange(len(sizes)))
    basis = _largest_first(eased, sizes, room)
    inverse, bound, steps = np.linalg.inv(basis), 0.0, 0
    x = np.maximum(inverse @ eased, 0)
    while True:
        duals = inverse.sum(axis=0)
        value, pattern = _price(duals, sizes, room)
        bound = max(bound, float(duals @ need) / value)
        if value <= 1 + 1e-7 or np.ceil(x.sum() - 1e-4) <= np.ceil(bound - 1e-4):
            break
        way = inverse @ pattern
        ratio = np.full(len(way), np.inf)
        np.divide(x, way, out=ratio, where=way > 1e-9)
        leave = int(ratio.argmin())
        basis[:, leave], steps = pattern, steps + 1
        if steps % 256:
            row = inverse[leave] / way[leave]
            inverse -= np.outer(way, row)
            inverse[leave] = row
            x = np.maximum(x - ratio[leave] * way, 0)
            x[leave] = ratio[leave]
        else:  # errors of the updates don't add up
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ eased, 0)
    x = np.maximum(inverse @ need, 0)
    plan, left = [], need.astype(np.int64)
    for k in np.argsort(-x):
        pattern = basis[:, k].astype(np.int64)
        used = pattern > 0
        often = min(int(x[k] + 1e-6), int((left[used] // pattern[used]).min())) if used.any() else 0
        if often:
            plan.append((often, {int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(used)}))
            left -= often * pattern
    while left.any():
        free, fill = room, np.zeros(len(sizes), np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            fill[i] = min(left[i], free // sizes[i])
            free -= fill[i] * sizes[i]
        often = int((left[fill > 0] // fill[fill > 0]).min())
        plan.append((often, {int(sizes[i]): int(fill[i]) for i in np.flatnonzero(fill)}))
        left -= often * fill
    return plan


def places_for(histogram: dict[int, int], room: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(class, low, high, each, first): pieces low to high - 1 of the class go by each to the sequences from first on; and the number of sequences."""
    places, taken, first = [], dict.fromkeys(histogram, 0), 0
    for often, pattern in patterns_for(histogram, room):
        for size, each in pattern.items():
            places.append((size, taken[size], taken[size] + each * often, each, first))
            taken[size] += each * often
        first += often
    return places, first


def _range_places(histogram: DataFrame, room: int) -> DataFrame:
    """places_for each range of histogram (__range, __class, n); first goes on from range to range."""

    def plan(table: pa.Table) -> pa.Table:
        found = table.to_pydict()
        places, n = places_for(dict(zip(found["__class"], found["n"], strict=True)), room)
        rows = [(found["__range"][0], *x, n) for x in places]
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    names = ["__range", "__class", "low", "high", "each", "first", "sequences"]
    fields = [pa.field(x, pa.int32() if x == "__class" else pa.int64()) for x in names]
    schema = ", ".join(f"{x} {'int' if x == '__class' else 'long'}" for x in names)
    planned = stored(histogram.groupBy("__range").applyInArrow(plan, schema), "range-places")
    # A row for each range.
    sizes = sorted(tuple(r) for r in planned.select("__range", "sequences").distinct().collect())
    begins = list(zip([k for k, _ in sizes], accumulate([n for _, n in sizes], initial=0), strict=False))
    begins = histogram.sparkSession.createDataFrame(begins, "__range long, __begin long")
    return planned.join(F.broadcast(begins), "__range").withColumn("first", F.col("first") + F.col("__begin"))


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, unit: int = UNIT, with_ids: bool = False, ranged: bool = False) -> DataFrame:
    """One row per piece: the columns of tokenized_pieces, sequence_id, offset, sequence_tokens and padded_tokens.

    Offsets in a sequence start at 0 and leave no gap. A sequence is padded to length, unless its
    tokens are a power of two. with_ids adds each piece's ids, so that sequences can be written out.
    ranged: docs has a column __range (long); a sequence holds pieces of one range only, and those of lower ranges come first.

    Defined cases: doc_id is a whole number; a null or empty text is the end id alone; texts of any length are cut, none is
    shortened; rows that repeat a doc_id are packed each for itself; a null doc_id stays null. An
    empty table gives no pieces. Further columns are ignored.
    """
    if length % unit:
        raise ValueError("length must be a multiple of unit")
    pieces = stored(tokenized_pieces(docs, tokenizer, length, with_ids=with_ids, ranged=ranged), "pieces")
    spark, key = docs.sparkSession, ["__range"] * ranged + ["__class"]
    n_parts = max(PARTS, -(-pieces.count() // PART_ROWS))
    # A class of one range is small enough to be ranked as it is.
    pieces = pieces.withColumn("__class", F.expr(f"cast((length + {unit - 1}) div {unit} as int)")).withColumn(
        "__part", F.lit(0) if ranged else F.pmod(F.xxhash64("doc_id", "start"), F.lit(n_parts))
    )
    parts = stored(pieces.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("n")), "piece-parts")
    histogram = parts.groupBy(*key).agg(F.sum("n").alias("n"))
    if ranged:
        table = _range_places(histogram, length // unit)
    else:
        # At most length / unit rows.
        places, _ = places_for({r[0]: r[1] for r in histogram.collect()}, length // unit)
        table = spark.createDataFrame(places, "__class int, low long, high long, each long, first long")
    # At most a few places for each pair of classes.
    table = table.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("high", "low", "each", "first"))).alias("places"))
    table = table if ranged else F.broadcast(table)

    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select(*key, "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy(*key, "__part").orderBy(F.desc("length"), "doc_id", "start")
    ranked = pieces.withColumn("__rank", F.row_number().over(within) - 1).join(begins, [*key, "__part"])
    ranked = ranked.withColumn("__rank", F.col("__first") + F.col("__rank"))
    place = F.filter("places", lambda p: F.col("__rank") < p["high"])[0]
    seated = ranked.join(table, key).withColumn("__place", place)
    seated = seated.withColumn("sequence_id", F.expr("__place.first + (__rank - __place.low) div __place.each"))
    inside = Window.partitionBy("sequence_id")
    ahead = inside.orderBy(F.desc("length"), "doc_id", "start", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("length").over(inside)
    return seated.select(
        *pieces.drop("__class", "__part", "__range").columns,
        "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"),
        total.alias("sequence_tokens"),
        F.when(F.bit_count(total) == 1, total).otherwise(F.lit(length).cast("long")).alias("padded_tokens"),
    )
