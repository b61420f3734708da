"""SimHash near-deduplication over pigeonhole blocks.

Equal fingerprints are one from the start. A 64-bit fingerprint is cut into six blocks; two that
differ in at most four bits agree in at least two of them, so each pair of blocks (15, of 20 to 22
bits) is a key under which every such pair meets. A sorted stream over the keys verifies the
Hamming distance and gives for each connected group under a key a star of links, never all
pairs: a fingerprint's verified neighbours leave the list of those yet to be compared, so
that a dense group of near copies costs few passes. Components are then found by alternating large and
small stars on the links.

A key that more than HOT fingerprints have is cut further: its other bits make five sub-blocks, one of which
any two linked fingerprints share, and so on until none has more than that, so that no task compares all that such a key
holds. A star's middle, a component or a fingerprint that more than one in SHARE of all rows have is joined by broadcasting.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respgrid.llm.common import small, stored, text_or_empty, without

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Widths of the blocks, from the lowest bit.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints under one key from which on it is cut further.
HOT = 4096
#: Keys that more than one in so many rows have are joined by broadcasting: there are fewer than so many.
SHARE = 1000
#: Shingles whose bits are counted at once.
AT_ONCE = 65_536


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; zero if it has no words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        begins, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :], strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        some = np.array(hashes[at : at + AT_ONCE], "<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(values)], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and fp, the fingerprint as a signed long, for each row."""
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def _stars(members: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links from one member of each connected group to its others; members are distinct."""
    todo, heads, ends = members.view(np.uint64), [], []
    while len(todo) > 1:
        head, front, todo = int(todo[0].view(np.int64)), [todo[0]], todo[1:]
        while front and len(todo):
            near = np.bitwise_count(todo ^ front.pop()) <= distance
            if near.any():
                found = todo[near]
                front.extend(found)
                heads += [head] * len(found)
                ends += found.view(np.int64).tolist()
                todo = todo[~near]
    return heads, ends


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pair, key) -> links a, b."""

    def out(a: list[int], b: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held: list[tuple[int, int, np.ndarray]] = []

    def flush() -> pa.RecordBatch | None:
        members = np.unique(np.concatenate([x[2] for x in held])) if held else np.empty(0, np.int64)
        held.clear()
        return out(*_stars(members, DISTANCE)) if len(members) > 1 else None

    for batch in batches:
        if not len(batch):
            continue
        pair, key, fp = (batch.column(c).to_numpy() for c in ("pair", "key", "fp"))
        starts = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])])
        ends = np.r_[starts[1:], len(fp)]
        a, b = [], []
        if held and held[-1][:2] != (pair[0], key[0]) and (got := flush()):
            yield got
        for k in np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)).tolist():
            x, y = starts[k], ends[k]
            if k == len(starts) - 1 or k == 0 and held:
                if k and held and (got := flush()):
                    yield got
                held.append((pair[x], key[x], fp[x:y]))
            elif y - x > 1:
                heads, others = _stars(fp[x:y], DISTANCE)
                a += heads
                b += others
        if a:
            yield out(a, b)
    if got := flush():
        yield got


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _sub_masks(mask: int) -> list[int]:
    """mask with one of DISTANCE + 1 parts of the other bits, each in turn; none if so few are left that no key has more than HOT fingerprints."""
    rest = [b for b in range(64) if not mask >> b & 1]
    if 1 << len(rest) <= HOT:
        return []
    cuts = [len(rest) * k // (DISTANCE + 1) for k in range(DISTANCE + 2)]
    return [mask | sum(1 << b for b in rest[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _keyed(distinct: DataFrame, hot: int) -> DataFrame:
    """pair, key, fp: the keys under which linked fingerprints meet, cut until none has more than hot of them.

    A mask's sub-masks leave four fifths of its free bits, so that a key is cut at most six times.
    """
    begins = np.cumsum([0, *BLOCKS[:-1]]).tolist()
    blocks = [((1 << w) - 1) << b for w, b in zip(BLOCKS, begins, strict=True)]
    masks = dict(enumerate(x | y for x, y in combinations(blocks, 2)))
    keys = [F.struct(F.lit(i).cast("long").alias("pair"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in masks.items()]
    level = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.pair", "k.key", "fp")
    fits = []
    while True:
        crowded = stored(level.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).drop("n"), "hot-keys")
        # Masks are numbered as a tree: what comes here is numbers of masks, not keys.
        cut = {p: _sub_masks(masks[p]) for (p,) in crowded.select("pair").distinct().collect()}
        cut = {p: subs for p, subs in cut.items() if subs}
        if not cut:
            break
        children = [(p, len(BLOCKS) * (len(BLOCKS) - 1) // 2 + p * (DISTANCE + 1) + i, m) for p, subs in cut.items() for i, m in enumerate(subs)]
        masks = {child: m for _, child, m in children}
        parts = distinct.sparkSession.createDataFrame([(p, child, _signed(m)) for p, child, m in children], "pair long, child long, mask long")
        few = small(crowded.where(F.col("pair").isin(list(cut))))
        fits.append(level.join(few, ["pair", "key"], "left_anti"))
        below = level.join(few, ["pair", "key"], "left_semi").join(F.broadcast(parts), "pair")
        level = stored(below.select(F.col("child").alias("pair"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), "cut-keys")
    for rest in fits:
        level = level.unionByName(rest)
    return level


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp): as many as connect all that are within DISTANCE."""
    return _keyed(distinct, hot).repartition("pair", "key").sortWithinPartitions("pair", "key").mapInArrow(_links, "a long, b long").distinct()


def _to_each(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of values, a table of one row a key and the number n of its rows, total in all or fewer.

    Keys that more than one in SHARE of all rows have are fewer than SHARE: they are broadcast, so that their rows stay where they are.
    """
    much = F.col("n") * SHARE > total
    often = F.broadcast(values.where(much).drop("n"))
    seldom = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(values.where(~much).drop("n"), key)
    return rows.join(often, key).unionByName(seldom)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root: each node of edges (a, b) with the smallest node that it is connected to."""
    flat = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    now, many = (flat.count(), None), F.count(F.lit(1)).alias("n")
    for _ in range(most_rounds):
        before, total = now, 2 * now[0]
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), many)
        large = _to_each(both.where("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "large-stars")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), many)
        shrunk = _to_each(large, lowest, "u", total).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        flat = stored(shrunk.where("u != v").distinct(), "stars")
        now = tuple(flat.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return flat.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, fp, component_id (the smallest doc_id reachable over links).

    Defined cases: a null text is an empty one; texts without words have fingerprint zero and are
    linked like any other; a text of fewer words than a shingle is one shingle; rows that repeat a
    doc_id are in one component by that id only if their fingerprints link. A null doc_id belongs to its
    fingerprint's component, whose id is null only if it has no other doc_id. An empty table gives an empty
    result; further columns are ignored.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(stored(links(distinct), "links"))
    rooted = stored(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_doc", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = stored(_to_each(rooted.select("fp", "root", F.col("n").alias("rows")), smallest, "root", rooted.count()).select("fp", "component_id", F.col("rows").alias("n")), "named")
    return _to_each(rows, named, "fp", rows.count()).select("doc_id", "text_hash", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component, with all their columns."""
    return without(docs, near_groups(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))), one_each=True)
