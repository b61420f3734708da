"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

A source is cut into blocks of BLOCK rows. With an integer share e of the D slots of a period,
its k-th block (from 0) is released at slot floor(k*D/e) and has the deadline ceil((k+1)*D/e).
Earliest deadline first among released blocks then serves every block inside its window, so
that after any number of slots each source has received its target within less than one block.

The shares make the schedule repeat after D slots. So only one period is scheduled, and a
block's slot follows from its number alone: block k of a source with share e lies in period
k div e, at the slot of its (k mod e)-th block. A source with a share of one may be served at any slot of a period;
such sources take, one after the other, the slots that the others leave. The others, of which there are at most
two thirds of PERIOD however many sources there are, are scheduled by a fold over the D slots.

A source that has run out leaves its later slots empty; the others move up and keep their order.
No row is dropped or repeated.
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respgrid.llm.common import small, stored

#: Rows of a block; slots of a period, before each source's share is rounded to at least one.
BLOCK, PERIOD = 16, 1000
#: Default target weights: a source's rows to this power.
TEMPERATURE = 0.7
#: Parts into which each source is dealt to be numbered, so that no source is sorted in one task; slots of a stretch whose rows are added up at once;
#: blocks of a source that one task lists.
PARTS, STRETCH, LISTED = 256, 4096, 65_536


def shares(sources: DataFrame) -> DataFrame:
    """source, n and share of sources (source, n, weight): whole numbers of slots of a period, one at least."""
    total = sources.agg(F.sum("weight")).first()[0]
    # A sum in the order of arrival could differ in its last digit from run to run: it is rounded.
    part = F.round(F.col("weight") / F.lit(round(total or 0.0, 6)) * PERIOD)
    return sources.select("source", "n", F.greatest(F.lit(1.0), F.coalesce(part, F.lit(1.0))).cast("long").alias("share"))


def schedule_period(shared: DataFrame) -> DataFrame:
    """source, share, nth, in_period and period: the slot of each of a source's blocks in a period. shared has source and share."""
    period = shared.agg(F.sum("share")).first()[0] or 0
    heavy = shared.where("share > 1").agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("sources"))
    # At each slot the source of the earliest deadline among those whose next block is released; null if there is none.
    folded = heavy.select(
        "sources",
        F.expr(f"""
        aggregate(
          sequence(0L, {period}L - 1),
          named_struct('done', transform(sources, x -> 0L), 'out', cast(array() as array<int>)),
          (acc, t) -> transform(
            array(array_min(transform(
              sources,
              (x, i) -> if(
                acc.done[i] < x.share and (acc.done[i] * {period}L) div x.share <= t,
                named_struct('deadline', ((acc.done[i] + 1) * {period}L + x.share - 1) div x.share, 'i', i),
                null
              )
            ))),
            pick -> named_struct(
              'done', if(pick.i is null, acc.done, transform(acc.done, (d, i) -> if(i <=> pick.i, d + 1, d))),
              'out', array_append(acc.out, pick.i)
            )
          )[0],
          acc -> acc.out
        )
        """).alias("slots"),
    ) if period else heavy.select("sources", F.array().cast("array<int>").alias("slots"))
    slots = stored(folded.select(F.posexplode("slots").alias("in_period", "who"), "sources").select("in_period", F.get("sources", F.col("who"))["source"].alias("source")), "mix-slots")
    # A row for each source of share one, and for each slot that is left: the same number.
    left = slots.where("source is null").select("in_period", F.row_number().over(Window.orderBy("in_period")).alias("k"))
    light = shared.where("share = 1").select("source", F.row_number().over(Window.orderBy("source")).alias("k"))
    taken = slots.where("source is not null").select("source", "in_period").unionByName(light.join(left, "k").select("source", "in_period"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("in_period")) - 1
    found = taken.select("source", "in_period", nth.cast("long").alias("nth")).join(shared.select("source", "share"), "source")
    return found.withColumn("period", F.lit(period).cast("long"))


def _slotted(docs: DataFrame, weights: dict[str, float] | None, own: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs with __source, __rank, block, share, period and slot; the schedule of a period; and the sources with rows and share."""
    rows = docs.select(
        *own,
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("__source"),
        F.xxhash64("doc_id").alias("__order"),
    ).withColumn("__part", F.pmod(F.shiftrightunsigned("__order", 20), F.lit(PARTS)))
    parts = stored(rows.groupBy("__source", "__part").agg(F.count(F.lit(1)).alias("__rows")), "mix-parts")
    n = parts.groupBy(F.col("__source").alias("source")).agg(F.sum("__rows").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    elif weights:
        known = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in ("=" + k, float(v))])
        weight = F.coalesce(F.try_element_at(known, F.col("source")), F.lit(0.0))
    else:
        raise ValueError("weights is empty")
    shared = small(stored(shares(n.withColumn("weight", weight)), "mix-shares"))
    schedule = small(stored(schedule_period(shared), "mix-schedule"))

    first = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__source", "__part", F.coalesce(F.sum("__rows").over(first), F.lit(0)).alias("__first"))
    within = Window.partitionBy("__source", "__part").orderBy("__order", "doc_id")
    ranked = rows.withColumn("__rank", F.row_number().over(within)).join(offsets, ["__source", "__part"])
    ranked = ranked.withColumn("__rank", F.col("__first") + F.col("__rank") - 1).withColumn("block", F.expr(f"__rank div {BLOCK}"))
    of = shared.select(F.col("source").alias("__source"), F.col("share").alias("__share"))
    placed = ranked.join(of, "__source").withColumn("nth", F.col("block") % F.col("__share")).drop("__share")
    placed = placed.join(schedule.withColumnRenamed("source", "__source"), ["__source", "nth"])
    return placed.withColumn("slot", F.expr("(block div share) * period + in_period")), schedule, shared


def block_positions(shared: DataFrame, schedule: DataFrame) -> DataFrame:
    """__source, block and start: how many rows come before each block. Slots that a source has left empty count for nothing."""
    n_blocks = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
    lists = shared.select("source", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({BLOCK - 1} + n - 1) div {BLOCK} div {LISTED}"))).alias("k")).repartition("source", "k")
    last = F.least(n_blocks, (F.col("k") + 1) * LISTED) - 1
    blocks = lists.select("source", "n", F.explode(F.sequence(F.col("k") * LISTED, last)).alias("block"))
    placed = blocks.join(shared.select("source", "share"), "source").withColumn("nth", F.col("block") % F.col("share")).drop("share").join(schedule, ["source", "nth"])
    rows = F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK)
    placed = placed.select("source", "block", F.expr("(block div share) * period + in_period").alias("slot"), rows.alias("rows")).withColumn("stretch", F.expr(f"slot div {STRETCH}"))
    placed = stored(placed, "mix-blocks")
    totals = placed.groupBy("stretch").agg(F.sum("rows").alias("all"))
    # A row for each STRETCH slots.
    begins = totals.select("stretch", (F.sum("all").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")).alias("begin"))
    sofar = F.sum("rows").over(Window.partitionBy("stretch").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    return placed.withColumn("sofar", sofar).join(begins, "stretch").select(F.col("source").alias("__source"), "block", (F.col("begin") + F.col("sofar")).alias("start"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs with block, release, deadline, slot, target_share and mix_position (0 to rows - 1, gapless).

    Sorting by mix_position gives the mixture. Within a source, rows come in an order that is
    random but fixed by their doc_id. weights: target by source; sources that it lacks get the
    smallest share. Without it, a source's rows to the power TEMPERATURE.

    Defined cases: a null source is a source of its own; rows with equal doc_id follow each other
    in any order; a null doc_id is like any other value; an empty table gives an empty result.
    Columns of docs that have the name of an added column are replaced.
    """
    added = ["block", "release", "deadline", "slot", "target_share", "mix_position"]
    # Columns of docs keep their names whatever the steps between are called.
    own = {c: f"__own{k}" for k, c in enumerate(docs.columns) if c.lower() not in added}
    kept = docs.select("doc_id", "source", *[F.col(c).alias(a) for c, a in own.items()])
    placed, schedule, shared = _slotted(kept, weights, kept.columns)
    return placed.join(block_positions(shared, schedule), ["__source", "block"]).select(
        *[F.col(a).alias(c) for c, a in own.items()],
        "block",
        F.expr("(block * period) div share").alias("release"),
        F.expr("((block + 1) * period + share - 1) div share").alias("deadline"),
        "slot",
        (F.col("share") / F.col("period")).alias("target_share"),
        (F.col("start") + F.col("__rank") % BLOCK).alias("mix_position"),
    )


def in_mix_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All rows of docs with their own columns, laid out in the order of the mixture.

    Each output partition holds a contiguous range of the mixture, sorted.
    """
    # Columns of docs keep their names whatever the steps between are called.
    own = {c: f"__own{k}" for k, c in enumerate(docs.columns)}
    kept = docs.select("doc_id", "source", *[F.col(c).alias(a) for c, a in own.items()])
    placed, _, _ = _slotted(kept, weights, kept.columns)
    laid = placed.withColumn("__at", F.col("__rank") % BLOCK).repartitionByRange("slot", "__at").sortWithinPartitions("slot", "__at")
    return laid.select(*[F.col(a).alias(c) for c, a in own.items()])


def with_ranges(laid_out: DataFrame, rows: int) -> DataFrame:
    """laid_out with __range: the number of each row's range of so many consecutive rows, by its place in its files.

    A table that was written from in_mix_order has its files numbered in the order of their ranges, each
    in order within: a row's place is its index in its file after the rows of the files before. What isn't
    read from files is written first.
    """
    try:
        laid_out.select("_metadata.row_index")
    except AnalysisException:
        laid_out = stored(laid_out, "laid-out")
    own = laid_out.columns
    placed = laid_out.select(*own, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    # A row for each file.
    files = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("n")).collect()
    files = sorted((int(re.search(r"part-(\d+)[^/]*$", r["__file"])[1]), r["__file"], r["n"]) for r in files)
    begins = list(zip([f for _, f, _ in files], accumulate([n for _, _, n in files], initial=0), strict=False))
    begins = laid_out.sparkSession.createDataFrame(begins, "__file string, __begin long")
    return placed.join(F.broadcast(begins), "__file").select(*own, F.expr(f"(__begin + __index) div {rows}").alias("__range"))
