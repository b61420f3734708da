"""Streams of responses: triage on arrival, and the newest result for each view."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from respgrid.limits import DEFAULT, Limits
from respgrid.operators.detect import renderable, sniff
from respgrid.sources.responses import RESPONSE


def triage_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, limits: Limits = DEFAULT) -> StreamingQuery:
    """Sniffs the responses that arrive as Parquet files under source, and appends the renderable ones to sink.

    Stateless; ends when all files that are there have been read.
    """
    arriving = spark.readStream.schema(RESPONSE).parquet(source)
    found = renderable(sniff(arriving, limits))
    return found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def latest_per_view(results: DataFrame, key: str, generation: str) -> DataFrame:
    """key, generation and the other columns of the newest generation of each key; late older ones change nothing.

    The same for a table and, in update mode, for a stream, whose state has one row a key.
    """
    others = [c for c in results.columns if c not in (key, generation)]
    newest = results.groupBy(key).agg(F.max(F.struct(generation, *others)).alias("newest"))
    return newest.select(key, *[F.col("newest")[c].alias(c) for c in (generation, *others)])


def newer_results(results: DataFrame, key: str, generation: str) -> DataFrame:
    """The rows of a stream that are newer than all that came before for their key: of a trigger's rows of a key the newest, if any is.

    State is one number a key. A late older result, or one without a generation, changes nothing and gives no row; of several with one generation
    the first by its other columns' text stays.
    """
    others = [c for c in results.columns if c not in (key, generation)]
    columns = [key, generation, *others]
    kinds = {f.name: f.dataType.simpleString() for f in results.schema}

    def newest(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        best = None
        for part in parts:
            part = part[part[generation] == part[generation].max()]
            part = part.sort_values(others, key=lambda c: c.astype(str)) if others else part
            if len(part) and (best is None or part[generation].iloc[0] > best[generation].iloc[0]):
                best = part.iloc[:1]
        if best is not None and (seen is None or best[generation].iloc[0] > seen):
            state.update((int(best[generation].iloc[0]),))
            yield best[columns]

    some = results.where(F.col(generation).isNotNull()).select(*[F.col(c).cast("long") if c == generation else F.col(c) for c in columns])
    out = ", ".join(f"`{c}` {'bigint' if c == generation else kinds[c]}" for c in columns)
    return some.groupBy(key).applyInPandasWithState(newest, out, "seen bigint", "update", GroupStateTimeout.NoTimeout)


def write_batch(changed: DataFrame, sink: str, batch: int) -> None:
    """A trigger's rows as files of its own: a trigger that is run again writes over them."""
    changed.write.mode("overwrite").parquet(f"{sink}/batch={batch}")


def latest_stream(results: DataFrame, key: str, generation: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes to sink, for each trigger, the results that are newer than all before; ends when all that is there has been read.

    A key's rows in sink rise in generation with their batch. However often triggers are run again, each row is there once.
    """
    newer = newer_results(results, key, generation)
    stream = newer.writeStream.foreachBatch(lambda changed, batch: write_batch(changed, sink, batch))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()


def latest_of(spark: SparkSession, sink: str, key: str, generation: str) -> DataFrame:
    """What latest_stream's sink shows: for each key the row of its last batch."""
    return latest_per_view(spark.read.parquet(sink).drop("batch"), key, generation)
