"""Arrow batches of bounded size between Spark and the small helpers that see single bodies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a batch; one row may have more.
BYTES = 4 << 20
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def map_batches(df: DataFrame, run: Run, schema: str) -> DataFrame:
    """df.mapInArrow, whose batches end at BYTES: by rows alone, 10,000 large bodies would be one batch. A limit that the session has stays."""
    conf = df.sparkSession.conf
    if conf.get(LIMIT, None) is None:
        conf.set(LIMIT, str(BYTES))
    return df.mapInArrow(run, schema)


def made_batches(batches: Iterator[pa.RecordBatch], make: Callable[..., bytes | None], *kept: str) -> Iterator[pa.RecordBatch]:
    """The kept columns and body, which make gives from a row's values; row by row, handed on at BYTES."""
    for batch in batches:
        begin, size, bodies = 0, 0, []
        for k in range(len(batch)):
            bodies.append(make(*[column[k].as_py() for column in batch.columns]))
            size += len(bodies[-1] or b"")
            if size >= BYTES or k + 1 == len(batch):
                part = batch.slice(begin, len(bodies))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(bodies, pa.binary())], [*kept, "body"])
                begin, size, bodies = k + 1, 0, []
