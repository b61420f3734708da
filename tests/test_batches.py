import pyarrow as pa
from pyspark.sql import functions as F

from respgrid.operators import batches


def test_batches_end_at_their_bytes(spark):
    rows = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), F.lit(10_000)).alias("text"))

    def run(found):
        return (pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], ["rows", "bytes"]) for b in found)

    sizes = batches.map_batches(rows, run, "rows long, bytes long").agg(F.sum("rows"), F.max("bytes")).first()
    assert sizes[0] == 4000 and sizes[1] < batches.BYTES + 100_000


def test_bodies_are_handed_on_at_their_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([1, 3] * 5)], ["key", "mb"])
    made = list(batches.made_batches(iter([batch]), lambda key, mb: bytes([key]) * (mb << 20) if key else None, "key"))
    assert [len(b) for b in made] == [3, 2, 2, 2, 1] and [b.column("key")[0].as_py() for b in made] == [0, 3, 5, 7, 9]
    assert made[0].column("body").to_pylist()[0] is None and len(made[1].column("body")[0].as_py()) == 3 << 20
