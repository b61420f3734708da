"""Streams that are stopped and started again write each result once."""

import pytest

from respgrid.streaming import triage

SCHEMA = "k long, g long, text string, note string"


def run(spark, tmp_path):
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return triage.latest_stream(arriving, "k", "g", f"file://{tmp_path}/sink", f"file://{tmp_path}/state")


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def sink_rows(spark, tmp_path):
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/sink").select("batch", "k", "g", "text").collect())


def test_late_older_results_give_no_row(spark, tmp_path):
    rounds = [[(1, 5, "a", None), (1, 3, "b", "x"), (2, 1, "c", None)], [(1, 4, "late", None), (2, 1, "again", None), (3, None, "none", None)], [(1, 6, "d", None), (2, 9, "f", "y"), (2, 9, "e", None)]]
    for rows in rounds:
        put(spark, tmp_path, rows)
        run(spark, tmp_path).awaitTermination()
    assert sink_rows(spark, tmp_path) == [(0, 1, 5, "a"), (0, 2, 1, "c"), (2, 1, 6, "d"), (2, 2, 9, "e")]
    assert sorted(tuple(r)[:3] for r in triage.latest_of(spark, f"{tmp_path}/sink", "k", "g").collect()) == [(1, 6, "d"), (2, 9, "e")]


def test_a_trigger_that_failed_after_writing_is_run_again(spark, tmp_path, monkeypatch):
    write, times = triage.write_batch, []

    def fails_once(changed, sink, batch):
        write(changed, sink, batch)
        times.append(batch)
        if times == [0, 1]:
            raise RuntimeError("the driver goes down before the trigger is noted as done")

    monkeypatch.setattr(triage, "write_batch", fails_once)
    for rows in ([(k, 1, "first", None) for k in range(50)], [(k, 2, "second", None) for k in range(25)], [(k, k % 3, "third", None) for k in range(60)]):
        put(spark, tmp_path, rows)
    with pytest.raises(Exception, match="goes down"):
        run(spark, tmp_path).awaitTermination()
    run(spark, tmp_path).awaitTermination()
    assert times == [0, 1, 1, 2]
    found = sink_rows(spark, tmp_path)
    assert len(found) == len(set(found)) and len({(k, g) for _, k, g, _ in found}) == len(found)
    # Files of one second can come in any order; what is newest can't.
    newest = {}
    for _, k, g, _ in found:
        newest[k] = max(g, newest.get(k, -1))
    assert newest == {k: 2 if k < 25 or k % 3 == 2 else 1 if k < 50 or k % 3 == 1 else 0 for k in range(60)}
