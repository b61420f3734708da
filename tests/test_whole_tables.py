"""Queries cover their whole tables: against their SQL, and against plain versions."""

import pytest
from pyspark.sql import functions as F

from respgrid.jobs import fixtures, oracles, queries
from respgrid.sources import responses

from test_queries import SF, db, same  # noqa: F401

@pytest.mark.parametrize("name", ["k2_csv_export", "x11_dense_rows"])
def test_every_row(spark, db, name):  # noqa: F811
    same(queries.queries()[name](spark, SF).toPandas(), db.execute(oracles.oracle_sql()[name]).df())


def test_sniff_of_every_document(spark):
    found = {r["response_id"]: r["file_type"] for r in queries.d15_sniff(spark, SF).collect()}
    docs = fixtures.docs(spark, SF).select("response_id", F.expr("position('%PDF' IN left(cast(body AS string), 1028)) > 0").alias("pdf")).collect()
    assert set(found) == {r["response_id"] for r in docs} and len(found) == len(docs)
    assert {k for k, v in found.items() if v == "PDF"} == {r["response_id"] for r in docs if r["pdf"]}


def test_csv_export_keeps_sheets_apart(spark, tmp_path):
    lines = [(i, s, n, f"{i},\"a,{s}\",,{n}" if n else "") for i in range(40) for s in range(2) for n in range(30)]
    df = spark.createDataFrame(lines, "response_id long, sheet_idx int, line_no int, line string")
    path = f"file://{tmp_path}/out"
    responses.write_csv_export(df, path)
    assert sorted(map(tuple, responses.read_csv_export(spark, path).collect())) == sorted(lines)
    files = list((tmp_path / "out").rglob("part-*"))
    assert len(files) < 40
    for file in files:
        keys = [tuple(map(int, x.split(",")[:3])) for x in file.read_text().splitlines()]
        assert keys == sorted(keys)
