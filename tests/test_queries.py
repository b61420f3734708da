"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from respgrid.jobs import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    text = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert text(left).equals(text(right))


@pytest.mark.parametrize("name", ["c3_order_cells", "d12_guess_delimiter", "d18_open_status", "f2_date_serial_text", "g5_sort", "x6_place_rows", "x9_cut_wide_rows", "x10_assembled_cells", "x17_all_cells", "c4_quoted_fields", "c6_capped_rows", "g10_notices", "d2_compressed_flags", "d3_expanded_bodies", "d9_legacy_excel", "d15_sniff_against_detect", "f10_expanded_header", "s4_xls_cells", "x12_packed_numbers", "x14_formula_values", "x16_xls_messages", "t1_triage_stream", "t2_latest_stream", "s3_rich_xlsx_cells", "c1_encodings", "c3_large_bodies", "c5_blank_rows", "d3_many_members", "s3_many_sheets", "x1_x2_many_sheets", "t2_stream_updates", "g7_large_export"])
def test_query_against_sql(spark, db, name):
    same(queries.queries()[name](spark, SF).toPandas(), db.execute(oracles.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
