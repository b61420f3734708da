"""Rows that keep their cells in one array: texts, places, and plans that handle no cell by itself."""

import random

import pytest
from pyspark.sql import functions as F

from respgrid.functions import scalars as S
from respgrid.jobs import queries
from respgrid.jobs.queries import staged
from respgrid.operators import detect, grid, workbook
from respgrid.sources import xlsx
from test_large_sheets import sheets_of
from test_queries import SF
from test_xlsx_parts import book
from tests.test_files import responses

CELL = "struct<cell_n:int,style_idx:int,ref:string,t:string,v:string,inline_text:string>"
NUMBERS = ["0", "-0", "-0.5", "1.50", "12345.67", "0.0001", "1e3", " 7 ", "100000000000000000", "0.1234567890123456", "nan", "NaN", "Infinity", "inf", "x", "", "+5", "1d", "36526", "59", "60", "61.5", "99", "100", "999999", "1000000", "-3", "1e9", "007"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_and_dates_are_shown_as_their_long_way_shows_them(spark):
    rows = spark.createDataFrame([(v, d, e) for v in NUMBERS for d in (False, True) for e in (False, True)], "v string, dated boolean, early boolean")
    value = S.named_exactly(S.trim_edges(F.col("v")))
    long = F.when(value.isNull(), S.clamp_cell(F.col("v"))).when(F.col("dated"), S.date_serial_text(value, F.col("early"))).otherwise(S.number_text(value))
    found = rows.select("v", workbook.numeric_text(F.col("v"), F.col("dated"), F.col("early")).alias("short"), long.alias("long")).collect()
    assert [r["short"] for r in found] == [r["long"] for r in found]


def test_shared_strings_of_large_and_small_books(spark):
    cells = [(k, -1, None, "s", v, None) for k, v in enumerate(["0", "1", "7", "-1", " +1 ", "x", None])]
    rows = spark.createDataFrame([(b, "p", n, cells) for b in (1, 2) for n in range(3)], f"response_id long, part string, n int, cells array<{CELL}>")
    books = spark.createDataFrame([(b, "p", False, None) for b in (1, 2)], "response_id long, part string, date1904 boolean, dates array<boolean>")
    sst = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 1, "d" * 90), (2, 0, "c")], "response_id long, sst_idx int, text string")
    shown = lambda chars: sorted((r["response_id"], r["n"], [c["text"] for c in r["cells"]]) for r in workbook.row_texts(workbook.with_books(rows, books, sst, ["response_id", "part"], chars)).collect())
    want = [(b, n, [x, y, "", "", y, "", ""]) for b, x, y in ((1, "a", "b"), (2, "c", "d" * 90)) for n in range(3)]
    assert shown(1 << 20) == want and shown(0) == want and shown(60) == want


def test_places_after_far_ones(spark):
    r = random.Random(9)
    rows = [[(k, r.choice([None] * 5 + [r.randrange(30)]), "t") for k in range(r.randrange(12))] for _ in range(200)]

    def plain(cells):
        out, last = [], -1
        for k, place, text in cells:
            last = last + 1 if place is None else place
            out.append((last, k, text))
        return out

    df = spark.createDataFrame([(k, c) for k, c in enumerate(rows)], "id int, cells array<struct<cell_n:int,place:int,text:string>>")
    found = df.select("id", workbook.placed_cells(F.col("cells")).alias("p")).collect()
    assert all([tuple(c) for c in x["p"]] == plain(rows[x["id"]]) for x in found)


def test_references(spark):
    refs = ["A1", "Z9", "AA10", "az3", "XFD1", "ABCD5", "1", "", None, "B", "A", "é1", "ZZZZZZZ1"]
    want = [0, 25, 26, 51, 16383, 19009, -1, -1, None, 1, 0, -1]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(refs)], "k int, ref string")
    assert [r[0] for r in df.orderBy("k").select(S.column_index(F.col("ref"))).collect()][:12] == want


@pytest.mark.parametrize("name", ["x10_assembled_cells", "x11_dense_rows", "a1_sheet_shape"])
def test_no_cell_is_joined_or_exchanged_by_itself(spark, name):
    text = plan(queries.queries()[name](spark, SF))
    rows = [line for line in text.splitlines() if "Exchange" in line and "cell_n" in line]
    assert not rows and "collect_list(struct(cell_n" not in text


def test_cells_are_placed_without_sorting_them(spark):
    text = plan(queries.x7_place_columns(spark, SF))
    assert text.count("Sort [") == 1 and "Generate" not in text.split("Sort [")[1]


def test_texts_make_lines_once(spark):
    text = plan(queries.x3_x5_cell_text(spark, SF))
    assert text.count("row_number()") <= 2 and "Union" not in text


def test_the_reader_gives_rows_with_their_cells(spark):
    found = staged(detect.detect(responses(spark, [book(2, rows=5)], None, "f.xlsx")), "detected")
    kinds = {r["kind"]: r["count"] for r in xlsx.xlsx_records(found).groupBy("kind").count().collect()}
    assert kinds["row"] == 10 and "cell" not in kinds


def test_cells_outside_of_rows(tmp_path):
    xml = b"<w><row><c><v>1</v></c></row><c t='str'><v>between</v></c><row r='5'><c><v>2</v></c></row><c><v>lost</v></c></w>"
    from respgrid.limits import Limits

    rows = list(xlsx._Cells("p", Limits()).over(xml))
    assert [[(c[0], c[4]) for c in r["cells"]] for r in rows] == [[(0, "1")], [(0, "2"), (1, "between")]] and rows[1]["number"] == 5


def test_sorts_compute_their_keys_once(spark):
    plans = []
    grid.sort_rows(sheets_of(spark, 3), 0, False, lambda df, name: plans.append(plan(df)) or staged(df, name))
    sort = next(line for line in plans[0].splitlines() if "Sort [" in line)
    assert "CASE WHEN" not in sort and "try_element_at" not in sort
