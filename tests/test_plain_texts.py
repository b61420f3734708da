"""What is told without patterns is what patterns told."""

import math

from pyspark.sql import functions as F

from respgrid.functions import detection as D
from respgrid.functions import scalars as S
from respgrid.operators import grid

TEXTS = [None, "", " ", "\x00a\x1f", "  a", " 1,234.5 ", "inf", "+Infinity", "-NaN", "nan", "1e999", "-1e999", "1d", "x", "\n7\t", "é ", "1 2"]


def test_edges_and_numbers(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    bare = F.replace(F.regexp_replace("t", r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), F.lit(","), F.lit(""))
    ok = ~bare.rlike(r"(?i)^[+-]?(?:inf|nan)") | bare.rlike(r"^[+-]?(?:Infinity|NaN)\z")
    found = rows.select(
        S.trim_edges(F.col("t")), F.regexp_replace("t", r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), S.as_number(F.col("t")), F.when(ok, bare.try_cast("double"))
    ).collect()
    for trimmed, plain, number, told in found:
        assert trimmed == plain
        assert number == told or math.isnan(number) and math.isnan(told)


def test_delimiters_without_quotes_and_with(spark):
    texts = ["a;b\n1;2\n", 'a,"x;y"\n1,2\n', "a\n1\n", 'x|"\n"|y\n1|2|3\n', "a,b;c\n1,2;3\n", ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [x[0] for x in rows.select(D.guess_delimiter(F.col("t"))).collect()] == [";", ",", None, "|", ",", None]


def test_lines_make_their_data_once(spark):
    rows = spark.createDataFrame([(1, 0, 0, ["h", ""]), (1, 0, 1, ["b"]), (1, 0, 2, ["a,", "c"]), (2, 0, 0, ["only"])], "response_id long, sheet_idx int, row_idx int, cells array<string>")
    sheets = spark.createDataFrame([(1, 0, 2), (2, 0, 1)], "response_id long, sheet_idx int, n_cols int")
    lines = grid.csv_lines(grid.promote_header(rows, sheets), sheets)
    assert sorted(tuple(x) for x in lines.collect()) == [(1, 0, 0, "h,B"), (1, 0, 1, "b,"), (1, 0, 2, '"a,",c')]
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
