"""Ranks and line numbers found by several tasks are those that one task finds."""

import random

import pytest
from pyspark.sql import functions as F

from respgrid.jobs.queries import staged
from respgrid.operators import grid


def sheets_of(spark, seed, n=900):
    r = random.Random(seed)
    cells = lambda: [r.choice(["", "b", "B", "-0", "0", "1e3", "1,000", "É", "nan", "x y", str(r.randrange(50)), f"{r.random():.2f}"])] * r.randrange(2)
    rows = [(s, k % 2, k, cells()) for s in range(3) for k in range(n if s == 1 else 7)]
    return spark.createDataFrame(rows, "response_id long, sheet_idx int, row_idx int, cells array<string>").repartition(5)


@pytest.mark.parametrize("ascending", [True, False])
def test_ranks(spark, ascending):
    rows = sheets_of(spark, 3)
    columns = ["response_id", "sheet_idx", "row_idx", "rank"]
    want = sorted(map(tuple, grid.sort_rows(rows, 0, ascending).select(*columns).collect()))
    assert sorted(map(tuple, grid.sort_rows(rows, 0, ascending, staged).select(*columns).collect())) == want
    assert grid.sort_rows(rows.where("false"), 0, ascending, staged).count() == 0


def test_one_sheet_is_sorted_by_several_tasks(spark):
    tasks = []

    def stage(df, name):
        found = staged(df, name)
        if name == "sorted-rows":
            tasks.append(found.where("response_id = 1 and sheet_idx = 1").select("__task").distinct().count())
        return found

    rows = sheets_of(spark, 4)
    grid.sort_rows(rows, 0, True, stage)
    assert tasks[0] > 1


def test_lines(spark):
    rows = sheets_of(spark, 5).withColumn("header", F.array(F.lit("a"), F.lit("b")))
    shape = rows.groupBy("response_id", "sheet_idx").agg(F.lit(2).alias("n_cols"))
    want = sorted(map(tuple, grid.csv_lines(rows, shape).collect()))
    assert sorted(map(tuple, grid.csv_lines(rows, shape, stage=staged).collect())) == want
