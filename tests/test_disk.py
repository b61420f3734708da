"""What queries leave on disk: which rows are exchanged and sorted, by the plans of their steps."""

import time
from pathlib import Path

import pytest

from respgrid.jobs import fixtures, queries
from respgrid.operators import storage
from respgrid.sources import xls
from tests.test_queries import SF


def nodes(df, name):
    """The columns of a plan's nodes of this name."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.initialPlan())
            continue
        if node.nodeName() == name:
            found.append([node.output().apply(i).name() for i in range(node.output().size())])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("name", ["x10_assembled_cells", "x11_dense_rows", "a1_sheet_shape"])
def test_lines_are_exchanged_and_rows_with_cells_are_not(spark, name):
    df = queries.queries()[name](spark, SF)
    assert not [x for x in nodes(df, "Exchange") if "cells" in x]
    sorted_cells = [x for x in nodes(df, "Sort") if {"cells", "placed"} & set(x)]
    assert len(sorted_cells) == (0 if name == "a1_sheet_shape" else 1)


def test_no_task_has_many_more_rows_than_it_should(spark):
    rows = spark.range(1000)
    assert fixtures.dealt(rows, "id", most=100).rdd.getNumPartitions() == 10
    assert fixtures.dealt(rows, "id", most=1000).rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def shuffle_files(spark):
    """The data files of shuffles that lie on disk."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}


def test_a_stored_table_leaves_no_shuffle(spark, tmp_path):
    before = shuffle_files(spark)
    found = storage.stored(spark.range(1000).repartition(3, "id"), f"file://{tmp_path}/t")
    left = shuffle_files(spark) - before
    for _ in range(50):  # executors remove them by themselves
        left = {p for p in left if p.exists()}
        if left:
            time.sleep(0.1)
    assert not left and found.count() == 1000 and spark.conf.get(storage.CLEANUP, None) is None


def test_tables_that_pass_are_removed(spark, tmp_path):
    with queries.passing(spark) as passed:
        kept = queries.staged(passed(spark.range(10), "passed"), "kept")
        gone = passed(spark.range(5), "gone").inputFiles()
    assert kept.count() == 10 and not any(Path(p.removeprefix("file://").removeprefix("file:")).exists() for p in gone)


def test_an_export_sorts_rows_once_and_moves_no_header(spark, monkeypatch):
    moved = []
    monkeypatch.setattr(storage, "write", lambda df, path, *by, of=storage.write: moved.append((path, nodes(df, "Exchange"))) or of(df, path, *by))
    lines = queries.g7_large_export(spark, SF)
    assert not [x for _, each in moved for x in each if "header" in x]
    assert len([x for _, each in moved for x in each if "cells" in x]) == 1 and not [x for x in nodes(lines, "Exchange") if "cells" in x and "header" in x]
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    last = {Path(path).name for path, _ in moved}
    assert {p.name.split("-")[1] for p in Path(root).iterdir() if p.name in last} == {"rows", "shapes", "sorted", "begins", "widths"}


def test_cells_of_old_books_are_exchanged_once(spark, monkeypatch, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many books
    try:
        found = queries._detected(fixtures.xls_bodies(spark, SF))
        cells = xls.xls_tables(found, f"file://{tmp_path}/xls")["cells"]
        moved = [x for x in nodes(cells, "Exchange") if {"col_idx", "row_idx"} & set(x)]
        want = sorted(map(tuple, cells.collect()))
        monkeypatch.setattr(xls, "TASK", 500)
        again = xls.xls_tables(found, f"file://{tmp_path}/again")["cells"]
        assert len(moved) == 1 and sorted(map(tuple, again.collect())) == want and len(want) > 1000
        assert len([x for x in nodes(again, "Exchange") if {"col_idx", "row_idx"} & set(x)]) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_cells_leave_no_bodies(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(storage, "write", lambda df, path, *by, of=storage.write: paths.append(path) or of(df, path, *by))
    queries.x17_all_cells(spark, SF)
    bodies = [p for p in paths if "respgrid-responses-" in p or "respgrid-detected-" in p]
    assert len(bodies) == 6 and not any(Path(p.removeprefix("file://")).exists() for p in bodies)
