"""Every tabular file of a collection as one table of cells."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respgrid.limits import DEFAULT, Limits
from respgrid.operators import delimited, large_bodies, storage, workbook
from respgrid.sources import xls, xlsx


@dataclass(frozen=True)
class Tables:
    """cells, sheets, warnings and errors of all files; keyed by response_id."""

    cells: DataFrame
    sheets: DataFrame
    warnings: DataFrame
    errors: DataFrame


def to_tables(detected: DataFrame, staging: str, limits: Limits = DEFAULT) -> Tables:
    """Each detected file read by its type's reader, the results stacked. Types that aren't tabular have no rows.

    Workbooks' records are staged in folders under staging. detected is read once by each reader: store it before. Then nothing reads it any more.
    """

    def stage(df: DataFrame, name: str) -> DataFrame:
        return storage.stored(df, f"{staging}/{name}-{uuid.uuid4().hex}")

    rows, shape = large_bodies.parse_bodies(detected, stage, limits)
    books = [xlsx.xlsx_tables(detected, f"{staging}/xlsx", limits), xls.xls_tables(detected, f"{staging}/xls", limits)]
    cells = delimited.cells_of_rows(rows)
    return Tables(
        workbook.union_cells(cells, *[b["cells"] for b in books]),
        books[0]["sheets"].unionByName(books[1]["sheets"]).unionByName(shape),
        books[0]["warnings"].unionByName(books[1]["warnings"]),
        books[0]["errors"].unionByName(books[1]["errors"]),
    )


def to_cells(detected: DataFrame, staging: str, limits: Limits = DEFAULT) -> DataFrame:
    """response_id, sheet_idx, row_idx, col_idx and text of every cell of every tabular file."""
    return to_tables(detected, staging, limits).cells
