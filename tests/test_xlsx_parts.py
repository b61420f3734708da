"""Parts of one XLSX book walked by several tasks give what one task gives."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from respgrid.jobs.queries import staged
from respgrid.limits import Limits
from respgrid.operators import detect
from respgrid.sources import xlsx
from tests.test_files import responses

HEAD = '<workbook xmlns:r="r"><sheets>{}</sheets></workbook>'


def book(n_sheets, rows=3, extra=(), deflate=True, lost=()):
    sheets = "".join(f'<sheet name="S{k}" r:id="rId{k}"/>' for k in range(n_sheets))
    rels = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(n_sheets))
    parts = [("xl/sharedStrings.xml", "<sst><si><t>one</t></si><si><t>two</t></si></sst>"), ("xl/workbook.xml", HEAD.format(sheets)), ("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")]
    for k in range(n_sheets):
        cells = "".join(f'<row r="{r + 1}"><c r="A{r + 1}"><v>{k * 1000 + r}</v></c><c r="B{r + 1}" t="s"><v>{r % 2}</v></c></row>' for r in range(rows))
        if k not in lost:
            parts.append((f"xl/worksheets/sheet{k}.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED) as container:
        for name, xml in [*parts, *extra]:
            container.writestr(name, xml)
    return out.getvalue()


def damaged(body):
    """One byte of the last sheet's packed data turned round."""
    with zipfile.ZipFile(io.BytesIO(body)) as container:
        entry = container.infolist()[-1]
    out = bytearray(body)
    out[entry.header_offset + 30 + len(entry.filename) + entry.compress_size // 2] ^= 0xFF
    return bytes(out)


def tables_of(spark, bodies, path, limits, large):
    found = staged(detect.detect(responses(spark, bodies, None, "f.xlsx")), "detected")
    tables = xlsx.xlsx_tables(found, path, limits, large)
    columns = {"cells": ["response_id", "sheet_idx", "row_idx", "col_idx", "text"], "sheets": ["response_id", "sheet_idx", "name", "n_rows", "n_cols", "truncated"], "warnings": ["response_id", "seq", "message"], "errors": ["response_id", "message"]}
    return {k: sorted(map(str, tables[k].select(*c).collect())) for k, c in columns.items()}


@pytest.mark.parametrize("limits", [Limits(), Limits(zip_entries=6), Limits(unzipped_bytes=1500), Limits(rows=2)])
def test_dealt_parts_against_whole_books(spark, tmp_path, limits):
    again = ("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c t="str"><v>again</v></c></row></sheetData></worksheet>')
    bad_xml = ("xl/worksheets/sheet9.xml", "<worksheet><row>")
    bodies = [book(4), book(3, deflate=False), book(3, extra=[again]), book(2, lost=[1]), book(2, extra=[bad_xml]), damaged(book(2, rows=40)), b"PK\3\4 xl/workbook.xml no container", book(0)]
    whole = tables_of(spark, bodies, f"file://{tmp_path}/whole", limits, 1 << 30)
    dealt = tables_of(spark, bodies, f"file://{tmp_path}/dealt", limits, 0)
    assert dealt == whole
    if limits == Limits():
        assert len(whole["errors"]) == 4 and any("again" in x for x in whole["cells"]) and len(whole["warnings"]) == 1


def test_sheets_of_one_book_in_several_tasks(spark):
    found = staged(detect.detect(responses(spark, [book(20, rows=50)], None, "f.xlsx")), "detected")
    rows = xlsx.xlsx_records(found, large=100).where("kind = 'row'").withColumn("task", F.spark_partition_id())
    tasks = rows.groupBy("task").agg(F.countDistinct("part").alias("parts")).collect()
    assert len(tasks) > 2 and sum(t["parts"] for t in tasks) == 20


def test_parts_that_are_packed_otherwise():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_BZIP2) as container:
        container.writestr("xl/workbook.xml", HEAD.format(""))
    with pytest.raises(NotImplementedError):
        list(xlsx.records(out.getvalue()))
