"""The registered queries of the library's operators; each works on what Spark derives from the given tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respgrid.functions import detection as D
from respgrid.functions import scalars as S
from respgrid.jobs import fixtures as X
from respgrid.limits import Limits
from respgrid.operators import delimited, detect, grid, large_bodies, reports, storage, tables, workbook
from respgrid.sources import responses, xls, xlsx
from respgrid.streaming import triage

Query = Callable[[SparkSession, str], DataFrame]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local one only on one machine, as in tests, where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/respgrid-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder: what follows reads it as often as it likes, and filters reach the scan."""
    return storage.stored(df, scratch(df.sparkSession, name))


@contextmanager
def passing(spark: SparkSession) -> Iterator[grid.Stage]:
    """staged, for tables that are removed at the end: by then what is made of them must be stored."""
    paths: list[str] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch(spark, name))
        return storage.stored(df, paths[-1])

    yield stage
    for path in paths:
        storage.remove(spark, path)


def _detected(bodies: DataFrame, stage: grid.Stage = staged) -> DataFrame:
    """bodies as a table of captured responses, and what is detected in them, stored; the former goes."""
    with passing(bodies.sparkSession) as passed:
        return stage(detect.detect(passed(bodies, "responses")), "detected")


def _order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(delimited.parse_delimited(_detected(X.orders(spark, sf_dir))), "sheets")


def _order_data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Data rows with their header, and sheets."""
    parsed = _order_sheets(spark, sf_dir)
    sheets = parsed.select("response_id", "sheet_idx", "name", "n_rows", "n_cols", "truncated")
    return grid.promote_header(delimited.sheet_rows(parsed), sheets), sheets


def _records(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Workbook records. Rows are read once, so that they needn't be stored."""
    return X.workbook_records(spark, sf_dir)


# Sources and sinks


def s1_read_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "responses")
    X.pages(spark, sf_dir).write.parquet(path)
    found = responses.read_responses(spark, path)
    return found.select("response_id", "request_path", "content_type", F.length("body").alias("n_bytes"), D.body_ok(F.col("body"), Limits(body_bytes=3000)).alias("ok"))


def k1_savable_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "bodies")
    responses.write_bodies(_detected(X.pages(spark, sf_dir)), path)
    return spark.read.parquet(path).select("response_id", "file_type", "suggested_name", F.length("expanded").alias("n_bytes"))


def k2_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, sheets = _order_data(spark, sf_dir)
    path, lines = scratch(spark, "csv"), grid.csv_lines(data, sheets)
    responses.write_csv_export(lines, path)
    # No field of an order has a line feed, so that a line of text is a line of the export.
    found = responses.read_csv_export(spark, path).withColumn("response_id", F.col("response_id").cast("int"))
    return found.groupBy("response_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


# Detection


def d4_d6_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pages(spark, sf_dir).select("response_id", S.file_name(F.col("content_disposition"), F.col("request_path")).alias("file_name"))


def d7_pdf_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.docs(spark, sf_dir).select("response_id", D.has_pdf_marker(F.col("body")).alias("pdf"), D.is_gzip(F.col("body")).alias("gzip"), D.is_zip(F.col("body")).alias("zip"))


def d10_declared_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = X.pages(spark, sf_dir).withColumn("name", S.file_name(F.col("content_disposition"), F.col("request_path")))
    return named.select("response_id", D.declared_text_type(F.col("content_type"), F.col("name")).alias("declared"), D.mentions_compression(F.col("content_type")).alias("compressed"))


def d11_mostly_printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A control character after every hundredth letter e and more often, so that both answers occur.
    text = F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("text"), F.lit("e"), F.char(F.lit(1)))).otherwise(F.col("text"))
    return X.table(spark, sf_dir, "documents").select("doc_id", D.mostly_printable(F.substring(text, 1, 8192)).alias("printable"))


def d12_guess_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", D.guess_delimiter(F.substring("text", 1, 8192)).alias("delimiter"))


def d13_classify_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return X.orders(spark, sf_dir).select("response_id", D.classify(F.col("body"), F.col("content_type"), none).alias("file_type"))


def d14_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(X.pages(spark, sf_dir)).select("response_id", "file_type", "file_name", "decompressed", "original_length", F.length("expanded").alias("n_bytes"))


def d15_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.sniff(X.docs(spark, sf_dir))


def d2_compressed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.compressed(spark, sf_dir).select("response_id", D.is_gzip(F.col("body")).alias("gzip"), D.mentions_compression(F.col("content_type")).alias("mentioned"))


def d3_expanded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _detected(X.compressed(spark, sf_dir))
    return found.select("response_id", "file_type", "decompressed", F.length("expanded").alias("n_bytes"), F.sha2("expanded", 256).alias("digest"), (F.col("original_length") > 0).alias("has_length"))


def d3_many_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _detected(X.many_members(spark, sf_dir))
    return found.select("response_id", "file_type", "decompressed", F.length("expanded").alias("n_bytes"), F.sha2("expanded", 256).alias("digest"))


def d9_legacy_excel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.xls_bodies(spark, sf_dir)
    # A container that has no workbook, too: it is legacy Excel by its headers only.
    other = F.concat(F.unhex(F.lit(D.CFB)), F.encode(F.col("request_path"), "UTF-8"))
    both = found.unionByName(found.withColumn("response_id", -1 - F.col("response_id")).withColumn("body", other))
    named = both.withColumn("name", S.file_name(F.col("content_disposition"), F.col("request_path")))
    return named.select("response_id", D.is_legacy_excel(F.col("body"), F.col("content_type"), F.col("name")).alias("excel"), D.classify(F.col("body"), F.col("content_type"), F.col("name")).alias("file_type"))


def d15_sniff_against_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the end of a compressed body is damaged, its prefix still tells a type."""
    bodies = X.compressed(spark, sf_dir)
    cheap = detect.sniff(bodies, Limits(sniff_bytes=64)).withColumnRenamed("file_type", "sniffed")
    return cheap.join(detect.detect(bodies).select("response_id", "file_type"), "response_id")


def f10_expanded_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = detect.file_header(detect.renderable(_detected(X.compressed(spark, sf_dir))))
    return header.select("response_id", "type_badge", "gzip", F.regexp_extract("meta", r"^(\S+ [KM]?B)(?: expanded from \S+ [KM]?B)?$", 1).alias("size"), F.contains("meta", F.lit("expanded from")).alias("expanded"))


def d16_renderable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.renderable(detect.sniff(X.pages(spark, sf_dir)))


def d18_open_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = Limits(tabular_bytes=2048)
    found = _detected(X.pages(spark, sf_dir))
    outcomes = found.select("response_id", (F.col("response_id") % 3).alias("sheets"), F.when(F.col("response_id") % 11 == 0, "bad quote").alias("error"))
    return detect.open_status(found, outcomes, limits)


# Scalar functions


def f1_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").groupBy("l_extendedprice", "l_discount").agg(F.count(F.lit(1)).alias("n")).select(
        "l_extendedprice", "l_discount", S.number_text(F.col("l_extendedprice")).alias("price"), S.number_text(-F.col("l_discount")).alias("discount"), "n"
    )


def f2_date_serial_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1899-12-30"))).cast("double") + (F.col("l_quantity") % 4) / 4
    days = X.table(spark, sf_dir, "lineitem").select(serial.alias("serial")).distinct()
    return days.select("serial", S.date_serial_text(F.col("serial"), F.lit(False)).alias("shown"), S.date_serial_text(F.col("serial") - 1462, F.lit(True)).alias("shown_1904"))


def f3_f4_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 8
    code = X._cycle(k, [F.concat(F.lit('"'), "p_name", F.lit('"0.00')), F.col("p_name"), F.lit("[Red]0.00"), F.lit('0.00;"m"'), F.lit("[h]:mm"), F.lit("[h]"), F.lit("\\d0"), F.lit("#,##0")])
    return X.table(spark, sf_dir, "part").select("p_partkey", S.is_date_format(code).alias("custom"), S.is_builtin_date_format(F.col("p_size")).alias("builtin"))


def f5_clamp_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", S.clamp_cell(F.when(F.col("doc_id") % 9 != 0, F.col("text")), 400).alias("clamped"))


def f6_as_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sort_mix(spark, sf_dir).select("row_idx", S.as_number(F.col("cells")[0]).alias("number"))


def f7_f8_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = S.column_letters(F.col("i"))
    numbered = X.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 18278).alias("i")).select("p_partkey", "i", letters.alias("letters"))
    return numbered.select("p_partkey", "letters", S.column_index(F.concat(F.lower("letters"), F.lit("12"))).alias("column"), S.column_index(F.col("i").cast("string")).alias("none"))


def f9_human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * F.col("o_orderkey") * 37 % 50_000_000).alias("n")
    return X.table(spark, sf_dir, "orders").select("o_orderkey", n).select("o_orderkey", S.human_bytes(F.col("n")).alias("shown"))


def f10_f13_file_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.file_header(detect.renderable(_detected(X.pages(spark, sf_dir))))


def f11_suggested_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.pages(spark, sf_dir).withColumn("name", S.file_name(F.col("content_disposition"), F.col("request_path")))
    kind = X._cycle(F.col("response_id") % 6, ["PDF", "XLSX", "XLS", "TSV", "CSV", "UNKNOWN"])
    name = F.when(F.col("response_id") % 2 == 0, F.col("name"))
    return found.select("response_id", S.suggested_name(name, kind).alias("suggested_name"), S.caption(kind).alias("caption"), S.is_tabular(kind).alias("tabular"))


def f12_csv_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", S.csv_quote(F.col("text")).alias("quoted"))


def x13_boolerr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "part").select("p_partkey", S.boolerr_text(F.col("p_size"), F.col("p_partkey") % 2 == 0).alias("shown"))


# Delimited bodies


def c2_delimiter_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _detected(X.orders(spark, sf_dir))
    return found.select("response_id", "file_type", delimited.parse_delimiter(F.col("file_type"), delimited.decode_text(F.col("expanded"))).alias("delimiter"))


def c3_order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.cells_of_rows(delimited.sheet_rows(_order_sheets(spark, sf_dir)))


def c4_quoted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delimited.sheet_rows(delimited.parse_delimited(_detected(X.documents_csv(spark, sf_dir))))
    return rows.select("response_id", "row_idx", F.col("cells")[0].alias("doc_id"), F.col("cells")[1].alias("lang"), F.col("cells")[2].alias("text"), F.size("cells").alias("n"))


def c1_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.encoded(spark, sf_dir).select("response_id", delimited.decode_text(F.col("body")).alias("text"))


def c3_large_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of several hundred kilobytes to megabytes, each cut into records by several tasks."""
    rows, _ = large_bodies.parse_bodies(_detected(X.exports(spark, sf_dir)), staged, large=1 << 16)
    return rows.select("response_id", "row_idx", F.array_join("cells", "|").alias("cells"))


def c5_blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank rows at the start, within and at the end of bodies aren't counted, so that the cap falls on the same row without them."""
    rows, sheets = large_bodies.parse_bodies(_detected(X.exports(spark, sf_dir)), staged, Limits(rows=5000), large=1 << 16)
    found = rows.groupBy("response_id").agg(F.max("row_idx").alias("last_row"), F.max_by(F.col("cells")[0], "row_idx").alias("last_key"))
    return sheets.join(found, "response_id").select("response_id", "name", "n_rows", "n_cols", "truncated", "last_row", "last_key")


def c6_capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = Limits(rows=4, columns=5)
    parsed = delimited.parse_delimited(_detected(X.orders(spark, sf_dir)), limits)
    return parsed.select("response_id", "name", "n_rows", "n_cols", "truncated")


# Workbooks


def x1_sheet_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.workbook_records(spark, sf_dir)
    return workbook.sheet_catalogue(r["sheet"], r["rel"], r["part"]).select("response_id", "sheet_idx", "name", "part")


def x2_missing_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.workbook_records(spark, sf_dir)
    return workbook.missing_sheets(r["sheet"], workbook.sheet_catalogue(r["sheet"], r["rel"], r["part"]))


def x4_style_is_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.workbook_records(spark, sf_dir)
    return workbook.style_is_date(r["xf"], r["numfmt"])


def _in_sheet(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sheet_idx", F.lit(0))


def x3_x5_cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.workbook_records(spark, sf_dir)
    books = workbook.book_styles(workbook.style_is_date(r["xf"], r["numfmt"])).withColumn("date1904", F.lit(False))
    rows = workbook.with_books(r["row"], books, r["sst"], ["response_id"])
    cells = rows.select("response_id", F.col("n").alias("row_n"), "dates", "strings", "pointed", "date1904", F.explode_outer("cells").alias("c")).where("c is not null")
    return cells.select("response_id", "row_n", "c.cell_n", workbook.text_with_book(F.col("c")).alias("text"))


def x6_place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbook.place_rows(_in_sheet(X.workbook_records(spark, sf_dir)["row"]), Limits(rows=500)).select("response_id", "n", "row_idx", "truncated")


def x7_place_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = lambda c: S.let(S.column_index(c["ref"]), lambda x: F.when(x >= 0, x))
    known = F.transform("cells", lambda c: F.struct(c["cell_n"].alias("cell_n"), column(c).alias("place"), c["v"].alias("text")))
    rows = X.workbook_records(spark, sf_dir)["row"].select("response_id", F.col("n").alias("row_n"), S.let(known, workbook.placed_cells).alias("cells"))
    # As in sheet_rows: an inner explode would have cells made twice.
    return rows.select("response_id", "row_n", F.explode_outer("cells").alias("c")).where("c is not null").select("response_id", "row_n", "c.cell_n", "c.col_idx")


def x8_last_cell_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    cells = X.table(spark, sf_dir, "lineitem").select(
        (key % 97).alias("response_id"), F.lit(0).alias("sheet_idx"), (key % 50).cast("int").alias("row_idx"), F.col("l_linenumber").alias("col_idx"),
        F.struct(key, "l_partkey", "l_suppkey", "l_extendedprice").alias("cell_n"), F.col("l_partkey").cast("string").alias("text"),
    )
    return workbook.last_cell_wins(cells)


def x9_cut_wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = X.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("response_id"), F.lit(0).alias("sheet_idx"), F.expr("l_orderkey div 10").alias("row_n"), F.col("l_partkey").cast("int").alias("col_idx")
    )
    top = cells.groupBy().agg((F.max("col_idx") - 2).alias("cap")).first()["cap"]
    kept, cuts = workbook.cut_wide_rows(cells, Limits(columns=top))
    counted = kept.groupBy("response_id").agg(F.count(F.lit(1)).alias("kept"), F.max("row_n").alias("last_row"))
    joined = counted.join(cuts.select("response_id", "cut_at"), "response_id", "full")
    return joined.select("response_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("kept", "last_row", "cut_at")])


def x10_assembled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbook.assemble(_records(spark, sf_dir))["cells"]


def x11_dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workbook.dense_rows(workbook.assemble(_records(spark, sf_dir))["packed"], workbook.PLACE)
    return rows.select("response_id", "row_idx", F.array_join("cells", "|").alias("cells"), F.size("cells").alias("width"))


def x15_out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_orderkey").alias("row_idx"), F.col("l_partkey").alias("col_idx"))
    kept = workbook.drop_out_of_bounds(cells, Limits(rows=900, columns=150))
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("cells"))


def x17_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = X.xlsx_bodies(spark, sf_dir).withColumn("response_id", -1 - F.col("response_id"))
    early = X.xls_bodies(spark, sf_dir).withColumn("response_id", -1_000_000_000 - F.col("response_id"))
    with passing(spark) as passed:
        found = [_detected(bodies, passed) for bodies in (X.orders(spark, sf_dir), books, early)]
        cells = tables.to_cells(reduce(DataFrame.unionByName, found), scratch(spark, "tables"))
    return cells.groupBy("response_id").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.length("text")).alias("chars"))


def s3_xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xlsx.xlsx_tables(_detected(X.xlsx_bodies(spark, sf_dir)), scratch(spark, "xlsx"))["cells"]


def s3_rich_xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, gaps between rows and cells, rich and phonetic strings, booleans, formulas' values and errors."""
    return xlsx.xlsx_tables(_detected(X.rich_xlsx_bodies(spark, sf_dir)), scratch(spark, "xlsx"))["cells"].where("text != ''")


def _many_sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of books of some twenty sheets each, whose parts are dealt out to tasks."""
    return xlsx.xlsx_tables(_detected(X.many_sheet_bodies(spark, sf_dir)), scratch(spark, "xlsx"), large=0)


def s3_many_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates by a custom format, which some books declare twice; sheets without a relation or a part have no cells."""
    return _many_sheets(spark, sf_dir)["cells"]


def x1_x2_many_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _many_sheets(spark, sf_dir)
    sheets = found["sheets"].select("response_id", F.lit("sheet").alias("kind"), F.col("sheet_idx").alias("place"), F.concat_ws(" ", "name", "n_rows", "n_cols").alias("message"))
    return sheets.unionByName(found["warnings"].select("response_id", F.lit("warning").alias("kind"), F.col("seq").alias("place"), "message"))


def s4_xls_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in 32 bits, formulas' cached values and strings cut by a continuation, through the reader of legacy workbooks."""
    return xls.xls_tables(_detected(X.xls_bodies(spark, sf_dir)), scratch(spark, "xls"))["cells"].select("response_id", "sheet_idx", "row_idx", "col_idx", "text")


def x14_formula_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = xls.xls_tables(_detected(X.xls_bodies(spark, sf_dir)), scratch(spark, "xls"))["cells"]
    return cells.where(F.col("col_idx").isin(5, 6)).groupBy("response_id", "col_idx", "text").agg(F.count(F.lit(1)).alias("n"))


def x12_packed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = xls.xls_tables(_detected(X.xls_bodies(spark, sf_dir)), scratch(spark, "xls"))["cells"]
    return cells.where(F.col("col_idx").isin(2, 4)).groupBy("response_id", "col_idx").agg(F.round(F.sum(F.col("text").cast("double")), 2).alias("total"), F.count(F.lit(1)).alias("n"))


def x16_xls_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = xls.xls_tables(_detected(X.xls_bodies(spark, sf_dir)), scratch(spark, "xls"))
    kinds = [tables[kind].select("response_id", F.lit(kind).alias("kind"), "message") for kind in ("warnings", "errors")]
    shape = tables["sheets"].select("response_id", F.lit("sheets").alias("kind"), F.concat_ws(" ", "name", "n_rows", "n_cols").alias("message"))
    return kinds[0].unionByName(kinds[1]).unionByName(shape)


# The grid


def g1_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.to_wide(delimited.sheet_rows(_order_sheets(spark, sf_dir)), 7, ["line", "part", "line"])


def g2_g3_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, _ = _order_data(spark, sf_dir)
    return data.select("response_id", "source_row", F.array_join("header", ",").alias("header"), F.col("cells")[3].alias("price"))


def g4_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, _ = _order_data(spark, sf_dir)
    return grid.filter_contains(data, "r").unionByName(grid.filter_contains(data, "7.5")).select("response_id", "source_row")


def g5_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.sort_mix(spark, sf_dir)
    down = grid.sort_rows(rows, 0, ascending=False).select("response_id", "row_idx", F.col("rank").alias("rank_down"))
    return grid.sort_rows(rows, 0).select("response_id", "row_idx", "rank").join(down, ["response_id", "row_idx"])


def g6_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, sheets = _order_data(spark, sf_dir)
    return grid.row_counts(data, sheets, grid.contains_text("R")).select("response_id", "counts")


def g7_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, sheets = _order_data(spark, sf_dir)
    return grid.csv_lines(data, sheets).select("response_id", "line_no", "line")


def g7_large_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large bodies sorted by price, dearest first, and written as lines; several tasks sort and number a body's rows."""
    with passing(spark) as passed:
        rows, sheets = large_bodies.parse_bodies(_detected(X.exports(spark, sf_dir), passed), passed, large=1 << 16)
        rows, sheets = staged(rows, "rows"), staged(sheets, "shapes")
    # Headers join when rows are sorted, so that they aren't sorted with them.
    data = grid.sort_rows(rows.where("row_idx > 0"), 2, ascending=False, stage=staged)
    return grid.csv_lines(grid.with_first_header(data, grid.headers(rows, sheets), "rank"), sheets, "rank", stage=staged, told=True).select("response_id", "line_no", "line")


def g8_numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _order_sheets(spark, sf_dir)
    return grid.numeric_cells(delimited.sheet_rows(parsed), parsed).select("response_id", "col_idx", "numeric", "total")


def g9_column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, _ = _order_data(spark, sf_dir)
    return grid.column_width_sample(data, 3).select("response_id", "col_idx", "width")


def g10_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = Limits(rows=4)
    sheets = delimited.parse_delimited(_detected(X.orders(spark, sf_dir)), limits)
    keys = sheets.where("response_id % 3 = 0").select("response_id")
    warned = keys.select("response_id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("second").alias("message")), F.struct(F.lit(0).alias("seq"), F.lit("first").alias("message")))).alias("w"))
    return grid.notices(warned.select("response_id", "w.*"), sheets)


def g11_sample_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, _ = _order_data(spark, sf_dir)
    return grid.sample_head(data, 2).groupBy("response_id").agg(F.count(F.lit(1)).alias("n"), F.max("source_row").alias("last"))


# Aggregations and streams


def a1_sheet_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbook.assemble(_records(spark, sf_dir))["sheets"]


def a2_triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.triage_summary(_detected(X.pages(spark, sf_dir).unionByName(X.orders(spark, sf_dir))))


def a3_open_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.open_summary(d18_open_status(spark, sf_dir))


def t1_triage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, sink = scratch(spark, "arriving"), scratch(spark, "triaged")
    X.pages(spark, sf_dir).write.parquet(source)
    triage.triage_stream(spark, source, sink, scratch(spark, "stream")).awaitTermination()
    return spark.read.schema("response_id long, file_type string").parquet(sink)


def t2_latest_per_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return triage.latest_per_view(events, "user_id", "event_id")


EVENTS = "user_id long, event_id long, event_type string"


def _arrive(spark: SparkSession, sf_dir: str, rounds: int) -> str:
    """The sink of a stream to which the events come in so many rounds, by event_id; between them the stream ends and is started again."""
    source, sink, checkpoint = scratch(spark, "results"), scratch(spark, "newest"), scratch(spark, "stream")
    events = X.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    for k in range(rounds):
        events.where(F.col("event_id") % rounds == k).write.mode("append").parquet(source)
        triage.latest_stream(spark.readStream.schema(EVENTS).parquet(source), "user_id", "event_id", sink, checkpoint).awaitTermination()
    return sink


def t2_latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as t2_latest_per_view, from a stream that is started again and again."""
    return triage.latest_of(spark, _arrive(spark, sf_dir, 2), "user_id", "event_id")


def t2_stream_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the stream has written: a round's newest results, without those that are older than what rounds before have shown."""
    return spark.read.parquet(_arrive(spark, sf_dir, 4)).select("batch", "user_id", "event_id", "event_type")


ALL: list[Query] = [
    s1_read_responses, k1_savable_bodies, k2_csv_export, s3_xlsx_cells, s3_rich_xlsx_cells, s3_many_sheets, x1_x2_many_sheets,
    d2_compressed_flags, d3_expanded_bodies, d3_many_members, d9_legacy_excel, d15_sniff_against_detect, f10_expanded_header, s4_xls_cells, x12_packed_numbers, x14_formula_values, x16_xls_messages,
    d4_d6_file_name, d7_pdf_marker, d10_declared_type, d11_mostly_printable, d12_guess_delimiter, d13_classify_orders, d14_detect, d15_sniff, d16_renderable, d18_open_status,
    f1_number_text, f2_date_serial_text, f3_f4_date_formats, f5_clamp_cell, f6_as_number, f7_f8_columns, f9_human_bytes, f10_f13_file_header, f11_suggested_name, f12_csv_quote,
    c1_encodings, c2_delimiter_of_orders, c3_order_cells, c3_large_bodies, c4_quoted_fields, c5_blank_rows, c6_capped_rows,
    x1_sheet_catalogue, x2_missing_sheets, x3_x5_cell_text, x4_style_is_date, x6_place_rows, x7_place_columns, x8_last_cell_wins, x9_cut_wide_rows, x10_assembled_cells, x11_dense_rows,
    x13_boolerr_text, x15_out_of_bounds, x17_all_cells,
    g1_to_wide, g2_g3_header, g4_filter, g5_sort, g6_row_counts, g7_csv_lines, g7_large_export, g8_numeric_cells, g9_column_widths, g10_notices, g11_sample_head,
    a1_sheet_shape, a2_triage_summary, a3_open_summary, t1_triage_stream, t2_latest_per_view, t2_latest_stream, t2_stream_updates,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in ALL}
