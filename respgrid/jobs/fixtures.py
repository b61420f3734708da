"""Captured responses and staged workbook records, derived by Spark from the given tables.

The registered queries work on these; the same derivations are written in SQL in oracles.py.
"""

from __future__ import annotations

import gzip
import struct
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from respgrid.operators.batches import made_batches, map_batches
from respgrid.operators.storage import dealt

HEADER = ["line", "part", "quantity", "price", "flag", "shipped"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cycle(key: Column, values: list[Column | str | None]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in enumerate(values):
        out = out.when(key == k, v if isinstance(v, Column) else F.lit(v).cast("string"))
    return out


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response for each page, with headers that vary by its id."""
    key = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        key.alias("response_id"),
        F.regexp_replace("url", "^[a-z]+://[^/]+", "").alias("request_path"),
        _cycle(key % 5, ["text/html", None, "text/plain", "application/octet-stream", "text/csv"]).alias("content_type"),
        _cycle(
            key % 4,
            [
                None,
                F.concat(F.lit('attachment; filename="p'), key.cast("string"), F.lit('.csv"')),
                F.concat(F.lit("attachment; filename*=UTF-8''p%20"), key.cast("string"), F.lit(".tsv")),
                "inline; filename=",
            ],
        ).alias("content_disposition"),
        F.encode("html", "UTF-8").alias("body"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response for each document; some have a PDF marker at, just inside or just outside the searched window."""
    key = F.col("doc_id")
    marker = F.lit("%PDF-1.7")
    text = (
        F.when(key % 7 == 0, F.concat(marker, F.col("text")))
        .when(key % 7 == 1, F.concat(F.repeat(F.lit(" "), F.lit(1024)), marker, F.col("text")))
        .when(key % 7 == 2, F.concat(F.repeat(F.lit(" "), F.lit(1025)), marker, F.col("text")))
        .otherwise(F.col("text"))
    )
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        key.alias("response_id"),
        F.concat(F.lit("/files/"), key.cast("string")).alias("request_path"),
        F.when(key % 2 == 0, "text/plain").alias("content_type"),
        none.alias("content_disposition"),
        F.encode(text, "UTF-8").alias("body"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delimited body for each order: a header, then its lines; delimiter and line end vary by its key."""
    key = F.col("l_orderkey")
    delimiter = _cycle(key % 4, [",", ";", "\t", "|"])
    money = lambda c: F.col(c).cast("decimal(12,2)").cast("string")
    fields = [
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        money("l_quantity"),
        money("l_extendedprice"),
        F.col("l_returnflag"),
        F.date_format("l_shipdate", "yyyy-MM-dd"),
    ]
    lines = table(spark, sf_dir, "lineitem").select(key, F.col("l_linenumber").alias("n"), F.call_function("concat_ws", delimiter, *fields).alias("line"))
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    end = F.when(key % 3 == 1, "\r\n").otherwise("\n")
    body = F.call_function("concat_ws", end, F.call_function("concat_ws", delimiter, *[F.lit(h) for h in HEADER]), F.transform("lines", lambda x: x["line"]))
    body = F.concat(body, F.when(key % 3 == 2, "").otherwise(end), F.when(key % 5 == 0, end).otherwise(""))
    none = F.lit(None).cast("string")
    return grouped.select(
        key.alias("response_id"),
        F.concat(F.lit("/orders/"), key.cast("string"), F.lit("?full=1")).alias("request_path"),
        F.lit("text/plain").alias("content_type"),
        none.alias("content_disposition"),
        F.encode(body, "UTF-8").alias("body"),
    )


def documents_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV bodies of 50 documents each, every field quoted."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", quoted("doc_id"), quoted("lang"), quoted("text"))
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("response_id"), "doc_id", line.alias("line"))
    grouped = rows.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "line"))).alias("lines"))
    none = F.lit(None).cast("string")
    return grouped.select(
        "response_id",
        F.lit("/documents.csv").alias("request_path"),
        none.alias("content_type"),
        none.alias("content_disposition"),
        F.encode(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), "UTF-8").alias("body"),
    )


#: Rows that count as blank, and how many order keys a large export has.
BLANK, EXPORTED = ["", " , ,", "\t ", '""', ",,,"], 8192


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large CSV bodies, each of the lines of a range of orders: key, number, price and a note, which every third number has in quotes over two lines.

    There are blank rows of several kinds at the start, at the end and before lines of some orders; line ends vary by body.
    """
    key, body = F.col("l_orderkey"), F.expr(f"l_orderkey div {EXPORTED}")
    end = F.when(body % 3 == 1, "\r\n").when(body % 3 == 2, "\r").otherwise("\n")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    note = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit('"'), "l_returnflag", F.lit(', ""'), "l_linestatus", F.lit('""\n'), day, F.lit('"'))).otherwise(day)
    line = F.concat_ws(",", key.cast("string"), F.col("l_linenumber").cast("string"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), note)
    rows = table(spark, sf_dir, "lineitem").select(body.alias("response_id"), end.alias("end"), key, F.col("l_linenumber").alias("n"), line.alias("line"))
    grouped = rows.groupBy("response_id", "end").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "n", "line"))).alias("lines"))
    def with_blanks(x: Column) -> Column:
        kind = F.element_at(F.array(*map(F.lit, BLANK)), (x["l_orderkey"] % len(BLANK)).cast("int") + 1)
        return F.when(x["l_orderkey"] % 7 == 0, F.concat(kind, F.col("end"), x["line"])).otherwise(x["line"])

    text = F.concat(F.lit(" ,"), "end", "end", F.call_function("array_join", F.transform("lines", with_blanks), F.col("end")), "end", "end", F.lit(",,"))
    none = F.lit(None).cast("string")
    return grouped.select(
        "response_id",
        F.concat(F.lit("/exports/"), F.col("response_id").cast("string"), F.lit(".csv")).alias("request_path"),
        F.lit("text/csv").alias("content_type"),
        none.alias("content_disposition"),
        F.encode(text, "UTF-8").alias("body"),
    )


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of documents in UTF-8, that with its mark, UTF-16 in either order with its mark, and Latin-1, by doc_id; what Latin-1 hasn't is '?' there."""
    kind, text = F.col("doc_id") % 5, F.concat(F.lit("é;"), "text")
    latin = F.regexp_replace(text, r"[^\x00-\xff]", "?")
    marked = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode(text, charset))
    body = (
        F.when(kind == 0, F.encode(text, "UTF-8"))
        .when(kind == 1, marked("EFBBBF", "UTF-8"))
        .when(kind == 2, marked("FFFE", "UTF-16LE"))
        .when(kind == 3, marked("FEFF", "UTF-16BE"))
        .otherwise(F.encode(latin, "ISO-8859-1"))
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("response_id"), body.alias("body"))


def sort_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one cell, a sheet for each brand: numbers, some with commas, names and empty cells."""
    key = F.col("p_partkey")
    number = key * 7 % 5000
    with_comma = F.when(number >= 1000, F.concat(F.expr("p_partkey * 7 % 5000 div 1000").cast("string"), F.lit(","), F.lpad((number % 1000).cast("string"), 3, "0")))
    text = F.when(key % 10 == 0, "").when(key % 6 == 0, F.coalesce(with_comma, number.cast("string"))).when(key % 3 == 0, number.cast("string")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("response_id"), F.lit(0).alias("sheet_idx"), key.cast("int").alias("row_idx"), F.array(text).alias("cells")
    )


def workbook_records(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Staged records as if each supplier had sent a workbook of its order lines.

    A row is a line, by order and number, with its cells in one array. Cells: flag (a shared string), price (a number), ship date (a serial with a
    date style), whether it was returned (a boolean), part key (text), status (inline), and a comment that
    is blank on most rows. Every tenth row declares a number two ahead, every seventh none; every fifth
    cell has no reference.
    """
    listed = table(spark, sf_dir, "lineitem")
    lines = dealt(listed, "l_suppkey").withColumn(
        "n", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus")) - 1
    )
    lines = lines.withColumn("response_id", F.col("l_suppkey"))
    part = F.lit("xl/worksheets/sheet1.xml")
    serial = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1899-12-30")))
    none, text = F.lit(None).cast("string"), lambda c: c.cast("string")

    def cell(at: int, t: str | None, style: int, v: Column, inline: Column) -> Column:
        ref = F.when((F.col("n") + at) % 5 != 4, F.concat(F.lit(chr(65 + at)), (F.col("n") + 1).cast("string")))
        return F.struct(F.lit(at).alias("cell_n"), F.lit(style).alias("style_idx"), ref.alias("ref"), (F.lit(t) if t else none).alias("t"), v.alias("v"), inline.alias("inline_text"))

    cells = F.array(
        cell(0, "s", -1, text(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)), none),
        cell(1, None, 0, text(F.col("l_extendedprice").cast("decimal(12,2)")), none),
        cell(2, "n", 1, text(serial), none),
        cell(3, "b", -1, F.when(F.col("l_returnflag") == "R", "1").otherwise("0"), none),
        cell(4, "str", -1, text(F.col("l_partkey")), none),
        cell(5, "inlineStr", -1, none, F.col("l_linestatus")),
        cell(6, "str", -1, F.when(F.col("n") % 11 == 0, "note").otherwise(""), none),
    )
    declared = F.when(F.col("n") % 7 == 6, None).otherwise(F.col("n") + 1 + 2 * F.expr("(n + 1) div 10")).cast("int")
    rows = lines.select("response_id", part.alias("part"), "n", declared.alias("declared"), cells.alias("cells"))
    books = listed.select(F.col("l_suppkey").alias("response_id")).distinct()
    rel = books.select("response_id", F.lit(0).alias("ord"), F.lit("rId1").alias("rel_id"), F.lit("worksheets/sheet1.xml").alias("target"))
    return {
        "workbook": books,
        "sheet": books.select("response_id", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("Lines").alias("name"), F.lit("rId1").alias("rel_id")), F.struct(F.lit(1).alias("ord"), F.lit("Lost").alias("name"), F.lit("rId9").alias("rel_id")))).alias("s")).select("response_id", "s.*", F.lit(False).alias("date1904")),
        "rel": rel,
        "part": books.select("response_id", part.alias("part")),
        "sst": books.select("response_id", F.posexplode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("sst_idx", "text")),
        "xf": books.select("response_id", F.posexplode(F.array(F.lit(0), F.lit(164))).alias("style_idx", "numfmt_id")),
        "numfmt": books.select("response_id", F.lit(0).alias("ord"), F.lit(164).alias("numfmt_id"), F.lit('yyyy\\-mm\\-dd;"m"').alias("code")),
        "row": rows,
        "error": books.where(F.lit(False)).select("response_id", F.lit("").alias("message")),
    }


def xlsx_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real XLSX body for each customer with orders: a row for each order with key, status and price."""
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("price"))))
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("response_id")).agg(listed.alias("orders"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_batches(batches, lambda _, orders: xlsx_bytes([tuple(o.values()) for o in orders]), "response_id")

    made, none = map_batches(grouped, run, "response_id long, body binary"), F.lit(None).cast("string")
    return made.select("response_id", F.concat(F.lit("/export/"), "response_id").alias("request_path"), none.alias("content_type"), none.alias("content_disposition"), "body")


@lru_cache(256)
def _deflated(xml: str) -> tuple[int, int, bytes]:
    """Checksum, size and packed data of a part."""
    data, packer = xml.encode(), zlib.compressobj(wbits=-15)
    return zlib.crc32(data), len(data), packer.compress(data) + packer.flush()


def container_bytes(parts: dict[str, str]) -> bytes:
    """A ZIP container. Small parts, which most books have alike, are packed once."""
    files, listed, at = [], [], 0
    for name, xml in parts.items():
        crc, size, data = (_deflated if len(xml) < 1024 else _deflated.__wrapped__)(xml)
        head = struct.pack("<5H3I2H", 20, 0, zipfile.ZIP_DEFLATED, 0, 33, crc, len(data), size, len(name), 0)
        files.append(b"PK\3\4" + head + name.encode() + data)
        listed.append(b"PK\1\2" + struct.pack("<H", 20) + head + struct.pack("<3H2I", 0, 0, 0, 0, at) + name.encode())
        at += len(files[-1])
    directory = b"".join(listed)
    return b"".join(files) + directory + b"PK\5\6" + struct.pack("<4H2IH", 0, 0, len(listed), len(listed), len(directory), at, 0)


def xlsx_bytes(rows: list[tuple]) -> bytes:
    statuses = sorted({r[1] for r in rows})
    lines = "".join(
        f'<row r="{k}"><c r="A{k}"><v>{a}</v></c><c r="B{k}" t="s"><v>{statuses.index(b)}</v></c><c r="C{k}"><v>{c}</v></c></row>' for k, (a, b, c) in enumerate(rows, 1)
    )
    parts = {
        "[Content_Types].xml": "<Types/>",
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Orders" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in statuses) + "</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{lines}</sheetData></worksheet>",
    }
    return container_bytes(parts)


def rich_xlsx_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real XLSX body for each customer with orders, on every other row: priority, nothing, date, status, whether it is open, key, an error or nothing, price."""
    day = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1899-12-30")))
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", day.alias("day"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"))))
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("response_id")).agg(listed.alias("orders"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_batches(batches, lambda _, orders: rich_xlsx_bytes([tuple(o.values()) for o in orders]), "response_id")

    none = F.lit(None).cast("string")
    return map_batches(grouped, run, "response_id long, body binary").select(
        "response_id", F.concat(F.lit("/rich/"), F.col("response_id").cast("string")).alias("request_path"), none.alias("content_type"), none.alias("content_disposition"), "body"
    )


def rich_xlsx_bytes(rows: list[tuple]) -> bytes:
    """rows: key, status, priority, day, price. Priorities are rich inline strings, days have a date's style, statuses are shared strings with a
    spoken form, keys a formula's text; the last cells have no reference, every other row has no number."""
    statuses = sorted({r[1] for r in rows})
    lines = []
    for k, (key, status, priority, day, price) in enumerate(rows):
        number = 2 * k + 1
        cells = f'<c r="A{number}" t="inlineStr"><is><r><t>{escape(priority[:2])}</t></r><r><rPr><b/></rPr><t>{escape(priority[2:])}</t></r></is></c>'
        cells += f'<c r="C{number}" s="1"><v>{day}</v></c><c r="D{number}" t="s"><v>{statuses.index(status)}</v></c>'
        cells += f'<c r="E{number}" t="b"><v>{int(status == "O")}</v></c><c t="str"><f>CONCAT(1,"&lt;")</f><v>{key}!</v></c>'
        cells += f'<c t="{"e" if key % 2 == 0 else "str"}"><v>{"#N/A" if key % 2 == 0 else ""}</v></c><c><v>{price}</v></c>'
        # A row without a number follows the one before; here that is a blank one.
        lines.append(f'<row r="{number}">{cells}</row><row/>')
    shared = "".join(f"<si><r><t>{escape(s)}</t></r><r><t xml:space='preserve'> &amp; status</t></r><rPh sb='0' eb='1'><t>spoken</t></rPh></si>" for s in statuses)
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Rich" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="/xl/worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": '<styleSheet><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst>{shared}</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{''.join(lines)}</sheetData></worksheet>",
    }
    return container_bytes(parts)


def many_sheet_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real XLSX body for 25 customers each: a sheet for every one with orders, of key, date and status. Some sheets have no name, some no relation, some
    no part, some two relations of which the last holds; in books with an odd id the date's format is declared anew as one of numbers."""
    day = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1899-12-30")))
    listed = F.array_sort(F.collect_list(F.struct("o_custkey", "o_orderkey", "o_orderstatus", day.alias("day"))))
    grouped = table(spark, sf_dir, "orders").groupBy(F.expr("o_custkey div 25").alias("response_id")).agg(listed.alias("orders"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_batches(batches, lambda i, orders: many_sheet_bytes([tuple(o.values()) for o in orders], odd=i % 2 == 1), "response_id")

    none = F.lit(None).cast("string")
    return map_batches(grouped, run, "response_id long, body binary").select(
        "response_id", F.concat(F.lit("/sheets/"), F.col("response_id").cast("string")).alias("request_path"), none.alias("content_type"), none.alias("content_disposition"), "body"
    )


def many_sheet_bytes(rows: list[tuple], odd: bool) -> bytes:
    """rows: customer, key, status, day."""
    statuses, by_customer = sorted({r[2] for r in rows}), {}
    for customer, key, status, day in rows:
        by_customer.setdefault(customer, []).append(f'<c><v>{key}</v></c><c s="1"><v>{day}</v></c><c t="s"><v>{statuses.index(status)}</v></c>')
    sheets, relations, parts = "", "", {}
    for c, cells in by_customer.items():
        sheets += f'<sheet {"" if c % 7 == 3 else f"name={chr(34)}C{c}{chr(34)}"} sheetId="{c}" r:id="rId{c}"/>'
        target = f'<Relationship Id="rId{c}" Target="worksheets/{{}}.xml"/>'
        relations += (target.format("wrong") if c % 5 == 4 else "") + (target.format(f"c{c}") if c % 5 != 2 else "")
        if c % 11 != 7:
            parts[f"xl/worksheets/c{c}.xml"] = f"<worksheet><sheetData>{''.join(f'<row>{x}</row>' for x in cells)}</sheetData></worksheet>"
    date = '<numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/>' + ('<numFmt numFmtId="164" formatCode="0&quot;d&quot;"/>' if odd else "")
    parts |= {
        "xl/workbook.xml": f'<workbook xmlns:r="r"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f"<Relationships>{relations}</Relationships>",
        "xl/styles.xml": f'<styleSheet><numFmts>{date}</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in statuses) + "</sst>",
    }
    return container_bytes(parts)


def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of documents by doc_id modulo 8: gzip, zlib, a raw stream, two gzip members, text that only its header calls compressed,
    a gzip file whose end is cut off, text as it is, and none. All but the second, third and fifth have a PDF marker in front."""
    kind = F.col("doc_id") % 8
    plain = F.coalesce(F.col("text"), F.lit(""))
    marked = F.concat(F.lit("%PDF-1.7"), F.repeat(F.lit(" "), F.lit(64)), plain)
    content = F.when(kind == 7, None).when(kind.isin(1, 2, 4), plain).otherwise(marked)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("response_id"), kind.cast("int").alias("kind"), F.encode(content, "UTF-8").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_batches(batches, lambda _, kind, content: compressed_bytes(kind, content), "response_id", "kind")

    kinds = ["text/plain", "application/octet-stream; deflate", "x-gzip", None, "text/csv; gzip", "application/octet-stream", None, None]
    ending = _cycle(F.col("kind"), ["", ".csv", ".tsv", "", "", "", "", ""])
    return map_batches(rows, run, "response_id long, kind int, body binary").select(
        "response_id",
        F.concat(F.lit("/packed/"), F.col("response_id").cast("string"), ending).alias("request_path"),
        _cycle(F.col("kind"), kinds).alias("content_type"),
        F.lit(None).cast("string").alias("content_disposition"),
        "body",
    )


def many_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gzip bodies of 20 documents each, a member for every 24 characters; every other one has bytes after the last member that are none."""
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 20").alias("response_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))
    grouped = grouped.select("response_id", F.array_join(F.transform("docs", lambda d: d["text"]), "").alias("text"))

    def body(key: int, text: str) -> bytes:
        pieces = [gzip.compress(text[k : k + 24].encode(), 1, mtime=0) for k in range(0, len(text), 24)]
        return b"".join(pieces) + (b"no member, though it is long enough" if key % 2 else b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_batches(batches, body, "response_id")

    none = F.lit(None).cast("string")
    return map_batches(grouped, run, "response_id long, body binary").select(
        "response_id", F.concat(F.lit("/members/"), F.col("response_id").cast("string"), F.lit(".csv")).alias("request_path"), none.alias("content_type"), none.alias("content_disposition"), "body"
    )


def compressed_bytes(kind: int, content: bytes | None) -> bytes | None:
    if content is None:
        return None
    if kind == 1:
        return zlib.compress(content)
    if kind == 2:
        raw = zlib.compressobj(wbits=-15)
        return raw.compress(content) + raw.flush()
    if kind == 3:
        half = len(content) // 2
        return gzip.compress(content[:half], mtime=0) + gzip.compress(content[half:], mtime=0)
    if kind in (0, 5):
        return gzip.compress(content, mtime=0)[: -9 if kind == 5 else None]
    return content


def xls_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real XLS body for each customer with orders, with one row for each: key, status, price, date, priority, and whether it is open.

    Of eleven customers' books one is locked and one has an early version's stream and number.
    """
    day = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1899-12-30")))
    price = F.col("o_totalprice").cast("decimal(12,2)")
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", (price * 100).cast("long").alias("cents"), day.alias("day"), "o_orderpriority")))
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("response_id")).agg(listed.alias("orders"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_batches(batches, lambda i, orders: xls_bytes([tuple(o.values()) for o in orders], locked=i % 11 == 3, early=i % 11 == 4), "response_id")

    key = F.col("response_id")
    return map_batches(grouped, run, "response_id long, body binary").select(
        "response_id",
        F.concat(F.lit("/export/"), key.cast("string"), F.when(key % 2 == 0, ".xls").otherwise("")).alias("request_path"),
        F.when(key % 3 == 0, "application/vnd.ms-excel").alias("content_type"),
        F.lit(None).cast("string").alias("content_disposition"),
        "body",
    )


def _record(kind: int, data: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(data)) + data


def compound_file(stream: bytes, name: str) -> bytes:
    """A compound file with one stream in sectors of 512 bytes."""
    stream = stream.ljust(4096, b"\0")
    sectors = -(-len(stream) // 512)
    tables = 1
    while tables * 128 < tables + 1 + sectors:
        tables += 1
    # Sectors: the allocation tables, the directory, the stream.
    chain = [0xFFFFFFFD] * tables + [0xFFFFFFFE, *range(tables + 2, tables + 1 + sectors), 0xFFFFFFFE]
    chain += [0xFFFFFFFF] * (tables * 128 - len(chain))

    def entry(label: str, kind: int, start: int, size: int) -> bytes:
        return label.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(label) + 2, kind) + bytes(49) + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, tables + 1, len(stream))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<8I", tables, tables, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    listed = [*range(tables)] + [0xFFFFFFFF] * (109 - tables)
    return head + struct.pack("<109I", *listed) + struct.pack(f"<{len(chain)}I", *chain) + directory.ljust(512, b"\0") + stream.ljust(sectors * 512, b"\0")


def xls_bytes(rows: list[tuple], locked: bool = False, early: bool = False) -> bytes:
    """rows: key, status, cents, day, priority. Strings are shared and cut over a continuation within a word, prices are hundredths in 32 bits
    where they fit, two whole numbers share a record, priorities are a formula's text, open orders a formula's boolean."""
    statuses = sorted({r[1] for r in rows}) + ["long-running status"]
    text = lambda s: struct.pack("<HB", len(s), 0) + s.encode("latin-1")
    shared = struct.pack("<ii", len(rows), len(statuses)) + b"".join(text(s) for s in statuses)
    bof = _record(0x809, struct.pack("<HH", 0x500 if early else 0x600, 5) + bytes(12))
    strings = _record(0xFC, shared[:-7]) + _record(0x3C, b"\x01" + shared[-7:].decode("latin-1").encode("utf-16-le"))
    formats = _record(0x41E, struct.pack("<H", 164) + text("yyyy\\-mm\\-dd")) + _record(0xE0, struct.pack("<HH", 0, 0)) + _record(0xE0, struct.pack("<HH", 0, 164))
    cells = []
    for k, (key, status, cents, day, priority) in enumerate(rows):
        at = lambda column, style=0: struct.pack("<HHH", k, column, style)  # noqa: E731, B023
        cells.append(_record(0x203, at(0) + struct.pack("<d", key)))
        cells.append(_record(0xFD, at(1) + struct.pack("<I", statuses.index(status))))
        if cents < 1 << 29:
            cells.append(_record(0x27E, at(2) + struct.pack("<I", cents << 2 | 3)))
        else:
            cells.append(_record(0x203, at(2) + struct.pack("<d", cents / 100)))
        cells.append(_record(0xBD, struct.pack("<HH", k, 3) + struct.pack("<HIHI", 1, day << 2 | 2, 0, (k & 0xFFF) << 2 | 2) + struct.pack("<H", 4)))
        cells.append(_record(0x06, at(5) + bytes(6) + b"\xff\xff" + bytes(6)) + _record(0x207, text(priority)))
        cells.append(_record(0x06, at(6) + bytes([1, 0, int(status == "O"), 0, 0, 0]) + b"\xff\xff" + bytes(6)))
        cells.append(_record(0x205, at(7) + bytes([(0, 7, 42)[key % 3], 1])))
    front = bof + (_record(0x2F, bytes(6)) if locked else b"") + formats + strings
    name = b"Orders"
    begin = len(front) + 4 + 8 + len(name) + 4
    sheet = _record(0x85, struct.pack("<iHBB", begin, 0, len(name), 0) + name) + _record(0x0A) + bof + b"".join(cells) + _record(0x0A)
    return compound_file(front + sheet, "Book" if early else "Workbook")
