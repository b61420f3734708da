import gzip
import random
import struct
import time
import zipfile
import zlib
from io import BytesIO

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from respgrid.jobs.fixtures import xlsx_bytes
from respgrid.limits import Limits
from respgrid.operators import delimited, detect, grid, inflate
from respgrid.sources import xls, xlsx
from respgrid.sources.responses import RESPONSE


def responses(spark, bodies, content_type=None, name="f.csv"):
    return spark.createDataFrame([(i, f"/{name}", content_type, None, bytearray(b) if b is not None else None) for i, b in enumerate(bodies)], RESPONSE)


def test_expanding():
    whole = gzip.compress(b"a,b\n") + gzip.compress(b"c,d\n")
    assert inflate.expand_bytes(gzip.compress(b"abc"), 100) == b"abc"
    assert inflate.expand_bytes(whole, 100) == b"a,b\nc,d\n"
    assert inflate.expand_bytes(gzip.compress(b"abc") + b"rest of it, not a member", 100) == b"abc"
    assert inflate.expand_bytes(gzip.compress(b"abc")[:-9], 100) is None
    assert inflate.expand_bytes(gzip.compress(b"a" * 1000), 10) == b"a" * 10
    assert inflate.expand_bytes(zlib.compress(b"abc"), 100) == b"abc"
    raw = zlib.compressobj(wbits=-15)
    assert inflate.expand_bytes(raw.compress(b"abc") + raw.flush(), 100) == b"abc"
    assert inflate.expand_bytes(b"no stream", 100) is None
    assert inflate.expand_bytes(gzip.compress(b""), 100) is None


def test_text_that_begins_like_a_raw_stream_is_text():
    text = "Sudorajaez y, osll. As lo ezas, mentees cióngaasque queóta.".encode()
    assert zlib.decompressobj(-15).decompress(text)  # an end of a stream is found in it
    assert inflate.expand_bytes(text, 1000) is None
    raw = zlib.compressobj(wbits=-15)
    assert inflate.expand_bytes(raw.compress(b"abc") + raw.flush() + b"more", 1000) is None


def test_header_of_text_that_begins_like_a_raw_stream(spark):
    text = "Sudorajaez y, osll. As lo ezas, mentees cióngaasque queóta.".encode()
    rows = spark.createDataFrame([(1, "/packed/1", "text/csv; gzip", None, bytearray(text))], RESPONSE)
    header = detect.file_header(detect.detect(rows)).first()
    assert (header["type_badge"], header["gzip"], header["meta"]) == ("CSV", False, f"{len(text)} B")


def test_expanding_damaged_members():
    good, bad = gzip.compress(b"first"), bytearray(gzip.compress(b"second" * 50))
    bad[15] ^= 0xFF
    assert inflate.expand_bytes(good + bytes(bad), 1000) is None
    assert inflate.expand_bytes(good + bytes(bad), 5) == b"first"  # the limit comes first
    assert inflate.expand_bytes(good + gzip.compress(b"second")[:-3], 1000) is None
    assert inflate.expand_bytes(good + b"\x1f\x8b\x07" + b"x" * 40, 1000) == b"first"
    assert inflate.expand_bytes(good + b"\x1f\x8b\x08short", 1000) == b"first"
    assert inflate.expand_bytes(b"\x1f\x8b\x07" + b"x" * 40, 1000) is None
    assert inflate.expand_bytes(good[:12], 1000) is None and inflate.expand_bytes(b"\x1f\x8b\x08", 1000) is None
    for n in (1, 255, 256, 257, 70_000, 300_000):
        data = bytes(random.Random(n).randbytes(n))
        assert inflate.expand_bytes(gzip.compress(data) + gzip.compress(data[:9]), 10**6) == data + data[:9]
        assert inflate.expand_bytes(gzip.compress(data), n) == data and inflate.expand_bytes(zlib.compress(data), max(1, n // 2)) == data[: max(1, n // 2)]


def test_members_take_linear_time():
    def seconds(n):
        body = gzip.compress(b"a,b\n", mtime=0) * n
        began = time.process_time()
        assert len(inflate.expand_bytes(body, 1 << 30)) == 4 * n
        return time.process_time() - began

    seconds(1000)
    assert seconds(200_000) < 25 * max(seconds(20_000), 0.02)


def test_detection_of_compressed_and_odd_bodies(spark):
    bodies = [gzip.compress(b"%PDF-1.4"), None, b"", b"%PDF" + b"x" * 100, b"plain"]
    found = {r["response_id"]: r for r in detect.detect(responses(spark, bodies, name="f"), Limits(body_bytes=100)).collect()}
    assert found[0]["file_type"] == "PDF" and found[0]["decompressed"] and bytes(found[0]["expanded"]) == b"%PDF-1.4"
    assert [found[i]["file_type"] for i in range(1, 5)] == ["UNKNOWN"] * 4
    assert found[3]["original_length"] == 0 and found[4]["file_name"] is None


def machine(text, d):
    """The rows of a delimited text, character by character."""
    rows, row, field, quoted, was, i = [], [], "", False, False, 0
    ends = lambda x, q: x if q else x.strip("".join(map(chr, range(33))))
    while i < len(text):
        c = text[i]
        i += 1
        if quoted:
            if c == '"' and text[i : i + 1] == '"':
                field, i = field + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                field += c
        elif c == '"' and not field:
            quoted = was = True
        elif c in (d, "\n", "\r"):
            row.append(ends(field, was))
            field, was = "", False
            if c != d:
                i += c == "\r" and text[i : i + 1] == "\n"
                rows.append(row)
                row = []
        else:
            field += c
    rows.append([*row, ends(field, was)])
    return [r for r in rows if any(r)]


def parse(spark, bodies, limits=Limits(), content_type="text/csv"):
    found = delimited.parse_delimited(detect.detect(responses(spark, bodies, content_type)), limits)
    rows = delimited.sheet_rows(found, limits).orderBy("response_id", "row_idx").collect()
    return {r["response_id"]: r.asDict() | {"cells": [x["cells"] for x in rows if x["response_id"] == r["response_id"]]} for r in found.collect()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='ab,"\r\n ', min_size=1, max_size=30), min_size=60, max_size=60))
def test_tokeniser_against_a_state_machine(spark, texts):
    found = parse(spark, ["x;y\n1;2\n".encode() if not t else t.encode() for t in texts])
    for i, text in enumerate(texts):
        if delimited_by_comma := (len(text) > 0):
            want = machine(text, ",")
            got = found[i]["cells"]
            assert delimited_by_comma and got == want, (text, got, want)


def test_encodings_and_caps(spark):
    bodies = [b"\xef\xbb\xbfa,b\n", "é,ü\n".encode("latin-1"), "a,é\n".encode("utf-16"), b"a,b\n\n \nc,d", b"1\n2\n3\n", b"1\n2\n3", b"a,b,c\n"]
    found = parse(spark, bodies, Limits(rows=3, columns=2))
    assert [found[i]["cells"] for i in range(4)] == [[["a", "b"]], [["é", "ü"]], [["a", "é"]], [["a", "b"], ["c", "d"]]]
    assert [found[i]["truncated"] for i in (3, 4, 5, 6)] == [False, True, False, True]
    assert found[6]["n_cols"] == 2 and found[6]["cells"] == [["a", "b", "c"]]


def test_csv_round_trip(spark):
    cells = [["h1", "h,2"], ['a"b', "c\nd"], ["", "x"]]
    rows = spark.createDataFrame([(1, 0, i, c) for i, c in enumerate(cells)], "response_id long, sheet_idx int, row_idx int, cells array<string>")
    sheets = spark.createDataFrame([(1, 0, "s", 3, 2, False)], "response_id long, sheet_idx int, name string, n_rows int, n_cols int, truncated boolean")
    lines = [r["line"] for r in grid.csv_lines(grid.promote_header(rows, sheets), sheets).orderBy("line_no").collect()]
    assert parse(spark, [("\n".join(lines) + "\n").encode()])[0]["cells"] == cells


def test_grid_filter_and_sort(spark):
    texts = ["10", "9", "", "b", "A", "1,000", "-0", "0", "É", "a\\Eb"]
    rows = spark.createDataFrame([(1, 0, i, [t]) for i, t in enumerate(texts)], "response_id long, sheet_idx int, row_idx int, cells array<string>")
    order = lambda up: [r["cells"][0] for r in grid.sort_rows(rows, 0, up).orderBy("rank").collect()]
    assert order(True) == ["-0", "0", "9", "10", "1,000", "", "A", "a\\Eb", "b", "É"]
    assert order(False) == ["É", "b", "a\\Eb", "A", "", "1,000", "10", "9", "0", "-0"]
    kept = lambda text: [r["cells"][0] for r in grid.filter_contains(rows, text).orderBy("row_idx").collect()]
    assert kept("a") == ["A", "a\\Eb"] and kept("é") == [] and kept("\\E") == ["a\\Eb"] and len(kept("")) == 10


SHEET = """<worksheet><sheetData>
<row r="2"><c r="A2" t="s"><v>0</v></c><c t="b"><v>1</v></c><c r="D2" s="1"><v>43831.5</v></c><c r="E2"><f>1+1</f><v>2</v></c><c r="F2"/></row>
<row><c t="inlineStr"><is><r><t>in</t></r><rPh><t>no</t></rPh><r><t>line</t></r></is></c><c t="s"><v>9</v></c><c t="e"><v>#N/A</v></c></row>
<row r="5"><c r="B5"><v>abc</v></c><c r="B5"><v>1.50</v></c></row><row r="9"><c r="A9" t="str"><v></v></c></row></sheetData></worksheet>"""


def book(sheet, **parts):
    base = {
        "xl/workbook.xml": '<workbook><sheets><sheet name="S" r:id="a" xmlns:r="x"/><sheet name="Lost" r:id="b" xmlns:r="x"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="a" Target="/xl/worksheets/s.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>shared</t><rPh><t>x</t></rPh></si></sst>",
        "xl/styles.xml": '<s><numFmts><numFmt numFmtId="164" formatCode="yyyy"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></s>',
        "xl/worksheets/s.xml": sheet,
    } | parts
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in base.items():
            z.writestr(name, xml)
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    bodies = [book(SHEET), book("<worksheet><bad"), xlsx_bytes([(7, "O", "1.10")])]
    tables = xlsx.xlsx_tables(detect.detect(responses(spark, bodies, name="f")), f"file://{tmp_path}/staged")
    cells = {(r["response_id"], r["row_idx"], r["col_idx"]): r["text"] for r in tables["cells"].collect()}
    assert {k[1:]: v for k, v in cells.items() if k[0] == 0 and v} == {
        (1, 0): "shared", (1, 1): "TRUE", (1, 3): "2020-01-01 12:00:00", (1, 4): "2", (2, 0): "inline", (2, 2): "#N/A", (4, 1): "1.5",
    }
    assert {k[1:]: v for k, v in cells.items() if k[0] == 2} == {(0, 0): "7", (0, 1): "O", (0, 2): "1.1"}
    assert [r["response_id"] for r in tables["errors"].collect()] == [1]
    assert ('Sheet "Lost" could not be located inside the container') in [r["message"] for r in tables["warnings"].collect()]
    shape = {r["response_id"]: (r["n_rows"], r["n_cols"], r["truncated"]) for r in tables["sheets"].collect()}
    assert shape == {0: (5, 5, False), 2: (1, 3, False)}


def test_xlsx_cut_at_a_wide_cell(spark, tmp_path):
    sheet = '<w><row><c r="A1"><v>1</v></c></row><row><c r="A2"><v>2</v></c><c r="D2"><v>3</v></c></row><row><c r="A3"><v>4</v></c></row></w>'
    tables = xlsx.xlsx_tables(detect.detect(responses(spark, [book(sheet)], name="f")), f"file://{tmp_path}/staged", Limits(columns=3))
    assert [r["text"] for r in tables["cells"].collect()] == ["1"]
    assert tables["sheets"].first()["truncated"]


def record(kind, data=b""):
    return struct.pack("<HH", kind, len(data)) + data


def container(stream, name="Workbook"):
    """A compound file with one stream in whole sectors."""
    stream = stream.ljust(4096, b"\0")
    sectors = -(-len(stream) // 512)
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *[2 + i + 1 for i in range(sectors - 1)], 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    entry = lambda n, kind, start, size: n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(n) + 2, kind) + b"\0" * 49 + struct.pack("<III", start, size, 0)
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, 2, len(stream))).ljust(512, b"\0")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<III", 1, 1, 0) + struct.pack("<IIIII", 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<I", 0) + b"\xff" * (108 * 4)
    return head + struct.pack("<128I", *fat) + directory + stream.ljust(sectors * 512, b"\0")


def xls_body(cells, sst=b"", extra=b""):
    bof = record(0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12)
    globals_ = bof + record(0xE0, struct.pack("<HH", 0, 0)) + record(0xE0, struct.pack("<HH", 0, 14)) + extra + sst
    at = len(globals_) + len(record(0x85, b"\0" * 8 + b"S")) + 4
    sheet = bof + b"".join(cells) + record(0x0A)
    return container(globals_ + record(0x85, struct.pack("<iHBB", at, 0, 1, 0) + b"S") + record(0x0A) + sheet)


def test_xls(spark, tmp_path):
    at = lambda r, c, x=0: struct.pack("<HHH", r, c, x)
    text = lambda s: struct.pack("<HB", len(s), 0) + s.encode("latin-1")
    shared = struct.pack("<ii", 2, 2) + text("one") + struct.pack("<HB", 4, 0) + b"ab"
    sst = record(0xFC, shared) + record(0x3C, b"\x01" + "cé".encode("utf-16-le"))
    cells = [
        record(0xFD, at(0, 0) + struct.pack("<I", 1)),
        record(0x203, at(0, 1, 1) + struct.pack("<d", 43831.0)),
        record(0x27E, at(0, 2) + struct.pack("<I", (123 << 2) | 3)),
        record(0xBD, struct.pack("<HH", 1, 0) + struct.pack("<HIHI", 0, (5 << 2) | 2, 0, (((-6) & 0x3FFFFFFF) << 2) | 2) + struct.pack("<H", 1)),
        record(0x205, at(2, 0) + bytes([0x2A, 1])),
        record(0x205, at(2, 1) + bytes([1, 0])),
        record(0x06, at(3, 0) + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 6),
        record(0x207, text("cached")),
        record(0x06, at(3, 1) + struct.pack("<d", 2.5) + b"\0" * 6),
        record(0x204, at(4, 9) + text("label")),
    ]
    bodies = [xls_body(cells, sst), xls_body([], extra=record(0x2F)), container(b"", "Other"), xls_body(cells, sst)[:700]]
    tables = xls.xls_tables(detect.detect(responses(spark, bodies, "application/vnd.ms-excel", "f.xls")), f"file://{tmp_path}/staged")
    found = {(r["row_idx"], r["col_idx"]): r["text"] for r in tables["cells"].where("response_id = 0").collect()}
    assert found == {
        (0, 0): "abcé", (0, 1): "2020-01-01", (0, 2): "1.23", (1, 0): "5", (1, 1): "-6", (2, 0): "#N/A", (2, 1): "TRUE", (3, 0): "cached", (3, 1): "2.5", (4, 9): "label",
    }
    errors = {r["response_id"]: r["message"] for r in tables["errors"].collect()}
    assert errors[1] == "Workbook is password protected" and set(errors) == {1, 2, 3}
    assert [tuple(r) for r in tables["sheets"].where("response_id = 0").select("name", "n_rows", "n_cols").collect()] == [("S", 5, 10)]


def test_cyclic_container():
    body = bytearray(xls_body([]))
    body[512 + 8 : 512 + 12] = struct.pack("<I", 2)
    with pytest.raises(ValueError, match="cyclic"):
        list(xls.records(bytes(body)))


def test_statuses(spark):
    found = detect.detect(responses(spark, [b"%PDF", b"a,b\n", b"c,d\n" * 50, b"e,f\n", b"g,h\n"]))
    outcomes = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 1, "boom"), (4, 0, None)], "response_id long, sheets int, error string")
    status = {r["response_id"]: r["status"] for r in detect.open_status(found, outcomes, Limits(tabular_bytes=100)).collect()}
    assert status == {0: "pdf", 1: "ok", 2: "too_large", 3: "error", 4: "empty"}


def test_binary_files_and_saved_bodies(spark, tmp_path):
    from respgrid.sources.responses import read_responses, write_bodies

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes(b"a,b\n1,2\n")
    found = detect.detect(read_responses(spark, str(tmp_path / "in"), "binaryFile"))
    write_bodies(found, str(tmp_path / "out"))
    saved = spark.read.parquet(str(tmp_path / "out")).first()
    assert (saved["suggested_name"], saved["file_type"], bytes(saved["expanded"])) == ("a.csv", "CSV", b"a,b\n1,2\n")
    assert F is not None
