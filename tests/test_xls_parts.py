"""Legacy workbooks read in columns: sheets that fail late are withdrawn, packed numbers are decoded together, memory stays low."""

import random
import struct
import subprocess
import sys

import numpy as np

from respgrid.jobs.fixtures import compound_file
from respgrid.operators import detect
from respgrid.sources import xls
from tests.test_files import record, responses


def stream_of(sheets):
    """sheets: name -> list of records."""
    bof = record(0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12)
    front = bof + record(0xE0, struct.pack("<HH", 0, 0)) + record(0xE0, struct.pack("<HH", 0, 14))
    at = len(front) + sum(12 + len(n) for n in sheets) + 4
    listed, bodies = b"", b""
    for name, cells in sheets.items():
        listed += record(0x85, struct.pack("<iHBB", at + len(bodies), 0, len(name), 0) + name.encode())
        bodies += bof + b"".join(cells) + record(0x0A)
    return front + listed + record(0x0A) + bodies


def book(sheets):
    return compound_file(stream_of(sheets), "Workbook")


def in_large_sectors(made):
    """A stream in a compound file of 4096-byte sectors, whose head can name enough of them."""
    stream = made()
    sectors = -(-len(stream) // 4096)
    tables = -(-(sectors + 2) // 1023)
    chain = [0xFFFFFFFD] * tables + [0xFFFFFFFE, *range(tables + 2, tables + 1 + sectors), 0xFFFFFFFE]
    chain += [0xFFFFFFFF] * (tables * 1024 - len(chain))
    entry = lambda label, kind, start, size: label.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(label) + 2, kind) + bytes(49) + struct.pack("<IQ", start, size)
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, tables + 1, len(stream))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<5H", 0x3E, 4, 0xFFFE, 12, 6) + bytes(10)
    head += struct.pack("<8I", tables, tables, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", *[*range(tables)] + [0xFFFFFFFF] * (109 - tables))
    return head.ljust(4096, b"\0") + struct.pack(f"<{len(chain)}I", *chain) + directory.ljust(4096, b"\0") + stream.ljust(sectors * 4096, b"\0")


def number(r, c, x, style=0):
    return record(0x203, struct.pack("<HHHd", r, c, style, x))


def packed(r, c, values):
    return record(0xBD, struct.pack("<HH", r, c) + b"".join(struct.pack("<HI", 0, (v << 2) & 0xFFFFFFFF | 2) for v in values) + struct.pack("<H", c + len(values) - 1))


def test_packed_numbers_together():
    r = random.Random(3)
    values = np.array([r.randrange(2**32) for _ in range(3000)] + [0, 1, 2, 3, 2**31, 2**32 - 1], np.uint32)
    one_by_one = [xls.decode_rk(v) for v in values.tolist()]
    assert xls.decode_rks(values).tobytes() == np.array(one_by_one).tobytes()


def test_a_sheet_that_fails_late_is_withdrawn(spark, tmp_path):
    many = [number(i % 60_000, i // 60_000, i) for i in range(40_000)]
    cut_off = record(0xFD, struct.pack("<HHH", 0, 0, 0))  # a shared string without its index
    body = book({"first": [number(0, 0, 1.5), packed(1, 2, range(-20, 30))], "broken": [*many, cut_off], "last": [number(2, 1, 7)]})
    tables = xls.xls_tables(detect.detect(responses(spark, [body], "application/vnd.ms-excel", "f.xls")), f"file://{tmp_path}/staged")
    found = {(x["sheet_idx"], x["row_idx"], x["col_idx"]): x["text"] for x in tables["cells"].collect()}
    assert found == {(0, 0, 0): "1.5", (1, 2, 1): "7"} | {(0, 1, 2 + k): str(k - 20) for k in range(50)}
    assert sorted(tuple(x) for x in tables["sheets"].select("sheet_idx", "name", "n_rows", "n_cols").collect()) == [(0, "first", 2, 52), (1, "last", 3, 2)]
    assert [x["message"].startswith('Sheet "broken" could not be read') for x in tables["warnings"].collect()] == [True]


def test_all_sheets_broken(spark, tmp_path):
    body = book({"a": [record(0xFD, b"\0" * 6)], "b": [record(0x205, b"\0" * 6)]})
    tables = xls.xls_tables(detect.detect(responses(spark, [body], "application/vnd.ms-excel", "f.xls")), f"file://{tmp_path}/staged")
    assert tables["cells"].count() == 0 and [tuple(x) for x in tables["sheets"].select("sheet_idx", "name", "n_rows").collect()] == [(0, "(empty)", 0)]
    assert tables["warnings"].count() == 2


def peak(code):
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600)
    return [int(x) for x in out.stdout.split()]


def test_memory_of_a_large_book():
    """A book of 30 MiB with over five million cells."""
    code = """
import resource, struct
from respgrid.sources import xls
from tests.test_xls_parts import in_large_sectors, packed, stream_of
row = packed(0, 0, range(250))
body = in_large_sectors(lambda: stream_of({"s": [row[:4] + struct.pack("<H", r % 60_000) + row[6:] for r in range(20_900)]}))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
cells, part = 0, xls.Part()
for record in xls.records(body, part=part):
    if record is part:
        cells += part.batch().num_rows
cells += part.batch().num_rows
print(len(body), cells, before, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    size, cells, before, after = peak(code)
    assert size > 30 << 20 and cells == 20_900 * 250
    assert after < 500 * 1024, (before, after)
