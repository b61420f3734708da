import pytest
from pyspark.sql import functions as F

from respgrid.functions import detection as D
from respgrid.functions import scalars as S


def one(spark, **columns):
    """A function that evaluates a Column over one row of columns."""
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", bytes: "binary", bytearray: "binary"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in columns.items())
    df = spark.createDataFrame([tuple(columns.values())], schema)
    return lambda column: df.select(column.alias("x")).first()["x"]


def over(spark, values, kind, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_number_text(spark):
    values = [1.0, -0.0, 0.1, 1234567.891, 1e15, 1.5e300, 1e-7, 0.1 + 0.2, -2.50, float("nan"), float("inf"), None, 123456789012345.6]
    expected = ["1", "0", "0.1", "1234567.891", "1000000000000000", "15" + "0" * 299, "0.0000001", "0.3", "-2.5", "NaN", "Infinity", None, "123456789012346"]
    assert over(spark, values, "double", S.number_text) == expected


def test_date_serials(spark):
    values = [59.0, 60.0, 61.0, 1.0, 43831.0, 43831.5, 43831.9999999999, -1.0, 1e12]
    expected = ["1900-02-28", "1900-02-28", "1900-03-01", "1900-01-01", "2020-01-01", "2020-01-01 12:00:00", "2020-01-02 00:00:00", "1899-12-30", "1000000000000"]
    assert over(spark, values, "double", lambda x: S.date_serial_text(x, F.lit(False))) == expected
    assert over(spark, [0.0, 1.25], "double", lambda x: S.date_serial_text(x, F.lit(True))) == ["1904-01-01", "1904-01-02 06:00:00"]


def test_date_formats(spark):
    codes = ['[Red]0.00;"m"', "[h]", "[h]:mm", "\\d0", "yyyy", '"unclosed d', "[unclosed d", "0.00", "", None, "\\"]
    assert over(spark, codes, "string", S.is_date_format) == [False, False, True, False, True, False, False, False, False, False, False]
    assert over(spark, [13, 14, 22, 23, 27, 36, 37, 45, 47, 48, 50, 58, 59, None], "int", S.is_builtin_date_format) == [
        False, True, True, False, True, True, False, True, True, False, True, True, False, False,
    ]


def test_as_number(spark):
    values = [" 1,234.5 ", "1d", "0x1p3", "inf", "Infinity", "-NaN", "nan", "", " ", ",", "abc", None, "1e3", "12 3"]
    out = over(spark, values, "string", S.as_number)
    assert out[:5] == [1234.5, 1.0, 8.0, None, float("inf")]
    assert out[5] != out[5] and out[6:] == [None, None, None, None, None, None, 1000.0, None]


def test_columns(spark):
    values = [0, 25, 26, 701, 702, 16383]
    assert over(spark, values, "int", S.column_letters) == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert over(spark, ["BC12", "xfd1", "12", "", "A", None], "string", S.column_index) == [54, 16383, -1, -1, 0, None]
    assert over(spark, list(range(0, 18278, 137)), "int", lambda x: S.column_index(S.column_letters(x))) == list(range(0, 18278, 137))


def test_sizes_and_names(spark):
    assert over(spark, [0, 1023, 1024, 1280, 1048575, 1048576], "long", S.human_bytes) == ["0 B", "1023 B", "1.0 KB", "1.3 KB", "1024.0 KB", "1.0 MB"]
    assert over(spark, ["a,b", 'a"b', "a\nb", "a\rb", "ab", None], "string", S.csv_quote) == ['"a,b"', '"a""b"', '"a\nb"', '"a\rb"', "ab", None]
    assert over(spark, [None, "", "abcdef"], "string", lambda x: S.clamp_cell(x, 5)) == ["", "", "abcde…"]


@pytest.mark.parametrize(
    ("header", "path", "name"),
    [
        ('attachment; filename="a b.csv"', "/x", "a b.csv"),
        ("attachment; FILENAME=a.csv ; size=3", "/x", "a.csv"),
        ("attachment; filename*=UTF-8''a%20b.csv", "/x", "a b.csv"),
        ("attachment; filename*=UTF-8''bad%zz", "/x", "bad%zz"),
        ('attachment; filename=""', "/x", ""),
        ("inline; filename=", "/x/y.csv?z=/q", "y.csv"),
        (None, "/x/", None),
        (None, None, None),
        ('attachment; filename="open', "/x", "open"),
    ],
)
def test_file_name(spark, header, path, name):
    assert one(spark, h=header, p=path)(S.file_name(F.col("h"), F.col("p"))) == name


def test_delimiter_guess(spark):
    texts = ["a,b\nc,d\n", "a;b;c\nd;e;f\n", "a\tb\n1\t2\n", "a|b\n1|2\n", "a,b\nc\n", "title\na,b\nc,d\n", '<a,b>\n', "a,b", '"x,y",z\n"p",q\n', "", '﻿ a,b\nc,d\n', "a,b;c\nd,e;f\n", 'a"\n,"b,c\nd,e\n']
    expected = [",", ";", "\t", "|", None, ",", None, None, ",", None, ",", ",", ","]
    assert over(spark, texts, "string", D.guess_delimiter) == expected


def test_signatures(spark):
    pdf = [b"%PDF", b" " * 1024 + b"%PDF", b" " * 1025 + b"%PDF", b"%PD", b""]
    assert over(spark, pdf, "binary", D.has_pdf_marker) == [True, True, False, False, False]
    part = b"xl/workbook.xml"
    zips = [b"PK\x03\x04" + part, b"PK\x03\x04" + b"\0" * 20000 + part, b"PK\x03\x04" + b"\0" * 20000 + part + b"\0" * 262144, b"PK\x03\x04"]
    assert over(spark, zips, "binary", D.is_xlsx_zip) == [True, True, False, False]
    none, cfb = F.lit(None).cast("string"), bytes.fromhex("D0CF11E0A1B11AE1")
    books = [cfb + "Workbook".encode("utf-16-le"), cfb + b"\0" * 65536 + "Book".encode("utf-16-le"), cfb]
    assert over(spark, books, "binary", lambda x: D.classify(x, none, none)) == ["XLS", "UNKNOWN", "UNKNOWN"]
    texts = [b'{"a":1,"b":2}\n', b"a,b\nc,d\n", b"\0\1\2a,b\nc,d\n", b"a\tb\nc\td\n", b"plain text\n"]
    assert over(spark, texts, "binary", lambda x: D.classify(x, none, none)) == ["UNKNOWN", "CSV", "UNKNOWN", "TSV", "UNKNOWN"]
    assert over(spark, texts[1:2], "binary", lambda x: D.classify(x, F.lit("application/json"), none)) == ["UNKNOWN"]
    assert over(spark, texts[4:], "binary", lambda x: D.classify(x, none, F.lit("a.TAB"))) == ["TSV"]
