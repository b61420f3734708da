"""Scalar functions, Column to Column: numbers, dates, cell text, names and sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from respgrid.limits import DEFAULT

#: Java's trim() takes these off both ends.
EDGES = "".join(map(chr, range(0x21)))
# Built-in number format ids that show dates or times, as closed ranges.
DATE_FORMATS = [(14, 22), (27, 36), (45, 47), (50, 58)]
# Spreadsheet error codes and their text.
ERROR_TEXT = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
OTHER_ERROR = "#ERR!"
# Captions and default file extensions by type.
CAPTIONS = {"PDF": "PDF", "XLSX": "Excel", "XLS": "Excel", "CSV": "CSV", "TSV": "TSV", "UNKNOWN": "File"}
EXTENSIONS = {"PDF": ".pdf", "XLSX": ".xlsx", "XLS": ".xls", "TSV": ".tsv", "CSV": ".csv"}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, however often then names it."""
    return F.transform(F.array(value), then)[0]


def trim_edges(text: Column) -> Column:
    """text without characters up to U+0020 at its ends."""
    return F.trim(text, F.lit(EDGES))


def number_text(x: Column) -> Column:
    """A double as a spreadsheet shows it: whole numbers without a point, else 15 significant digits, never an exponent."""
    zero = F.lit("0")

    def digits_of(plain: Column) -> Column:
        return F.struct(F.concat(F.substring(plain, 1, 1), F.substring(plain, 3, 14)).alias("d"), F.substring_index(plain, "e", -1).cast("int").alias("p"))

    def placed(x: Column) -> Column:
        return (
            F.when(x["p"] >= 14, F.concat(x["d"], F.repeat(zero, x["p"] - 14)))
            .when(x["p"] >= 0, F.concat(F.substr(x["d"], F.lit(1), x["p"] + 1), F.lit("."), F.substr(x["d"], x["p"] + 2)))
            .otherwise(F.concat(F.lit("0."), F.repeat(zero, -x["p"] - 1), x["d"]))
        )

    def short(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)

    long_form = let(let(let(F.format_string("%.14e", F.abs(x)), digits_of), placed), short)
    whole = (x == F.rint(x)) & (F.abs(x) < 1e15)
    # Most numbers print with fewer digits than are shown; such a print is what rounding to 15 digits gives.
    printed = F.abs(x).cast("string")
    brief = (F.length(printed) <= 16) & ~F.contains(printed, F.lit("E")) & ~F.endswith(printed, F.lit("0"))
    return (
        F.when(x.isNull(), None)
        .when(F.isnan(x), "NaN")
        .when(F.abs(x) == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity"))
        .when(whole, F.when(whole, x).cast("long").cast("string"))
        .otherwise(F.concat(F.when(x < 0, "-").otherwise(""), F.when(brief, printed).otherwise(long_form)))
    )


def date_serial_text(serial: Column, date1904: Column) -> Column:
    """A date serial as yyyy-MM-dd, with HH:mm:ss unless it falls on midnight; as a number if no date can hold it.

    The 1900 system has a 29 February 1900 that never was, so that its serials from 60 on are a day ahead.
    Spark holds dates of about 290,000 years either way; serials beyond that read as numbers.
    """
    epoch = F.when(date1904, F.expr("TIMESTAMP_NTZ '1904-01-01 00:00:00'")).otherwise(F.expr("TIMESTAMP_NTZ '1899-12-31 00:00:00'"))

    def shown(x: Column) -> Column:
        moment = F.timestamp_add("MILLISECOND", x["ms"], F.timestamp_add("DAY", x["day"], epoch))
        return F.when(x["ms"] == 0, F.date_format(moment, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))

    def split(days: Column) -> Column:
        return F.struct(F.floor(days).cast("int").alias("day"), F.floor((days - F.floor(days)) * 86_400_000.0 + 0.5).cast("int").alias("ms"))

    days = F.when(~date1904 & (serial >= 60), serial - 1).otherwise(serial)
    holds = F.isnan(serial) | (F.abs(serial) < 1e8)
    return F.when(holds, let(let(F.when(holds & ~F.isnan(serial), days).otherwise(F.lit(0.0)), split), shown)).otherwise(number_text(serial))


def is_builtin_date_format(format_id: Column) -> Column:
    out = F.lit(False)
    for low, high in DATE_FORMATS:
        out = out | format_id.between(low, high)
    return F.coalesce(out, F.lit(False))


def is_date_format(code: Column) -> Column:
    """Whether a custom format code has a date or time letter outside literals, brackets and escapes."""
    bare = F.regexp_replace(code, r'(?s)"[^"]*(?:"|\z)|\[[^\]]*(?:\]|\z)|\\.?', "")
    return F.coalesce(bare.rlike("[ydhsmYDHSM]"), F.lit(False))


def clamp_cell(text: Column, chars: int = DEFAULT.cell_chars) -> Column:
    return F.when(text.isNull(), "").when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def as_number(text: Column) -> Column:
    """The number that a cell's text is, thousands commas ignored; null if it isn't one."""
    return named_exactly(F.replace(trim_edges(text), F.lit(","), F.lit("")))


def named_exactly(bare: Column) -> Column:
    """bare as a double; infinities and NaN only by their exact names or by digits. No patterns are tried on what reads as a finite number."""
    value = bare.try_cast("double")
    named = bare.rlike(r"(?i)^[\x00-\x20]*[+-]?(?:inf|nan)")
    exact = bare.rlike(r"^[\x00-\x20]*[+-]?(?:Infinity|NaN)[\x00-\x20]*\z")
    return F.when(F.abs(value) < float("inf"), value).when(value.isNotNull() & (~named | exact), value)


def column_index(reference: Column) -> Column:
    """The zero-based column of a reference such as BC12; -1 without letters. Sums wrap at 32 bits."""
    total = lambda letters: F.aggregate(
        F.filter(F.split(letters, ""), lambda c: c != ""),
        F.lit(0).cast("long"),
        lambda a, c: (a * 26 + F.ascii(c) - 64).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    letters = F.upper(F.regexp_extract(reference, "^[A-Za-z]*", 0))
    every = (let(total(letters), lambda n: F.when(n >= 2**31, n - 2**32).otherwise(n)) - 1).cast("int")
    # Most references have one or two capital letters, which need no folding.
    one, two = F.ascii(reference) - 65, (F.ascii(reference) - 64) * 26 + F.ascii(F.substring(reference, 2, 1)) - 65
    return F.when(reference.isNotNull(), F.when(reference.rlike("^[A-Z][0-9]"), one).when(reference.rlike("^[A-Z]{2}[0-9]"), two).otherwise(every))


def column_letters(index: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, up to three letters (18,278 columns)."""
    letter = lambda x: F.char(x + 65)
    low = letter(index % 26)
    middle = letter((F.floor(index / 26) - 1) % 26)
    return (
        F.when(index < 26, low)
        .when(index < 702, F.concat(middle, low))
        .otherwise(F.concat(letter(F.floor((index - 702) / 676)), middle, low))
    )


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
    )


def describe_size(expanded_length: Column, decompressed: Column, original_length: Column) -> Column:
    size = human_bytes(expanded_length)
    return F.when(decompressed, F.concat(size, F.lit(" expanded from "), human_bytes(original_length))).otherwise(size)


def caption(file_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CAPTIONS.items() for x in kv]), file_type), F.lit("File"))


def is_tabular(file_type: Column) -> Column:
    return file_type.isin("XLSX", "XLS", "CSV", "TSV")


def suggested_name(file_name: Column, file_type: Column) -> Column:
    extension = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), file_type), F.lit(".bin"))
    return F.coalesce(F.nullif(file_name, F.lit("")), F.concat(F.lit("response"), extension))


def csv_quote(text: Column) -> Column:
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def boolerr_text(value: Column, is_error: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ERROR_TEXT.items() for x in kv])
    error = F.coalesce(F.try_element_at(known, value), F.lit(OTHER_ERROR))
    return F.when(is_error, error).otherwise(F.when(value != 0, "TRUE").otherwise("FALSE"))


def header_param(header: Column, key: str) -> Column:
    """A parameter of a header, found by its name with the equals sign; null if absent or empty without quotes."""
    at = F.locate(key, F.lower(header))

    def value(rest: Column) -> Column:
        plain = F.nullif(trim_edges(F.substring_index(rest, ";", 1)), F.lit(""))
        return F.when(F.startswith(rest, F.lit('"')), F.regexp_extract(rest, '(?s)^"([^"]*)', 1)).otherwise(plain)

    return F.when(at > 0, let(trim_edges(F.substr(header, at + len(key))), value))


def percent_decode(text: Column) -> Column:
    """Form-style decoding; text that isn't well encoded stays as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def file_name(content_disposition: Column, request_path: Column) -> Column:
    """The name that a response gives its file: of the header, else of the path."""
    extended = percent_decode(F.substring_index(header_param(content_disposition, "filename*="), "'", -1))
    segment = F.substring_index(F.substring_index(request_path, "?", 1), "/", -1)
    return F.coalesce(extended, header_param(content_disposition, "filename="), F.nullif(segment, F.lit("")))


def sheet_name(name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("Data"))
