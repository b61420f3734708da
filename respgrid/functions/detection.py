"""What a body is: predicates and classification, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from respgrid.functions.scalars import let
from respgrid.limits import DEFAULT, Limits

# Signatures, and how much of a body is searched for each.
GZIP, PDF, ZIP, CFB = "1F8B", "25504446", "504B0304", "D0CF11E0A1B11AE1"
PDF_WINDOW, ZIP_HEAD, ZIP_TAIL, CFB_HEAD, TEXT_HEAD = 1024, 16 * 1024, 256 * 1024, 64 * 1024, 8192
WORKBOOK_PART = "xl/workbook.xml"
DELIMITERS = (",", ";", "\t", "|")
SAMPLE_LINES = 20
#: White space in the sense of Java's Character.isWhitespace.
LEADING = r"^[\s\x1C-\x1F\p{Z}&&[^   ]]+"
#: From a quote to the one that closes it, doubled quotes inside; or to the end.
QUOTED = r'(?s)"(?:[^"]++|"")*+(?:"|\z)'


def _bytes(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def body_ok(body: Column, limits: Limits = DEFAULT) -> Column:
    return F.coalesce(F.length(body).between(1, limits.body_bytes), F.lit(False))


def is_gzip(body: Column) -> Column:
    return F.coalesce((F.length(body) > 2) & F.startswith(body, _bytes(GZIP)), F.lit(False))


def mentions_compression(content_type: Column) -> Column:
    kind = _lower(content_type)
    return F.contains(kind, F.lit("gzip")) | F.contains(kind, F.lit("deflate"))


def has_pdf_marker(body: Column) -> Column:
    return F.contains(F.substring(body, 1, PDF_WINDOW + 4), _bytes(PDF))


def is_zip(body: Column) -> Column:
    return F.startswith(body, _bytes(ZIP))


def is_xlsx_zip(body: Column) -> Column:
    part = F.encode(F.lit(WORKBOOK_PART), "US-ASCII")
    tail = F.substr(body, F.greatest(F.length(body) - ZIP_TAIL, F.lit(0)) + 1)
    return is_zip(body) & (F.contains(F.substring(body, 1, ZIP_HEAD), part) | F.contains(tail, part))


def is_cfb(body: Column) -> Column:
    return F.startswith(body, _bytes(CFB))


def _named(name: Column, *extensions: str) -> Column:
    out = F.lit(False)
    for extension in extensions:
        out = out | F.endswith(_lower(name), F.lit(extension))
    return out


def is_legacy_excel(body: Column, content_type: Column, name: Column) -> Column:
    head = F.substring(body, 1, CFB_HEAD)
    streams = F.contains(head, F.encode(F.lit("Workbook"), "UTF-16LE")) | F.contains(head, F.encode(F.lit("Book"), "UTF-16LE"))
    return is_cfb(body) & (streams | F.contains(_lower(content_type), F.lit("excel")) | _named(name, ".xls"))


def declared_text_type(content_type: Column, name: Column) -> Column:
    """CSV or TSV as the headers say, whatever the body is; else null."""
    kind = _lower(content_type)
    return F.when(F.contains(kind, F.lit("text/csv")) | F.contains(kind, F.lit("application/csv")) | _named(name, ".csv"), "CSV").when(
        F.contains(kind, F.lit("tab-separated")) | _named(name, ".tsv", ".tab"), "TSV"
    )


def text_head(body: Column) -> Column:
    return F.decode(F.substring(body, 1, TEXT_HEAD), "ISO-8859-1")


def mostly_printable(head: Column) -> Column:
    """Not empty, and less than one in a hundred characters is a control other than tab and line ends."""
    controls = F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    return (F.length(head) > 0) & (controls * 100 < F.length(head))


def guess_delimiter(head: Column) -> Column:
    """The candidate that gives the first full lines the same number of fields, the most; null if none does."""
    text = F.regexp_replace(F.regexp_replace(head, "^\ufeff", ""), LEADING, "")

    def score(lines: Column, k: int) -> Column:
        delimiter = DELIMITERS[k]

        def fields(counts: Column) -> Column:
            first = F.array_position(F.transform(counts, lambda n: n > 1), True).cast("int")
            sample = F.when(first > 0, F.slice(counts, F.greatest(first, F.lit(1)), F.lit(SAMPLE_LINES)))
            return let(sample, lambda x: F.when(F.array_min(x) == F.array_max(x), F.array_max(x)).otherwise(1))

        counts = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit(""))) + 1)
        return F.struct(let(counts, fields).alias("n"), F.lit(-k).alias("k"))

    def best(lines: Column, plain: Column) -> Column:
        # Without the last line, which the sample may have cut.
        full = F.slice(lines, F.lit(1), F.size(lines) - 1)
        # Most candidates aren't in the text at all, and need no counts.
        return let(full, lambda x: F.array_max(F.array(*[F.when(F.contains(plain, F.lit(DELIMITERS[k])), score(x, k)) for k in range(len(DELIMITERS))])))

    listed = F.array(*[F.lit(d) for d in DELIMITERS])

    def guess(plain: Column) -> Column:
        lines = F.split(F.when(F.contains(plain, F.lit('"')), F.regexp_replace(plain, QUOTED, "")).otherwise(plain), "\n", -1)
        named = let(let(lines, lambda x: best(x, plain)), lambda x: F.when(x["n"] > 1, F.element_at(listed, 1 - x["k"])))
        return F.when((F.length(plain) > 0) & ~F.substring(plain, 1, 1).isin("<", "{", "["), named)

    return let(text, guess)


def classify(body: Column, content_type: Column, name: Column) -> Column:
    """PDF, XLSX, XLS, CSV, TSV or UNKNOWN: signatures first, then headers, then the look of the text."""
    kind, head = _lower(content_type), text_head(body)
    open_text = (kind == "") | F.contains(kind, F.lit("text/plain")) | F.contains(kind, F.lit("octet-stream"))
    guess = F.when(open_text, let(head, lambda x: F.when(mostly_printable(x), guess_delimiter(x))))
    typed = let(guess, lambda x: F.when(x == "\t", "TSV").when(x.isNotNull(), "CSV"))
    return (
        F.when(has_pdf_marker(body), "PDF")
        .when(is_zip(body), F.when(is_xlsx_zip(body), "XLSX").otherwise("UNKNOWN"))
        .when(is_cfb(body), F.when(is_legacy_excel(body, content_type, name), "XLS").otherwise("UNKNOWN"))
        .otherwise(F.coalesce(declared_text_type(content_type, name), typed, F.lit("UNKNOWN")))
    )
