"""CSV and TSV bodies to rows in two steps, without a shuffle.

First a body is cut into records, where it lies; blank ones go, so that a record's place is its row's
number. Then each record is a row of its own and is cut into fields. A body without any quote needs no
more than plain splits. Each step's time grows with the body's length alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respgrid.functions import detection as D
from respgrid.functions import scalars as S
from respgrid.limits import DEFAULT, Limits


def decode_text(body: Column) -> Column:
    """By its byte order mark, else UTF-8 if it is that, else Latin-1.

    Spark's decode refuses malformed UTF-16; where such bodies occur, set
    spark.sql.legacy.codingErrorAction to have replacement characters instead.
    """
    text = body.cast("string")
    starts = lambda digits: F.startswith(body, F.unhex(F.lit(digits)))
    return (
        F.when(starts("EFBBBF"), F.make_valid_utf8(F.substr(body, F.lit(4)).cast("string")))
        .when(starts("FFFE"), F.decode(F.substr(body, F.lit(3)), "UTF-16LE"))
        .when(starts("FEFF"), F.decode(F.substr(body, F.lit(3)), "UTF-16BE"))
        .when(F.is_valid_utf8(text), text)
        .otherwise(F.decode(body, "ISO-8859-1"))
    )


def parse_delimiter(file_type: Column, text: Column) -> Column:
    guess = F.coalesce(D.guess_delimiter(F.substring(text, 1, D.TEXT_HEAD)), F.lit(","))
    return F.when(file_type == "TSV", "\t").otherwise(guess)


#: A row ends at any of these.
LINE_END = r"\r\n|\r|\n"


def _safe(delimiter: str) -> str:
    return {"|": r"\|", "\t": r"\t"}.get(delimiter, delimiter)


def _field(d: str) -> str:
    return rf'(?:"(?:[^"]++|"")*+(?:"[^{d}\r\n]*+|\z)|[^"{d}\r\n][^{d}\r\n]*+|)'


def _quoted_records(text: Column, d: str) -> Column:
    """The records of a text, each with its line end; a text that ends with one has an empty record after it."""
    record = rf"(?s){_field(d)}(?:{d}{_field(d)})*+"
    found = F.regexp_extract_all(text, F.lit(rf"{record}(?:{LINE_END}|\z)"), F.lit(0))

    def cut(x: Column) -> Column:
        # Where the text ends within its last record, the search finds one more, which is empty.
        last = F.try_element_at(x, F.lit(-2))
        more = last.isNotNull() & ~F.rlike(last, F.lit(rf"\A{record}(?:{LINE_END})\z"))
        return F.when(more, F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x)

    return S.let(found, cut)


def _blank_quoted(record: Column, d: str) -> Column:
    """Whether all fields are empty: without characters, with blanks alone, or empty quotes."""
    blanks = r"[\x00-\x08\x0B\x0C\x0E-\x20]" if d == r"\t" else r"[\x00-\x09\x0B\x0C\x0E-\x20]"
    empty = rf'(?:""|{blanks}*+)'
    return F.rlike(record, F.lit(rf'\A(?:{empty}(?:{d}{empty})*+(?:{LINE_END})?|(?:{empty}{d})*+")\z'))


def _n_quoted(record: Column, d: str) -> Column:
    bare = F.regexp_replace(record, rf'(?s)(\A|{d})"(?:[^"]++|"")*+(?:"|\z)', "$1")
    return F.regexp_count(bare, F.lit(d)) + 1


def _by_delimiter(delimiter: Column, of: Callable[[str], Column]) -> Column:
    out = F.when(delimiter == D.DELIMITERS[0], of(_safe(D.DELIMITERS[0])))
    for d in D.DELIMITERS[1:]:
        out = out.when(delimiter == d, of(_safe(d)))
    return out


def finish_field(raw: Column, limits: Limits = DEFAULT) -> Column:
    """A quoted field unescaped and otherwise as it is; any other without white space at its ends."""
    whole = r'(?s)^"((?:[^"]++|"")*+)(?:"(.*))?\z'
    inner = F.replace(F.regexp_extract(raw, whole, 1), F.lit('""'), F.lit('"'))
    value = F.when(F.startswith(raw, F.lit('"')), F.concat(inner, F.regexp_extract(raw, whole, 2))).otherwise(S.trim_edges(raw))
    return S.clamp_cell(value, limits.cell_chars)


def _has_quote(record: Column, quoted: Column) -> Column:
    """Whether a record needs patterns: most records of texts with quotes have none."""
    return quoted & F.contains(record, F.lit('"'))


def kept_records(text: Column, delimiter: Column, quoted: Column) -> Column:
    """A text's records with anything in them: ended, those with a line end, and tail, which has the last one if the end of the text ends it."""
    records = F.when(quoted, _by_delimiter(delimiter, lambda d: _quoted_records(text, d))).otherwise(F.split(text, LINE_END, -1))
    plain = lambda x: F.ltrim(x, F.concat(F.lit(S.EDGES), delimiter)) != ""
    with_text = lambda x: F.when(_has_quote(x, quoted), ~_by_delimiter(delimiter, lambda d: _blank_quoted(x, d))).otherwise(plain(x))
    return S.let(
        records,
        lambda x: F.struct(F.filter(F.slice(x, F.lit(1), F.size(x) - 1), with_text).alias("ended"), F.filter(F.slice(x, F.size(x), F.lit(1)), with_text).alias("tail")),
    )


def n_fields(record: Column, delimiter: Column, quoted: Column) -> Column:
    plain = F.length(record) - F.length(F.replace(record, delimiter, F.lit(""))) + 1
    return F.when(_has_quote(record, quoted), _by_delimiter(delimiter, lambda d: _n_quoted(record, d))).otherwise(plain)


def texts(detected: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """response_id, name and of (text, delimiter, quoted) of each CSV or TSV response."""
    text = detected.where(F.col("file_type").isin("CSV", "TSV") & (F.length("expanded") <= limits.tabular_bytes)).select(
        "response_id", "file_type", S.sheet_name(F.col("file_name")).alias("name"), decode_text(F.col("expanded")).alias("text")
    )
    told = S.let(F.col("text"), lambda t: F.struct(t.alias("text"), parse_delimiter(F.col("file_type"), t).alias("delimiter"), F.contains(t, F.lit('"')).alias("quoted")))
    return text.select("response_id", "name", told.alias("of"))


def parse_delimited(detected: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """One row per CSV or TSV response: response_id, sheet_idx, name, delimiter, quoted, records, n_rows, n_cols, truncated.

    records has the rows with any text, up to the cap, as they are in the body; sheet_rows cuts them into cells. A row
    that the end of the text ends isn't looked at when the rows before it reach the cap.
    """
    def cut(of: Column) -> Column:
        delimiter, quoted = of["delimiter"], of["quoted"]

        def capped(k: Column) -> Column:
            full = F.size(k["ended"]) >= limits.rows
            return F.struct(F.when(full, F.slice(k["ended"], 1, limits.rows)).otherwise(F.concat(k["ended"], k["tail"])).alias("records"), full.alias("full"))

        return S.let(
            S.let(kept_records(of["text"], delimiter, quoted), capped),
            lambda k: F.struct(
                delimiter.alias("delimiter"), quoted.alias("quoted"), k["records"].alias("records"), k["full"].alias("full"),
                F.coalesce(F.array_max(F.transform(k["records"], lambda x: n_fields(x, delimiter, quoted))), F.lit(0)).alias("width"),
            ),
        )

    sheets = texts(detected, limits).select("response_id", "name", S.let(F.col("of"), cut).alias("s"))
    return sheets.select(
        "response_id",
        F.lit(0).alias("sheet_idx"),
        "name",
        "s.delimiter",
        "s.quoted",
        "s.records",
        F.size("s.records").alias("n_rows"),
        F.least(F.col("s.width"), F.lit(limits.columns)).alias("n_cols"),
        (F.col("s.full") | (F.col("s.width") > limits.columns)).alias("truncated"),
    )


def fields(record: Column, delimiter: Column, quoted: Column, limits: Limits = DEFAULT) -> Column:
    """The cells of one record."""

    def parts(d: str) -> Column:
        pattern = F.lit(rf"(?s)({_field(d)})({d}|{LINE_END}|\z)")
        ends = F.regexp_extract_all(record, pattern, F.lit(2))
        last = lambda x: F.array_position(F.transform(x, lambda end: F.rlike(end, F.lit(d))), False).cast("int")
        return F.transform(F.slice(F.regexp_extract_all(record, pattern, F.lit(1)), F.lit(1), S.let(ends, last)), lambda x: finish_field(x, limits))

    plain = lambda d: F.transform(F.split(record, d, -1), lambda x: S.clamp_cell(S.trim_edges(x), limits.cell_chars))
    return F.when(_has_quote(record, quoted), _by_delimiter(delimiter, parts)).otherwise(_by_delimiter(delimiter, plain))


def sheet_rows(parsed: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """response_id, sheet_idx, row_idx, cells: one row per row of the sheet.

    An inner explode would have Spark infer a filter on records and push it, with all that they
    are made of, below the steps that make them; the outer one, with the filter after it, doesn't.
    """
    records = parsed.select("response_id", "sheet_idx", "delimiter", "quoted", F.posexplode_outer("records").alias("row_idx", "record")).where(F.col("row_idx").isNotNull())
    return records.select("response_id", "sheet_idx", "row_idx", fields(F.col("record"), F.col("delimiter"), F.col("quoted"), limits).alias("cells"))


def cells_of_rows(rows: DataFrame) -> DataFrame:
    """response_id, sheet_idx, row_idx, col_idx, text: one row per cell."""
    cells = rows.select("response_id", "sheet_idx", "row_idx", F.posexplode_outer("cells").alias("col_idx", "text"))
    return cells.where(F.col("col_idx").isNotNull())
