"""The grid on top of rows: header, filter, order, counts and export.

rows: response_id, sheet_idx, row_idx, cells (ragged). sheets: response_id, sheet_idx, name, n_rows, n_cols, truncated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respgrid.functions import scalars as S
from respgrid.operators.storage import small

SHEET = ["response_id", "sheet_idx"]
#: Stores a DataFrame under a name and reads it again.
Stage = Callable[[DataFrame, str], DataFrame]
# Fixed value: what users are told, in the words that results must have.
CUT = '" truncated at the row/column cap'


def cell(i: int | Column) -> Column:
    """The cell in column i, '' past the row's end."""
    return F.coalesce(F.try_element_at("cells", F.lit(i) + 1), F.lit(""))


def to_wide(rows: DataFrame, width: int, names: list[str] | None = None) -> DataFrame:
    """One column a cell; repeated names get a number, for a table can't have two columns of one name."""
    seen: dict[str, int] = {}
    columns = []
    for i in range(max(width, 1)):
        name = names[i] if names and i < len(names) and names[i] else _letters(i)
        seen[name] = seen.get(name, 0) + 1
        columns.append(cell(i).alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return rows.select(*SHEET, "row_idx", *columns)


def _letters(i: int) -> str:
    return (_letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def padded(cells: Column, width: Column) -> Column:
    missing = F.greatest(width - F.size(cells), F.lit(0))
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), missing)), F.lit(1), F.greatest(width, F.lit(1)))


def source_row_number(rows: DataFrame) -> DataFrame:
    """rows with source_row: the 1-based number in the sheet, which filters and orders leave as it is."""
    return rows.withColumn("source_row", F.col("row_idx") + 1)


def headers(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """response_id, sheet_idx and header of each sheet with rows: its first row's names to the sheet's full width, letters for empty ones."""
    width = F.greatest("n_cols", F.lit(1))
    heads = rows.where("row_idx = 0").join(sheets.select(*SHEET, "n_cols"), SHEET)
    named = F.transform(
        padded(F.col("cells"), width), lambda name, i: F.when(name == "", S.column_letters(i)).otherwise(name)
    )
    return heads.select(*SHEET, named.alias("header"))


def promote_header(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Data rows with header (names to the sheet's full width, letters for empty ones) and source_row.

    The first row is the header and leaves the data. One header for each sheet: joined by the sheet's
    key, so that it stays with its rows.
    """
    return source_row_number(rows.where("row_idx > 0")).join(headers(rows, sheets), SHEET)


def with_first_header(data: DataFrame, heads: DataFrame, place: str) -> DataFrame:
    """data with header for the row of each sheet whose place is 1, and null for the others: no other row moves to meet it."""
    first = data.where(F.col(place) == 1).join(heads, SHEET)
    return first.unionByName(data.where(F.col(place) > 1).withColumn("header", F.lit(None).cast("array<string>")))


def contains_text(text: str) -> Column:
    """Whether any cell has the text, literally and, for ASCII letters, in either case; always true for ''."""
    if not text:
        return F.lit(True)
    pattern = "(?i)\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.exists("cells", lambda c: c.rlike(pattern))


def filter_contains(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(contains_text(text))


def order_keys(text: Column) -> list[Column]:
    """Sort keys of the spreadsheet order: numbers first, by value; then text without regard to case, '' foremost."""
    number = S.as_number(text)
    negative_zero = (number == 0) & F.startswith(S.trim_edges(text), F.lit("-"))
    return [number.isNull(), number, F.when(negative_zero, 0).otherwise(1), F.when(number.isNull(), F.lower(F.upper(text)))]


def numbered(rows: DataFrame, name: str, keys: list[Column], ascending: list[bool], stage: Stage) -> DataFrame:
    """rows with their place (1-based) in their sheet by keys, which tell all of its rows apart; a sheet's rows are sorted and numbered by several tasks.

    Rows are dealt by sampled bounds over sheet and keys, and sorted where they are. stage stores them with their place in their task; counts
    for each task and sheet, a few numbers, say how many come before.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Keys are columns first: a sort computes what it is given anew for every comparison.
    keyed = rows.select("*", *[k.alias(f"__key{i}") for i, k in enumerate(keys)])
    order = [F.col(f"__key{i}").asc() if up else F.col(f"__key{i}").desc() for i, up in enumerate(ascending)]
    # A number of partitions that is given isn't coalesced.
    dealt = keyed.repartitionByRange(n, *[F.col(c).asc() for c in SHEET], *order).sortWithinPartitions(*SHEET, *order)
    own = stage(dealt.select(*rows.columns, F.spark_partition_id().alias("__task"), F.monotonically_increasing_id().alias("__id")), "sorted-rows")
    counts = own.groupBy(*SHEET, "__task").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*SHEET).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(*SHEET, "__task", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return own.join(small(stage(begins, "begins")), [*SHEET, "__task"]).select(*rows.columns, (F.col("__id") + F.col("__shift")).cast("int").alias(name))


def sort_rows(rows: DataFrame, column: int, ascending: bool = True, stage: Stage | None = None) -> DataFrame:
    """rows with rank (1-based) in each sheet by one column; equal cells keep the sheet's order either way. With stage, several tasks sort a sheet."""
    keys = order_keys(cell(column))
    if stage:
        return numbered(rows, "rank", [*keys, F.col("row_idx")], [*[ascending] * len(keys), True], stage)
    ordered = [*[k.asc() if ascending else k.desc() for k in keys], F.col("row_idx").asc()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*SHEET).orderBy(*ordered)))


def row_counts(rows: DataFrame, sheets: DataFrame, shown: Column) -> DataFrame:
    """response_id, sheet_idx and counts: the line that says how many rows are shown."""
    counted = rows.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("total"), F.count_if(shown).alias("shown"))
    joined = sheets.select(*SHEET, "n_cols").join(counted, SHEET, "left")
    total, some = F.coalesce("total", F.lit(0)), F.coalesce("shown", F.lit(0))
    text = F.when(total == some, F.concat(total.cast("string"), F.when(total == 1, " row").otherwise(" rows"))).otherwise(
        F.concat(some.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" rows"))
    )
    columns = F.concat(F.lit(" · "), F.greatest("n_cols", F.lit(1)).cast("string"), F.lit(" cols"))
    return joined.select(*SHEET, F.concat(text, columns).alias("counts"))


def csv_line(cells: Column) -> Column:
    return F.array_join(F.transform(cells, S.csv_quote), ",")


def csv_lines(data: DataFrame, sheets: DataFrame, order: str = "row_idx", stage: Stage | None = None, told: bool = False) -> DataFrame:
    """response_id, sheet_idx, line_no, line: the header's names, then the rows of promote_header in the given order. With stage, several tasks number a sheet.

    told says that order numbers a sheet's rows from 1 without a gap, as sort_rows does; the first of them needs a header then.
    """
    width = sheets.select(*SHEET, F.greatest("n_cols", F.lit(1)).alias("__width"))
    number = F.row_number().over(Window.partitionBy(*SHEET).orderBy(order))
    if told:
        placed = data.withColumn("line_no", F.col(order))
    else:
        placed = numbered(data, "line_no", [F.col(order)], [True], stage) if stage else data.withColumn("line_no", number)
    line = F.struct("line_no", csv_line(padded(F.col("cells"), F.col("__width"))).alias("line"))
    # The first row brings the header with it, so that data is made once.
    head = F.when(F.col("line_no") == 1, F.array(F.struct(F.lit(0).alias("line_no"), csv_line(F.col("header")).alias("line")))).otherwise(F.array())
    met = placed.join(small(stage(width, "widths")) if stage else width, SHEET)
    return met.select(*SHEET, F.explode_outer(F.concat(head, F.array(line))).alias("__l")).select(*SHEET, "__l.line_no", "__l.line")


def numeric_cells(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """response_id, sheet_idx, col_idx, numeric, total: how many cells of a column read as numbers."""
    full = rows.join(sheets.select(*SHEET, "n_cols"), SHEET).select(*SHEET, F.posexplode(padded(F.col("cells"), F.col("n_cols"))).alias("col_idx", "text"))
    return full.groupBy(*SHEET, "col_idx").agg(F.count_if(S.as_number(F.col("text")).isNotNull()).alias("numeric"), F.count(F.lit(1)).alias("total"))


def sample_head(data: DataFrame, n: int) -> DataFrame:
    """The first n rows of each sheet."""
    place = F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_idx"))
    return data.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def column_width_sample(data: DataFrame, sample: int = 200) -> DataFrame:
    """response_id, sheet_idx, col_idx, width: the most characters in the name and the first rows of a column."""
    head = sample_head(data, sample)
    cells = head.select(*SHEET, F.posexplode(padded(F.col("cells"), F.size("header"))).alias("col_idx", "text"))
    names = data.groupBy(*SHEET).agg(F.any_value("header").alias("header")).select(*SHEET, F.posexplode("header").alias("col_idx", "text"))
    return cells.unionByName(names).groupBy(*SHEET, "col_idx").agg(F.max(F.length("text")).alias("width"))


def notices(warnings: DataFrame, sheets: DataFrame) -> DataFrame:
    """response_id and notice: warnings in order, then the sheets that were cut."""
    cut = sheets.where("truncated").select(
        "response_id", F.lit(1).alias("part"), F.col("sheet_idx").alias("seq"), F.concat(F.lit('"'), "name", F.lit(CUT)).alias("message")
    )
    told = warnings.select("response_id", F.lit(0).alias("part"), "seq", "message").unionByName(cut)
    ordered = F.array_sort(F.collect_list(F.struct("part", "seq", "message")))
    return told.groupBy("response_id").agg(F.array_join(F.transform(ordered, lambda x: x["message"]), " · ").alias("notice"))
