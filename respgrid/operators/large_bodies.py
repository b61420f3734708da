"""Large CSV and TSV bodies in many tasks each.

A body's text is cut at line ends into chunks of about one size. Where a chunk begins - at a row's start or within quotes - hangs on all that
comes before it. So each chunk is summarised for either case: whether it then ends within quotes, and where its first row ends. Summaries are
composed along the body by running windows over these few numbers, never over text. With its beginning known, each chunk gives what
belongs to the row before it to the segment where that row began; segments hold whole rows, and are cut into records apart from
each other. Row numbers, and the cap on rows, follow from running counts of the segments' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respgrid.functions import scalars as S
from respgrid.limits import DEFAULT, Limits
from respgrid.operators import delimited as C
from respgrid.operators.grid import Stage
from respgrid.operators.storage import small

#: Bytes from which a body is large, characters of a chunk.
LARGE, CHUNK = 1 << 20, 1 << 16
KEY = ["response_id", "chunk"]


def _in_order(of: str = "chunk") -> Window:
    return Window.partitionBy("response_id").orderBy(of)


def chunks(detected: DataFrame, limits: Limits = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """response_id, name, delimiter, quoted, chunk and text: each text in pieces of at least so many characters, but for the last, that end with a line end."""
    whole = rf"(?s).{{1,{chunk}}}[^\r\n]*+(?:{C.LINE_END}|\z)"
    cut = F.regexp_extract_all(F.col("of.text"), F.lit(whole), F.lit(0))
    rows = C.texts(detected, limits).select("response_id", "name", F.col("of.delimiter").alias("delimiter"), F.col("of.quoted").alias("quoted"), F.posexplode_outer(cut).alias("chunk", "text"))
    return rows.where(F.col("chunk").isNotNull())


def _quotes(text: Column, delimiter: Column) -> Column:
    """Whether a text that begins at a field's start ends within quotes: then what is put after it lies in quotes too, and goes with them."""
    spans = lambda d: F.regexp_replace(F.concat(text, F.lit("e")), rf'(?s)(\A|[{d}\r\n])"(?:[^"]++|"")*+(?:"|\z)', "$1")
    return ~F.endswith(C._by_delimiter(delimiter, spans), F.lit("e"))


def _head(text: Column, delimiter: Column) -> Column:
    """How many characters of a text that begins within quotes belong to the row that it begins in."""
    opened = F.concat(F.lit('"'), text)
    first = lambda d: F.length(F.regexp_extract(opened, rf"(?s)\A{C._field(d)}(?:{d}{C._field(d)})*+(?:{C.LINE_END}|\z)", 0)) - 1
    return C._by_delimiter(delimiter, first)


def summaries(pieces: DataFrame) -> DataFrame:
    """Each chunk's length, whether it ends within quotes if it begins outside (open_out) or inside (open_in) of them, and its head if inside."""
    text, delimiter, quoted = F.col("text"), F.col("delimiter"), F.col("quoted")
    return pieces.select(
        *KEY,
        F.length("text").alias("chars"),
        F.when(quoted, _quotes(text, delimiter)).otherwise(False).alias("open_out"),
        F.when(quoted, _quotes(F.concat(F.lit('"'), text), delimiter)).otherwise(False).alias("open_in"),
        F.when(quoted, _head(text, delimiter)).otherwise(0).alias("head_in"),
    )


def composed(summary: DataFrame) -> DataFrame:
    """response_id, chunk, head, segment and continued: how much of a chunk belongs to the segment before, which that is, and whether its own goes on.

    A chunk either sets the state after it, whatever came before, or keeps it, or turns it round. So the state is that of the last one
    that set it, turned round as often as chunks after that one do.
    """
    sofar = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum(F.when(F.col("open_out") & ~F.col("open_in"), 1).otherwise(0)).over(sofar)
    counted = summary.withColumn("turns", turns)
    sets = F.when(F.col("open_out") == F.col("open_in"), F.struct(F.col("open_out").cast("int").alias("state"), "turns"))
    last = F.last(sets, ignorenulls=True).over(sofar)
    after = (F.coalesce(last["state"], F.lit(0)) + F.col("turns") - F.coalesce(last["turns"], F.lit(0))) % 2 == 1
    begun = counted.withColumn("after", after).withColumn("inside", F.coalesce(F.lag("after").over(_in_order()), F.lit(False)))
    headed = begun.withColumn("head", F.when(F.col("inside"), F.col("head_in")).otherwise(0))
    own = headed.withColumn("own", F.when(F.col("head") < F.col("chars"), F.col("chunk")))
    before = F.last("own", ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    continued = F.coalesce(F.lead("head").over(_in_order()) > 0, F.lit(False))
    return own.select(*KEY, "head", before.alias("segment"), continued.alias("continued"))


def segments(pieces: DataFrame, stage: Stage) -> DataFrame:
    """pieces (stored chunks) as segments: response_id, name, delimiter, quoted, segment and text, each of whole rows."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = stage(composed(stage(summaries(pieces), "chunk-summaries")), "chunk-states")
    placed = pieces.join(small(told), KEY)
    columns = ["response_id", "name", "delimiter", "quoted"]
    rest = F.substr("text", F.col("head") + 1)
    alone = placed.where(~F.col("continued") & (F.col("head") < F.length("text"))).select(*columns, F.col("chunk").alias("segment"), rest.alias("text"))
    parts = F.array(
        F.struct(F.col("segment"), F.substr("text", F.lit(1), F.col("head")).alias("part"), (F.col("head") > 0).alias("use")),
        F.struct(F.col("chunk").alias("segment"), rest.alias("part"), (F.col("continued") & (F.col("head") < F.length("text"))).alias("use")),
    )
    spread = placed.select(*columns, "chunk", F.explode(parts).alias("p")).where("p.use").select(*columns, "chunk", "p.segment", "p.part")
    # A number of partitions that is given isn't coalesced: a single body keeps all cores busy.
    grouped = spread.repartition(n, "response_id", "segment").groupBy("response_id", "segment").agg(
        *[F.first(c).alias(c) for c in columns[1:]], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "").alias("text")
    )
    return alone.unionByName(grouped.select(*columns, "segment", "text"))


def parse_large(detected: DataFrame, stage: Stage, limits: Limits = DEFAULT, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The rows and sheets of CSV and TSV responses, as parse_delimited and sheet_rows find them, but with several tasks for a body.

    Rows: response_id, sheet_idx, row_idx, cells. Sheets: response_id, sheet_idx, name, n_rows, n_cols, truncated. stage stores what several
    steps read: chunks and segments, each once the text, and tables of a few numbers for each chunk.
    """
    n = int(detected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = stage(chunks(detected, limits, chunk).repartition(n, *KEY), "chunks")
    k, delimiter, quoted = F.col("k"), F.col("delimiter"), F.col("quoted")
    cut = segments(pieces, stage).withColumn("k", C.kept_records(F.col("text"), delimiter, quoted))
    widths = lambda records: F.transform(records, lambda x: C.n_fields(x, delimiter, quoted))
    kept = cut.select(
        "response_id", "name", "delimiter", "quoted", "segment",
        S.let(k, lambda x: F.struct(x["ended"].alias("ended"), x["tail"].alias("tail"), widths(x["ended"]).alias("widths"), widths(x["tail"]).alias("tail_widths"))).alias("k"),
    )
    kept = stage(kept.select("response_id", "name", "delimiter", "quoted", "segment", "k.*"), "segments")
    thin = kept.select("response_id", "segment", F.size("widths").cast("long").alias("n"))
    before = F.sum("n").over(_in_order("segment").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counted = thin.select("response_id", "segment", before.alias("before"), F.sum("n").over(Window.partitionBy("response_id")).alias("total"))
    placed = kept.join(small(stage(counted, "segment-counts")), ["response_id", "segment"])
    room = F.greatest(F.lit(0), F.lit(limits.rows) - F.col("before")).cast("int")

    def capped(ended: str, tail: str) -> Column:
        some = F.when(F.size(ended) > room, F.slice(F.col(ended), F.lit(1), room)).otherwise(F.col(ended))
        return F.when(F.col("total") < limits.rows, F.concat(some, F.col(tail))).otherwise(some)

    records = placed.select("response_id", "delimiter", "quoted", "before", F.posexplode_outer(capped("ended", "tail")).alias("pos", "record")).where(F.col("pos").isNotNull())
    rows = records.select(
        "response_id", F.lit(0).alias("sheet_idx"), (F.col("before") + F.col("pos")).cast("int").alias("row_idx"), C.fields(F.col("record"), delimiter, quoted, limits).alias("cells")
    )
    shown = placed.select("response_id", "name", "total", capped("widths", "tail_widths").alias("widths"))
    width = F.coalesce(F.max(F.array_max("widths")), F.lit(0))
    grouped = shown.groupBy("response_id").agg(F.first("name").alias("name"), F.sum(F.size("widths")).cast("int").alias("n_rows"), width.alias("width"), (F.first("total") >= limits.rows).alias("full"))
    sheets = grouped.select(
        "response_id", F.lit(0).alias("sheet_idx"), "name", "n_rows", F.least("width", F.lit(limits.columns)).alias("n_cols"), (F.col("full") | (F.col("width") > limits.columns)).alias("truncated")
    )
    return rows, sheets


def parse_bodies(detected: DataFrame, stage: Stage, limits: Limits = DEFAULT, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Rows and sheets of all CSV and TSV responses of detected (stored): large bodies in several tasks each, the others where they lie."""
    size = F.length("expanded")
    whole = stage(C.parse_delimited(detected.where(size <= large), limits), "sheets")
    rows, sheets = parse_large(detected.where(size > large), stage, limits)
    shape = whole.select("response_id", "sheet_idx", "name", "n_rows", "n_cols", "truncated")
    return C.sheet_rows(whole, limits).unionByName(rows), shape.unionByName(sheets)
