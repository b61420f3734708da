"""Legacy XLS bodies to cells. The helper walks sectors and records; numbers, dates and errors become text in Spark."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respgrid.functions import scalars as S
from respgrid.limits import DEFAULT, Limits
from respgrid.operators import storage, workbook
from respgrid.operators.batches import map_batches

# Record ids.
BOF, EOF, BOUNDSHEET, SST, CONTINUE, FILEPASS, DATEMODE, XF, FORMAT = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x2F, 0x22, 0xE0, 0x41E
LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING = 0xFD, 0x204, 0xD6, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207
FIELDS = [
    ("response_id", pa.int64()), ("kind", pa.string()), ("sheet_idx", pa.int32()), ("ord", pa.int32()), ("row_idx", pa.int32()), ("col_idx", pa.int32()),
    ("style_idx", pa.int32()), ("number", pa.float64()), ("code", pa.int32()), ("flag", pa.bool_()), ("text", pa.string()),
]
SCHEMA = "response_id long, kind string, sheet_idx int, ord int, row_idx int, col_idx int, style_idx int, number double, code int, flag boolean, text string"
CELLS = frozenset({LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, BOOLERR, FORMULA})
#: Records that are handed on at once, and cells.
BATCH, AT_ONCE = 4096, 1 << 15
#: Cells of a task, about, in Spark.
TASK = 1 << 21
# What users are told, in the words that results must have.
LOCKED, NO_STREAM = "Workbook is password protected", "Not an .xls workbook: no Workbook stream in the container"
IMPLAUSIBLE, CUT_SHORT = "Shared string table declares an implausible size; strings may be missing", "Shared string table ended early after {} of {} strings"
EARLY, UNREADABLE = "Excel 5/95 workbook: text cells may render incorrectly", 'Sheet "{}" could not be read: {}'


def _u16(data: bytes, at: int) -> int:
    return struct.unpack_from("<H", data, at)[0]


#: The head of a compound file, as its format is published: sector shifts, how many allocation tables, where the directory begins,
#: the least size of a stream in large sectors, begin and length of the small sectors' table and of the list of more tables, and the first tables' places.
HEAD = struct.Struct("<30x2H10xII4xIIIII109I")
#: A directory entry: name, its bytes with the end mark, kind, first sector, size.
ENTRY = struct.Struct("<64sHB49xII4x")


def _numbers(raw: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])


def _follow(first: int, links: tuple[int, ...], kind: str) -> list[int]:
    """The sectors of a chain in order; it ends at any mark that is no sector's number."""
    seen: dict[int, None] = {}
    while first < 0x80000000:
        if first in seen:
            raise ValueError(f"{kind} sectors form a cyclic chain")
        if first >= len(links):
            raise ValueError(f"a chain of {kind} sectors runs past its table")
        seen[first] = None
        first = links[first]
    return list(seen)


class Container:
    """A compound file: its streams by name."""

    def __init__(self, data: bytes, limits: Limits = DEFAULT):
        if len(data) < HEAD.size:
            raise ValueError("no room for the head of a compound file")
        shift, small_shift, n_tables, directory, self.cutoff, small_first, n_small, more, n_more, *places = HEAD.unpack_from(data)
        if shift not in range(7, 21) or small_shift not in range(4, shift + 1):
            raise ValueError("sector sizes out of range")
        self.data, self.most, self.size, self.small = data, limits.unzipped_bytes, 1 << shift, 1 << small_shift
        self.links = _numbers(b"".join(self._sector(p, full=True) for p in self._places(places, more, n_more)[:n_tables]))
        found = {}
        for raw, length, kind, first, size in ENTRY.iter_unpack(self._cut(self._large(directory))):
            name = raw[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            # The root's chain holds all small sectors; of streams of one name the first counts.
            found.setdefault("" if kind == 5 else name if kind == 2 else None, (first, size))
        self.streams, root = found, found.get("")
        self.small_links = _numbers(self._large(small_first)[: n_small * self.size]) if n_small and small_first < 0x80000000 else ()
        self.small_sectors = self._large(root[0])[: root[1] or None] if root else b""

    def _places(self, listed: list[int], more: int, n_more: int) -> list[int]:
        """Where the allocation tables are: those that the head lists, and those in the list's further sectors."""
        out, visited = [p for p in listed if p < 0x80000000], set()
        while more < 0x80000000 and len(visited) < n_more and more not in visited:
            visited.add(more)
            *block, more = _numbers(self._sector(more, full=True))
            out += [p for p in block if p < 0x80000000]
        return out

    def _sector(self, number: int, full: bool = False) -> bytes:
        at = (number + 1) * self.size
        out = self.data[at : at + self.size]
        if len(out) < (self.size if full else 1):
            raise ValueError("a sector lies outside the file")
        return out

    @staticmethod
    def _cut(raw: bytes) -> bytes:
        return raw[: len(raw) // ENTRY.size * ENTRY.size]

    def _large(self, first: int) -> bytes:
        sectors = _follow(first, self.links, "large")
        return b"".join(self._sector(k) for k in sectors[: -(-self.most // self.size)])

    def stream(self, name: str) -> bytes | None:
        if name not in self.streams:
            return None
        first, size = self.streams[name]
        if size >= self.cutoff or not self.small_links:
            return self._large(first)[: size or None]
        blocks = [self.small_sectors[k * self.small : (k + 1) * self.small] for k in _follow(first, self.small_links, "small")]
        if not all(blocks):
            raise ValueError("a small sector lies outside their stream")
        return b"".join(blocks)[: size or None]


def _records(stream: bytes, at: int) -> Iterator[tuple[int, bytes, int]]:
    """(id, payload, place of the next) until the stream's end or a record that is cut off."""
    while at >= 0 and at + 4 <= len(stream):
        kind, length = struct.unpack_from("<HH", stream, at)
        at += 4 + length
        if at > len(stream):
            return
        yield kind, stream[at - length : at], at


def _text(data: bytes) -> str:
    """Count, flags, characters of one or two bytes; as many as are there."""
    if len(data) < 3:
        return ""
    wide = data[2] & 1
    raw = data[3 : 3 + _u16(data, 0) * (1 + wide)]
    return raw.decode("utf-16-le", "replace") if wide else raw.decode("latin-1")


class _Shared:
    """Strings that run on over continuation blocks; within characters a new block says anew how wide they are."""

    def __init__(self, blocks: list[bytes], limits: Limits):
        self.blocks, self.block, self.at, self.limits = blocks, 0, 0, limits

    def _more(self) -> bool:
        """To the next block if this one is used up; whether it was."""
        moved = False
        while self.block < len(self.blocks) and self.at >= len(self.blocks[self.block]):
            self.block, self.at, moved = self.block + 1, 0, True
        if self.block >= len(self.blocks):
            raise EOFError
        return moved

    def _take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            self._more()
            got = self.blocks[self.block][self.at : self.at + n - len(out)]
            self.at += len(got)
            out += got
        return out

    def next(self) -> str:
        count, flags = struct.unpack("<HB", self._take(3))
        runs = _u16(self._take(2), 0) if flags & 8 else 0
        extra = struct.unpack("<I", self._take(4))[0] if flags & 4 else 0
        if count > self.limits.cell_chars * 4:
            raise EOFError
        wide, out = flags & 1, []
        while count:
            if self._more():
                wide = self._take(1)[0] & 1
                continue
            n = min(count, max(1, (len(self.blocks[self.block]) - self.at) // (1 + wide)))
            raw = self._take(n * (1 + wide))
            out.append(raw.decode("utf-16-le", "surrogatepass") if wide else raw.decode("latin-1"))
            count -= n
        self._take(runs * 4 + extra)
        whole = "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        return whole if len(whole) <= self.limits.cell_chars else whole[: self.limits.cell_chars] + "…"


def decode_rk(packed: int) -> float:
    """A number in 32 bits: bit 1 says it is a whole one, bit 0 that it is in hundredths."""
    if packed & 2:
        value = float((packed ^ 0x80000000) - 0x80000000 >> 2)
    else:
        value = struct.unpack("<d", struct.pack("<Q", (packed & 0xFFFFFFFC) << 32))[0]
    return value / 100 if packed & 1 else value


def decode_rks(packed: np.ndarray) -> np.ndarray:
    """decode_rk over an array of unsigned 32-bit values."""
    whole = packed.view(np.int32) >> 2
    double = ((packed & np.uint32(0xFFFFFFFC)).astype(np.uint64) << np.uint64(32)).view(np.float64)
    value = np.where(packed & 2, whole, double)
    return np.where(packed & 1, value / 100, value)


#: What a cell holds.
A_NUMBER, A_TEXT, A_CODE = 0, 1, 2


class Part:
    """Cells as columns: places and styles of all, and the values of each kind in an array of their own. Those of one sheet follow one another."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.rows, self.columns, self.styles, self.kinds = array("i"), array("i"), array("i"), bytearray()
        self.numbers, self.texts, self.codes, self.flags = array("d"), [], array("i"), bytearray()
        # Where the cells of a sheet begin: position, response_id, sheet, number of its first cell here.
        self.runs: list[tuple[int, int, int, int]] = []

    def begin(self, response_id: int, sheet: int, first: int) -> None:
        self.runs.append((len(self), response_id, sheet, first))

    def __len__(self) -> int:
        return len(self.kinds)

    def _add(self, row: int, column: int, style: int, kind: int) -> None:
        self.rows.append(row)
        self.columns.append(column)
        self.styles.append(style)
        self.kinds.append(kind)

    def number(self, row: int, column: int, style: int, value: float) -> None:
        self._add(row, column, style, A_NUMBER)
        self.numbers.append(value)

    def text(self, row: int, column: int, style: int, value: str) -> None:
        self._add(row, column, style, A_TEXT)
        self.texts.append(value)

    def code(self, row: int, column: int, style: int, value: int, is_error: bool) -> None:
        self._add(row, column, style, A_CODE)
        self.codes.append(value)
        self.flags.append(is_error)

    def many(self, row: int, column: int, data: bytes) -> None:
        """Numbers in columns that follow one another: six bytes each, style and packed value."""
        n = len(data) // 6
        found = np.frombuffer(data, [("style", "<u2"), ("packed", "<u4")], n)
        self.rows.extend([row] * n)
        self.columns.extend(range(column, column + n))
        self.styles.frombytes(found["style"].astype(np.int32).tobytes())
        self.kinds += bytes(n)
        self.numbers.frombytes(decode_rks(np.ascontiguousarray(found["packed"])).tobytes())

    def batch(self) -> pa.RecordBatch:
        n, kinds = len(self), np.frombuffer(bytes(self.kinds), np.uint8)
        begins, ids, sheets, firsts = (np.array(c, np.int64) for c in zip(*self.runs, strict=True)) if self.runs else [np.zeros(0, np.int64)] * 4
        sizes = np.diff(np.r_[begins, n])
        ords = np.arange(n) - np.repeat(begins - firsts, sizes)

        def spread(values: np.ndarray, kind: int, to: pa.DataType) -> pa.Array:
            """Values at the cells of their kind, nulls at the others."""
            some = kinds == kind
            at = np.cumsum(some) - 1
            return pa.array(values, to).take(pa.array(np.where(some, at, 0), mask=~some))

        columns = {
            "response_id": pa.array(np.repeat(ids, sizes)), "kind": pa.repeat("cell", n), "sheet_idx": pa.array(np.repeat(sheets, sizes).astype(np.int32)),
            "ord": pa.array(ords.astype(np.int32)), "row_idx": pa.array(np.array(self.rows, np.int32)), "col_idx": pa.array(np.array(self.columns, np.int32)),
            "style_idx": pa.array(np.array(self.styles, np.int32)), "number": spread(np.array(self.numbers), A_NUMBER, pa.float64()), "code": spread(np.array(self.codes, np.int32), A_CODE, pa.int32()),
            "flag": spread(np.frombuffer(bytes(self.flags), np.uint8).astype(bool), A_CODE, pa.bool_()), "text": spread(self.texts, A_TEXT, pa.string()),
        }
        return pa.RecordBatch.from_arrays([columns[name] for name, _ in FIELDS], [name for name, _ in FIELDS])


def _formula(part: Part, row: int, column: int, style: int, data: bytes) -> bool:
    """A formula's cached value; whether it is a text that the next record of strings brings."""
    if len(data) < 14:
        return False
    if data[12:14] != b"\xff\xff":
        part.number(row, column, style, struct.unpack_from("<d", data, 6)[0])
    elif data[6] == 0:
        return True
    elif data[6] in (1, 2):
        part.code(row, column, style, data[8], data[6] == 2)
    else:
        part.text(row, column, style, "")
    return False


def _sheet(stream: bytes, offset: int, strings: list[str], key: tuple[int, int], part: Part) -> Iterator[Part]:
    """Puts the cells of a sheet (response_id, number) into part; hands part on, to be cleared, when it is full."""
    depth, pending, before = 0, None, 0
    part.begin(*key, 0)
    begun = len(part)
    for kind, data, _ in _records(stream, offset):
        if kind == BOF:
            depth += 1
        elif kind == EOF:
            depth -= 1
            if depth <= 0:
                break
        elif depth == 1 and kind == STRING:
            if pending:
                part.text(*pending, _text(data))
                pending = None
        elif depth == 1 and kind in CELLS:
            row, column, style = struct.unpack_from("<HHH", data, 0)
            if kind == LABELSST:
                index = struct.unpack_from("<I", data, 6)[0]
                part.text(row, column, style, strings[index] if index < len(strings) else "")
            elif kind in (LABEL, RSTRING):
                part.text(row, column, style, _text(data[6:]))
            elif kind == NUMBER:
                part.number(row, column, style, struct.unpack_from("<d", data, 6)[0])
            elif kind == RK:
                part.number(row, column, style, decode_rk(struct.unpack_from("<I", data, 6)[0]))
            elif kind == MULRK:
                part.many(row, column, data[4 : 4 + (len(data) - 6) // 6 * 6])
            elif kind == BOOLERR:
                part.code(row, column, style, data[6], data[7] != 0)
            else:
                pending = (row, column, style) if _formula(part, row, column, style, data) else None
            if len(part) >= AT_ONCE:
                before += len(part) - begun
                yield part
                part.clear()
                part.begin(*key, before)
                begun = 0


def records(body: bytes, limits: Limits = DEFAULT, response_id: int = 0, part: Part | None = None) -> Iterator[dict | Part]:
    """Tagged records of one workbook - book, xf, numfmt, sheet and warning. Its cells go into part, which is handed on whenever it is full.

    Cells bear the place of their sheet among all that are listed. A sheet's own record follows them: where one can't be
    read to its end there is none, and what it gave before has no sheet.
    """
    container = Container(body, limits)
    stream = container.stream("Workbook")
    stream = container.stream("Book") if stream is None else stream
    if stream is None:
        raise ValueError(NO_STREAM)
    strings: list[str] = []
    bound, warnings, version, date1904, styles, formats = [], [], 0x600, False, 0, 0
    for kind, data, after in _records(stream, 0):
        if kind == FILEPASS:
            raise ValueError(LOCKED)
        if kind == EOF:
            break
        if kind == BOF and len(data) >= 2:
            version = _u16(data, 0)
        elif kind == DATEMODE:
            date1904 = len(data) >= 2 and _u16(data, 0) == 1
        elif kind == XF:
            yield {"kind": "xf", "style_idx": styles, "code": _u16(data, 2) if len(data) >= 4 else 0}
            styles += 1
        elif kind == FORMAT and len(data) >= 3:
            yield {"kind": "numfmt", "ord": formats, "code": _u16(data, 0), "text": _text(data[2:])}
            formats += 1
        elif kind == BOUNDSHEET and len(data) >= 8:
            wide = data[7] & 1
            raw = data[8 : 8 + data[6] * (1 + wide)]
            name = raw.decode("utf-16-le", "replace") if wide else raw.decode("latin-1")
            bound.append((name or f"Sheet{len(bound) + 1}", struct.unpack_from("<i", data, 0)[0]))
        elif kind == SST and len(data) >= 8:
            count = struct.unpack_from("<i", data, 4)[0]
            if not 0 <= count <= limits.shared_strings:
                warnings.append(IMPLAUSIBLE)
                continue
            blocks = [data[8:]]
            for more, block, _ in _records(stream, after):
                if more != CONTINUE:
                    break
                blocks.append(block)
            shared = _Shared(blocks, limits)
            strings = [""] * count
            for i in range(count):
                try:
                    strings[i] = shared.next()
                except (EOFError, struct.error):
                    warnings.append(CUT_SHORT.format(i, count))
                    break
    if version and version < 0x600:
        warnings.append(EARLY)
    yield {"kind": "book", "flag": date1904}
    sheets, part = 0, Part() if part is None else part
    for place, (name, offset) in enumerate(bound):
        try:
            yield from _sheet(stream, offset, strings, (response_id, place), part)
        except (struct.error, IndexError) as error:
            warnings.append(UNREADABLE.format(name, error))
            continue
        yield {"kind": "sheet", "sheet_idx": sheets, "ord": place, "text": name}
        sheets += 1
    if not sheets:
        yield {"kind": "sheet", "sheet_idx": 0, "ord": len(bound), "text": "(empty)"}
    yield from ({"kind": "warning", "ord": k, "text": w} for k, w in enumerate(warnings))


def xls_records(detected: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Tagged records of all XLS bodies; a workbook that can't be read adds an error record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        part = Part()
        for batch in batches:
            for response_id, body in zip(batch.column("response_id").to_pylist(), batch.column("expanded"), strict=True):
                try:
                    for record in records(body.as_py(), limits, response_id, part):
                        if record is part:
                            yield part.batch()
                            continue
                        held.append(record | {"response_id": response_id})
                        if len(held) >= BATCH:
                            yield pa.RecordBatch.from_pylist(held, pa.schema(FIELDS))
                            held = []
                except Exception as error:  # one bad file must not end the task
                    held.append({"response_id": response_id, "kind": "error", "text": str(error) or type(error).__name__})
        yield part.batch()
        if held:
            yield pa.RecordBatch.from_pylist(held, pa.schema(FIELDS))

    some = detected.where((F.col("file_type") == "XLS") & (F.length("expanded") <= limits.tabular_bytes))
    return map_batches(some.select("response_id", "expanded"), run, SCHEMA)


def xls_tables(detected: DataFrame, staging: str, limits: Limits = DEFAULT) -> dict[str, DataFrame]:
    """cells, sheets, warnings and errors, as xlsx_tables gives them. Cells past a cap are left out.

    Cells are exchanged once, by response: there they meet what their book says of styles and sheets, and of those in one place the last stays.
    """
    spark = detected.sparkSession
    storage.write(xls_records(detected, limits), staging, "kind")
    staged = spark.read.schema(SCHEMA).parquet(staging)
    errors = staged.where("kind = 'error'").select("response_id", F.col("text").alias("message"))
    of = lambda kind: staged.where(F.col("kind") == kind)
    sound = lambda kind: of(kind).join(errors.select("response_id").distinct(), "response_id", "left_anti")
    styles = workbook.style_is_date(
        sound("xf").select("response_id", "style_idx", F.col("code").alias("numfmt_id")),
        sound("numfmt").select("response_id", "ord", F.col("code").alias("numfmt_id"), F.col("text").alias("code")),
    )
    # Sheets that were read to their end have numbers; cells of others find none, nor do those of books with an error.
    names = sound("sheet").select("response_id", F.col("ord").alias("place"), "sheet_idx", F.col("text").alias("name"))
    numbers = names.groupBy("response_id", "place").agg(F.max("sheet_idx").alias("sheet_idx"))
    places = numbers.groupBy("response_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "sheet_idx"))).alias("places"))
    books = places.join(of("book").select("response_id", F.col("flag").alias("date1904")), "response_id").join(workbook.book_styles(styles), "response_id", "left")
    cell = of("cell").select("response_id", F.col("sheet_idx").alias("place"), "ord", "row_idx", "col_idx", "style_idx", "number", "code", "flag", "text")
    joined = storage.dealt(cell, "response_id", most=TASK).join(books.hint("shuffle_hash"), "response_id")
    # Texts are made of the cells that stay: until then a cell has of its book what is its own.
    own = joined.withColumn("sheet_idx", F.col("places")[F.col("place")]).withColumn("is_date", F.get("dates", F.col("style_idx"))).where("sheet_idx is not null")
    last = workbook.last_cell_wins(workbook.drop_out_of_bounds(own, limits), "ord", ["number", "code", "flag", "text", "is_date", "date1904"])
    number = F.when(F.coalesce("is_date", F.lit(False)), S.date_serial_text(F.col("number"), F.col("date1904"))).otherwise(S.number_text(F.col("number")))
    text = F.when(F.col("number").isNotNull(), number).when(F.col("code").isNotNull(), S.boolerr_text(F.col("code"), F.col("flag"))).otherwise(F.col("text"))
    cells = last.select(*workbook.SHEET, "row_idx", "col_idx", S.clamp_cell(text, limits.cell_chars).alias("text"))
    shape = names.drop("place").join(workbook.sheet_shape(cells), workbook.SHEET, "left")
    return {
        "cells": cells,
        "sheets": shape.select(*workbook.SHEET, "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_cols")], F.coalesce("truncated", F.lit(False)).alias("truncated")),
        "warnings": sound("warning").select("response_id", F.col("ord").alias("seq"), F.col("text").alias("message")),
        "errors": errors,
    }
