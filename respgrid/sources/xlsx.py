"""XLSX bodies to staged records: unzipping and walking XML is the helper's work, everything after it is Spark's."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respgrid.limits import DEFAULT, Limits
from respgrid.operators import storage, workbook
from respgrid.operators.batches import map_batches

# The parts that are read.
WORKBOOK, RELATIONS, STRINGS, STYLES = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml", "xl/styles.xml"
SHEETS = ("xl/worksheets/", ".xml")
#: The parts that come before sheets, in the order in which they are walked.
FRONT = [WORKBOOK, RELATIONS, STYLES, STRINGS]
#: Elements of a string that tell how it is spoken.
HINTS = frozenset({"rPh", "phoneticPr"})
# Fixed value: what users are told, in the words that results must have.
NO_WORKBOOK = "Not an xlsx container: xl/workbook.xml is missing"
#: A cell in its row: its number there, and what it says.
CELL = [("cell_n", pa.int32()), ("style_idx", pa.int32()), ("ref", pa.string()), ("t", pa.string()), ("v", pa.string()), ("inline_text", pa.string())]
FIELDS = [
    ("response_id", pa.int64()), ("kind", pa.string()), ("part", pa.string()), ("ord", pa.int32()), ("number", pa.int32()),
    ("flag", pa.bool_()), ("name", pa.string()), ("value", pa.string()), ("text", pa.string()),
]
SCHEMA = (
    "response_id long, kind string, part string, ord int, number int, flag boolean, name string, value string, text string, "
    "cells array<struct<cell_n:int,style_idx:int,ref:string,t:string,v:string,inline_text:string>>"
)
#: Records and cells of a batch; one row may have more.
BATCH = 4096
#: Bytes from which a body's parts are dealt out.
LARGE = 1 << 20


class _Walk:
    """Start, end and text events of one part, by local name, as expat gives them."""

    def __init__(self) -> None:
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler = lambda name, attributes: self.start(name.rpartition(":")[2], {k.rpartition(":")[2]: v for k, v in attributes.items()})
        self.parser.EndElementHandler = lambda name: self.end(name.rpartition(":")[2])
        self.parser.CharacterDataHandler = self.text
        self.parser.EntityDeclHandler = self._refuse
        self.out: list[dict] = []

    @staticmethod
    def _refuse(*_: object) -> None:
        raise ValueError("entities are not read")

    def start(self, name: str, attributes: dict[str, str]) -> None: ...
    def end(self, name: str) -> None: ...
    def text(self, data: str) -> None: ...

    def over(self, xml: bytes) -> Iterator[dict]:
        for at in range(0, len(xml), 1 << 16):
            self.parser.Parse(xml[at : at + (1 << 16)], at + (1 << 16) >= len(xml))
            yield from self.out
            self.out.clear()


def _int(value: str | None) -> int | None:
    try:
        number = int(value.strip()) if value and value.strip().isascii() and "_" not in value else None
    except ValueError:
        return None
    return number if number is not None and -(2**31) <= number < 2**31 else None


_style = lru_cache(1 << 12)(_int)


class _Book(_Walk):
    ords, date1904 = 0, False

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "workbookPr":
            flag = attributes.get("date1904", attributes.get("date1904Compatibility"))
            self.date1904 = flag is not None and (flag == "1" or flag.lower() == "true")
        elif name == "sheet" and "id" in attributes:
            self.out.append({"kind": "sheet", "ord": self.ords, "name": attributes.get("name"), "value": attributes["id"]})
            self.ords += 1


class _Relations(_Walk):
    ords = 0

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "Relationship" and "Id" in attributes and "Target" in attributes:
            self.out.append({"kind": "rel", "ord": self.ords, "name": attributes["Id"], "value": attributes["Target"]})
            self.ords += 1


class _Styles(_Walk):
    ords = styles = 0
    listed = False

    def start(self, name: str, attributes: dict[str, str]) -> None:
        format_id = _int(attributes.get("numFmtId"))
        if name == "numFmt" and format_id is not None and format_id >= 0 and "formatCode" in attributes:
            self.out.append({"kind": "numfmt", "ord": self.ords, "number": format_id, "text": attributes["formatCode"]})
            self.ords += 1
        elif name == "cellXfs":
            self.listed = True
        elif name == "xf" and self.listed:
            self.out.append({"kind": "xf", "ord": self.styles, "number": format_id or 0})
            self.styles += 1

    def end(self, name: str) -> None:
        self.listed = self.listed and name != "cellXfs"


class _Texts(_Walk):
    """Texts of rich or plain strings, without phonetic hints."""

    run: list[str] | None = None

    def __init__(self) -> None:
        super().__init__()
        self.within: list[str] = []  # names of the open elements of a string

    def text_start(self, name: str) -> None:
        self.within.append(name)

    def text_end(self, name: str) -> None:
        while name in self.within and self.within.pop() != name:
            pass

    def text(self, data: str) -> None:
        if self.run is not None and self.within[-1:] == ["t"] and HINTS.isdisjoint(self.within):
            self.run.append(data)

    def taken(self, limits: Limits) -> str:
        whole, self.run = "".join(self.run or ()), None
        self.within.clear()
        return whole if len(whole) <= limits.cell_chars else whole[: limits.cell_chars] + "…"


class _Strings(_Texts):
    ords = 0

    def __init__(self, limits: Limits) -> None:
        super().__init__()
        self.limits = limits

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if self.run is not None:
            self.text_start(name)
        elif name == "si" and self.ords < self.limits.shared_strings:
            self.run = []

    def end(self, name: str) -> None:
        if self.run is None:
            return
        if name == "si":
            self.out.append({"kind": "sst", "ord": self.ords, "text": self.taken(self.limits)})
            self.ords += 1
        else:
            self.text_end(name)


class _Cells(_Texts):
    """Rows with their declared numbers and their cells (CELL) in document order; a row that doesn't end isn't one."""

    rows = cells = 0
    cell: list | None = None
    value: list[str] | None = None
    formula = loose = False

    def __init__(self, part: str, limits: Limits) -> None:
        super().__init__()
        self.part, self.limits, self.declared = part, limits, None
        self.row: list[list] = []
        # There are many cells: names are cut only where they have a prefix, and attributes only of elements that are read.
        self.parser.StartElementHandler, self.parser.EndElementHandler = self.start, self.end

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if ":" in name:
            name = name.rpartition(":")[2]
        if self.run is not None:
            self.text_start(name)
        elif self.formula:
            return
        elif self.cell is not None:
            if name == "v":
                self.value = []
            elif name == "is":
                self.run = []
            elif name == "f":
                self.formula = True
        elif name == "c" or name == "row":
            if ":" in "".join(attributes):
                attributes = {k.rpartition(":")[2]: v for k, v in attributes.items()}
            get = attributes.get
            if name == "c":
                style = _style(get("s"))
                self.cell = [self.cells, -1 if style is None else style, get("r"), get("t"), None, None]
                self.cells += 1
            else:
                self.cells, self.declared, self.loose = 0, _int(get("r")), bool(self.row)

    def text(self, data: str) -> None:
        if self.value is not None:
            self.value.append(data)
        else:
            super().text(data)

    def end(self, name: str) -> None:
        if ":" in name:
            name = name.rpartition(":")[2]
        if self.run is not None:
            if name == "is" and self.cell is not None:
                self.cell[5] = self.taken(self.limits)
            else:
                self.text_end(name)
        elif self.formula:
            self.formula = name != "f"
        elif self.value is not None:
            if name == "v":
                self.cell[4], self.value = "".join(self.value), None
        elif name == "c" and self.cell is not None:
            self.row.append(self.cell)
            self.cell = None
        elif name == "row":
            if self.loose:  # cells outside of rows count to the next one
                self.row.sort(key=lambda cell: cell[0])
            self.out.append({"kind": "row", "part": self.part, "ord": self.rows, "number": self.declared, "cells": self.row})
            self.rows += 1
            self.row = []


@dataclass(frozen=True)
class Packed:
    """A part as the container has it: order says when it is walked, allowed how much of its size may be read."""

    order: int
    name: str
    method: int
    data: bytes
    size: int
    allowed: int
    crc: int

    def xml(self) -> bytes:
        if self.method == zipfile.ZIP_STORED:
            out = self.data[: self.allowed]
        elif self.method == zipfile.ZIP_DEFLATED:
            out = zlib.decompressobj(-15).decompress(self.data, self.allowed) if self.allowed else b""
        else:
            raise NotImplementedError(f"{self.name} is packed in a way that isn't read")
        if len(out) < self.allowed:
            raise EOFError(f"{self.name} ends early")
        if self.allowed == self.size and zlib.crc32(out) != self.crc:
            raise zipfile.BadZipFile(f"{self.name} isn't what its checksum says")
        return out


def directory(body: bytes, limits: Limits = DEFAULT) -> list[Packed]:
    """The wanted parts of a container, of several with one name the last, within the limits on entries and on bytes in all."""
    parts: dict[str, Packed] = {}
    total = 0
    with zipfile.ZipFile(io.BytesIO(body)) as container:
        for entry in container.infolist()[: limits.zip_entries]:
            name, at = entry.filename, entry.header_offset
            if not (name in FRONT or name.startswith(SHEETS[0]) and name.endswith(SHEETS[1])):
                continue
            if body[at : at + 4] != b"PK\x03\x04" or entry.flag_bits & 1:
                raise zipfile.BadZipFile(f"{name} can't be read")
            begin = at + 30 + sum(struct.unpack_from("<HH", body, at + 26))
            allowed = min(entry.file_size, limits.unzipped_bytes - total)
            order = FRONT.index(name) if name in FRONT else len(FRONT) + len(parts)
            order = parts[name].order if name in parts else order
            parts[name] = Packed(order, name, entry.compress_type, body[begin : begin + entry.compress_size], entry.file_size, allowed, entry.CRC)
            total += allowed
            if total >= limits.unzipped_bytes:
                break
    if WORKBOOK not in parts:
        raise ValueError(NO_WORKBOOK)
    return sorted(parts.values(), key=lambda p: p.order)


def part_records(part: Packed, limits: Limits = DEFAULT) -> Iterator[dict]:
    """The records of one part."""
    xml = part.xml()
    if part.name == WORKBOOK:
        book = _Book()
        sheets = list(book.over(xml))
        yield {"kind": "workbook"}
        yield from (s | {"flag": book.date1904} for s in sheets)
    elif part.name in FRONT:
        walk = {RELATIONS: _Relations, STYLES: _Styles}.get(part.name) or (lambda: _Strings(limits))
        yield from walk().over(xml)
    else:
        yield {"kind": "part", "part": part.name}
        yield from _Cells(part.name, limits).over(xml)


def records(body: bytes, limits: Limits = DEFAULT) -> Iterator[dict]:
    """The records of one workbook, one after another."""
    for part in directory(body, limits):
        yield from part_records(part, limits)


def _told(error: Exception) -> str:
    known = (ValueError, KeyError, OSError, EOFError, zipfile.BadZipFile, expat.ExpatError, NotImplementedError, RuntimeError)
    return (str(error) if isinstance(error, known) else "") or type(error).__name__


def _batches(found: Iterator[tuple[int, int, Callable[[], Iterator[dict]]]]) -> Iterator[pa.RecordBatch]:
    """Batches of the records of workbooks or parts: response_id, the order of an error, and how to get at them. One bad file must not end the task."""

    def batch_of(records: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r.get(name) for r in records], kind) for name, kind in FIELDS]
        counts, cells = [0], []
        for record in records:
            cells += record.get("cells", ())
            counts.append(len(cells))
        parts = zip(*cells, strict=True) if cells else [()] * len(CELL)
        inner = pa.StructArray.from_arrays([pa.array(part, kind) for part, (_, kind) in zip(parts, CELL, strict=True)], [name for name, _ in CELL])
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(counts, pa.int32()), inner)], [*[name for name, _ in FIELDS], "cells"])

    held: list[dict] = []
    size = 0
    for response_id, order, of in found:
        try:
            for record in of():
                record["response_id"] = response_id
                held.append(record)
                size += 1 + len(record.get("cells", ()))
                if size >= BATCH:
                    yield batch_of(held)
                    held, size = [], 0
        except Exception as error:
            held.append({"response_id": response_id, "kind": "error", "ord": order, "text": _told(error)})
    if held:
        yield batch_of(held)


PACKED = "response_id long, order int, name string, method int, data binary, size long, allowed long, crc long, error string"


def xlsx_parts(bodies: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """A row of PACKED for each wanted part of each body (response_id, expanded), still packed; one with error for a container that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("response_id", pa.int64()), ("order", pa.int32()), ("name", pa.string()), ("method", pa.int32()), ("data", pa.binary())]
        kinds += [("size", pa.int64()), ("allowed", pa.int64()), ("crc", pa.int64()), ("error", pa.string())]
        for batch in batches:
            for response_id, body in zip(batch.column("response_id").to_pylist(), batch.column("expanded"), strict=True):
                try:
                    rows = [{"response_id": response_id} | vars(part) for part in directory(body.as_py(), limits)]
                except Exception as error:  # one bad file must not end the task
                    rows = [{"response_id": response_id, "order": -1, "error": _told(error)}]
                yield from (pa.RecordBatch.from_pylist([row], pa.schema(kinds)) for row in rows)

    return map_batches(bodies, run, PACKED)


def _walked(parts: DataFrame, limits: Limits) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int, Callable[[], Iterator[dict]]]]:
            for batch in batches:
                for k in range(len(batch)):
                    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                    response_id, error = row.pop("response_id"), row.pop("error")

                    def of(row: dict = row, error: str | None = error) -> Iterator[dict]:
                        if error is not None:
                            raise ValueError(error)
                        return part_records(Packed(**row), limits)

                    yield response_id, row["order"], of

        yield from _batches(found())

    return map_batches(parts, run, SCHEMA)


def xlsx_records(detected: DataFrame, limits: Limits = DEFAULT, large: int = LARGE) -> DataFrame:
    """Tagged records of all XLSX bodies. A workbook that can't be read adds error records to what it gave before.

    A body of over so many bytes is taken apart first, and its parts, still packed, are dealt out, so that several tasks walk the sheets of one book.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (
            (response_id, 0, lambda body=body: records(body.as_py(), limits))
            for batch in batches
            for response_id, body in zip(batch.column("response_id").to_pylist(), batch.column("expanded"), strict=True)
        )
        yield from _batches(found)

    size = F.length("expanded")
    some = detected.where((F.col("file_type") == "XLSX") & (size <= limits.tabular_bytes)).select("response_id", "expanded")
    tasks = int(detected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = xlsx_parts(some.where(size > large), limits).repartition(tasks, "response_id", "name")
    return map_batches(some.where(size <= large), run, SCHEMA).unionByName(_walked(dealt, limits))


def by_kind(staged: DataFrame) -> dict[str, DataFrame]:
    """The staged records as the tables that workbook.assemble takes."""
    of = lambda kind, **columns: staged.where(F.col("kind") == kind).select("response_id", *[F.col(v).alias(k) for k, v in columns.items()])
    return {
        "workbook": of("workbook"),
        "sheet": of("sheet", ord="ord", name="name", rel_id="value", date1904="flag"),
        "rel": of("rel", ord="ord", rel_id="name", target="value"),
        "part": of("part", part="part"),
        "sst": of("sst", sst_idx="ord", text="text"),
        "xf": of("xf", style_idx="ord", numfmt_id="number"),
        "numfmt": of("numfmt", ord="ord", numfmt_id="number", code="text"),
        "row": of("row", part="part", n="ord", declared="number", cells="cells"),
        "error": of("error", order="ord", message="text").groupBy("response_id").agg(F.min_by("message", "order").alias("message")),
    }


def xlsx_tables(detected: DataFrame, staging: str, limits: Limits = DEFAULT, large: int = LARGE) -> dict[str, DataFrame]:
    """cells, sheets, warnings and errors. The records are staged once, by kind, in a table under staging."""
    spark = detected.sparkSession
    storage.write(xlsx_records(detected, limits, large), staging, "kind")
    return workbook.assemble(by_kind(spark.read.schema(SCHEMA).parquet(staging)), limits)
