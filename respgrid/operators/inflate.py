"""Expanding compressed bodies: a small helper that sees only rows that may be compressed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respgrid.functions import detection as D
from respgrid.limits import DEFAULT, Limits
from respgrid.operators.batches import map_batches


#: Bytes that are fed at first and at most, and bytes that come out at once.
FIRST, MOST, PART = 1 << 8, 1 << 16, 1 << 18
#: The start of a gzip member, and the least that one takes.
MEMBER, LEAST = b"\x1f\x8b\x08", 18


def parts(data: memoryview, wbits: int, limit: int) -> Iterator[bytes]:
    """What data expands to, in parts, until limit is reached; what comes after isn't looked at. A damaged or unfinished stream raises zlib.error.

    gzip members follow one another; what follows the last and isn't one is ignored. A raw stream has neither signature nor checksum, and one text in
    some ten thousand begins with what could be one, so that it must take all of data. data is fed in windows that begin small
    with each member and grow, so that what a member leaves unread is never more than about its own size: time grows with the body's length,
    however many members there are.
    """
    at, total = 0, 0
    while True:
        stream, window = zlib.decompressobj(wbits), FIRST
        while not stream.eof:
            fed = data[at : at + window]
            out = stream.decompress(fed, min(PART, limit - total))
            read = len(fed) - len(stream.unconsumed_tail) - len(stream.unused_data)
            if out:
                yield out
                total += len(out)
                if total >= limit:
                    return
            elif not read and not stream.eof:
                raise zlib.error("the stream isn't finished")
            at, window = at + read, min(2 * window, MOST)
        if wbits < 0 and at < len(data):
            raise zlib.error("bytes follow a raw stream")
        if wbits < 16 or len(data) - at < LEAST or bytes(data[at : at + 3]) != MEMBER:
            return


def _drain(data: memoryview, wbits: int, limit: int) -> bytearray | None:
    out = bytearray()
    try:
        for part in parts(data, wbits, limit):
            out += part
    except zlib.error:
        return None  # all or nothing
    return out or None


def expand_bytes(data: bytes | memoryview, limit: int) -> bytearray | None:
    """gzip by its signature; else zlib, else a raw stream. None if it won't expand or is empty."""
    view = memoryview(data)
    if len(view) > 2 and bytes(view[:2]) == MEMBER[:2]:
        return _drain(view, 31, limit)
    return _drain(view, 15, limit) or _drain(view, -15, limit)


def _one_binary(value: bytearray | pa.Buffer | None) -> pa.Array:
    """An array of this one value, which isn't copied."""
    if value is None:
        return pa.nulls(1, pa.binary())
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(struct.pack("<ii", 0, len(value))), pa.py_buffer(value)])


def expand_body(responses: DataFrame, limits: Limits = DEFAULT, limit: int | None = None) -> DataFrame:
    """responses with expanded (binary) and decompressed; bodies that aren't compressed, or are over the cap, pass by the helper."""
    most = limit or limits.inflated_bytes
    maybe = D.body_ok(F.col("body"), limits) & F.coalesce(D.is_gzip(F.col("body")) | D.mentions_compression(F.col("content_type")), F.lit(False))
    columns = responses.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):  # row by row: a batch of expanded bodies could be huge
                row = batch.slice(k, 1)
                body = row.column("body")[0].as_buffer()
                out = expand_bytes(body, most) if body is not None and len(body) else None
                extra = [_one_binary(body if out is None else out), pa.array([out is not None])]
                yield pa.RecordBatch.from_arrays([*row.columns, *extra], [*columns, "expanded", "decompressed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in responses.schema)
    inflated = map_batches(responses.where(maybe), run, f"{schema}, expanded binary, decompressed boolean")
    plain = responses.where(~maybe).select("*", F.col("body").alias("expanded"), F.lit(False).alias("decompressed"))
    return plain.unionByName(inflated)
