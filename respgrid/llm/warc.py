"""WARC archives and a two-level index of their captures.

Tasks write archives of gzipped records, each record a member of its own. Of records with equal payloads one is the response, others
revisit it. An indexer walks the archives; its lines - host reversed, path, id, place - are sorted in ranges and cut into compressed blocks, and
a sparse directory keeps each block's first line. A lookup finds its blocks by binary search in the directory, its lines by binary
search in the block, and then reads the ranges of bytes that they name. Files are reached by pyarrow.fs, so that archives can lie in any store it knows
(file, hdfs, s3, gs, abfs); a file that a lost task leaves behind is in no manifest, and nothing reads it.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respgrid.llm.common import shared_dir, small, stored

#: A new archive begins beyond so many bytes; so many lines are a block of the index; so many blocks are searched at once, by so much of their lines.
ARCHIVE_BYTES, BLOCK_LINES, DIRECTORY_ROWS, LINE_CHARS = 1 << 28, 3000, 100_000, 512
#: Stands for a null id, which is less than any other.
NO_ID = -(2**63)
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, n_records long, n_bytes long"
CAPTURE = "line string, archive string, offset long, length long, record_type string, payload_digest string, payload_bytes long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _with_scheme(spark: SparkSession, folder: str) -> str:
    """A folder that is named without a scheme lies where Hadoop's default is, for pyarrow as for Spark."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder):
        return folder
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"file://{folder}" if default.startswith("file:") else default.rstrip("/") + folder


def surt(url: str | None) -> str:
    """A url as the index sorts it: the host's names reversed, lower-cased and without www, then port, path and query. No scheme, user or fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:  # not a url: it is its own key
        return url or ""
    names = [n for n in host.split(".") if n]
    if len(names) > 2 and re.fullmatch(r"www\d*", names[0]):
        del names[0]
    at = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(names))}{at}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def line_key(key: str, page_id: int) -> str:
    """What lines sort by: the key, then the id, as text of a fixed length."""
    return f"{key} {page_id - NO_ID:016x}"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header_text(url: str) -> str:
    """A url for a header's line: control characters and blanks are escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)


def record_id(page_id: int | None, url: str, digest: str, copy: int) -> str:
    return f"<urn:page:{'' if page_id == NO_ID else page_id}:{digest}:{xxhash.xxh64_hexdigest(url.encode())}:{copy}>"


def record(page_id: int, url: str, payload: bytes, digest: str, target: tuple[int, str] | None, copy: int) -> bytes:
    """A response, or with target (the response's page_id and url) a revisit, as the bytes of an uncompressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if target else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if target else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest, copy)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if target:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*target, digest, 0)}"]
        lines += [f"WARC-Refers-To-Target-URI: {_header_text(target[1])}"] if target[1] else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """A record's fields; a response's payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: int(fields[name].split(":")[2] or NO_ID) if name in fields else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and base32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its digest says")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI", ""), "record_type": kind, "payload_digest": digest, "payload_bytes": size, "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None}


# Writing


def with_targets(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and copies (rows that are the same), with digest and the target's id and url: null for responses.

    Only ids, urls and digests are grouped; payloads move where so many are repeated that they can't be broadcast, or rows repeat.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.unhex(F.sha1("payload")))
    thin = own.withColumn("long_enough", F.octet_length("payload") >= least_bytes).groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("copies"), F.first("long_enough").alias("long_enough"))
    thin = stored(thin, "payload-digests")
    top = F.max(F.struct("page_id", "url"))
    repeated = thin.where("long_enough").groupBy("digest").agg(top.alias("top"), F.sum("copies").alias("n")).where("n > 1")
    repeated = stored(repeated.select("digest", F.col("top.page_id").alias("target_id"), F.col("top.url").alias("target_url")), "repeated-payloads")
    same = ["digest", "page_id", "url"]
    often = stored(thin.where("copies > 1").select(*same, "copies"), "repeated-rows")
    rows = own.withColumn("copies", F.lit(1).cast("long"))
    if not often.isEmpty():  # rows that are the same come as one, with their number
        held = own.join(small(often), same).groupBy(*same).agg(F.first("payload").alias("payload"), F.first("copies").alias("copies"))
        rows = rows.join(small(often.drop("copies")), same, "left_anti").unionByName(held)
    return rows.join(small(repeated), "digest", "left")


def write_archives(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = 0) -> DataFrame:
    """Archives of a record for each row of pages (page_id, url, html), and their manifest: archive (its URI), n_records, n_bytes.

    Of records with equal payloads of at least least_bytes the one with the largest page_id (then url) is a response, the others revisit it.

    Defined cases: a null html is an empty payload; a null page_id is less than all others; a null url is an empty one, and
    its record has no target URI. Of rows that repeat id, url and html the first can be the response, the others revisit. An empty table writes nothing.
    Further columns are ignored. Control characters and blanks in a url are percent-escaped.
    """
    spark = pages.sparkSession
    folder = _with_scheme(spark, path or f"{shared_dir(spark)}/llm-warc-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        out, name, n, size, done = None, "", 0, 0, []

        def end() -> None:
            nonlocal out
            if out:
                out.close()
                done.append((name, n, size))
                out = None

        for batch in batches:
            for k in range(len(batch)):
                page_id, url, payload, digest, copies, target_id, target_url = (batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "digest", "copies", "target_id", "target_url"))
                target = None if target_id is None else (target_id, target_url)
                for copy in range(copies):
                    if out is None:
                        files.create_dir(root, recursive=True)
                        name, n, size = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    # The repeats of a response revisit it.
                    refers = None if target == (page_id, url) and copy == 0 else target
                    member = zlib.compressobj(6, wbits=31)
                    data = member.compress(record(page_id, url, payload, base32(digest), refers, copy)) + member.flush()
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= archive_bytes:
                        end()
        end()
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "n_records", "n_bytes"])

    columns = ["page_id", "url", "payload", "digest", "copies", "target_id", "target_url"]
    return stored(with_targets(pages, least_bytes).select(*columns).mapInArrow(run, MANIFEST), "manifest")


# Reading


def members(stream, chunk: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream; one member is in memory at a time."""
    offset, data = 0, b""
    while data := data or stream.read(chunk):
        inflate, parts, length = zlib.decompressobj(wbits=31), [], 0
        while not inflate.eof:
            if not data and not (data := stream.read(chunk)):
                raise EOFError("an archive ends within a record")
            parts.append(inflate.decompress(data))
            length += len(data)
            data = b""
        data = inflate.unused_data
        length -= len(data)
        yield offset, length, b"".join(parts)
        offset += length


def captures(manifest: DataFrame) -> DataFrame:
    """A row of CAPTURE for each record of the archives, found by walking them; an archive is one task's at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CAPTURE.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows: list[tuple] = []
        for archive in (x for batch in batches for x in batch.column("archive").to_pylist()):
            files, at = opened(archive)
            with files.open_input_stream(at, compression=None) as stream:
                for offset, length, data in members(stream):
                    r = parsed(data)
                    rows.append((line_key(surt(r["url"]), r["page_id"]), archive, offset, length, r["record_type"], r["payload_digest"], r["payload_bytes"]))
                    if len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return manifest.select("archive").repartition("archive").mapInArrow(run, CAPTURE)


def _blocks(lines: int):
    """Sorted lines -> compressed blocks of so many, numbered in order over all tasks."""
    names = ["block", "first_line", "last_line", "n_lines", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = TaskContext.get().partitionId() << 32, []
        count = 0

        def block(some: list[tuple[str, str]]) -> pa.RecordBatch:
            nonlocal count
            data = zlib.compress("\n".join(f"{k}\t{rest}" for k, rest in some).encode(), 6)
            count += 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (base + count, some[0][0], some[-1][0], len(some), data)], names)

        for batch in batches:
            held += zip(batch.column("line").to_pylist(), batch.column("place").to_pylist(), strict=True)
            while len(held) >= lines:
                yield block(held[:lines])
                held = held[lines:]
        if held:
            yield block(held)

    return run


class CaptureIndex:
    """Sorted, compressed blocks of capture lines, and the sparse directory of their first and last lines, both stored tables."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks
        # Long lines are cut, the last to what is greater than the line, so that a directory's row has a size bound.
        cut = lambda c: F.substring(c, 1, LINE_CHARS)
        above = F.when(F.length("last_line") > LINE_CHARS, F.concat(cut("last_line"), F.lit("\U0010ffff"))).otherwise(F.col("last_line"))
        self.directory = blocks.select("block", cut("first_line").alias("first_line"), above.alias("last_line"))


def build_index(found: DataFrame, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """The index of captures (a stored table of CAPTURE's columns). Lines are ranged by key and id, so that a url with however many captures spreads."""
    lines = found.select("line", F.concat_ws("\t", "archive", "offset", "length").alias("place"))
    ranged = lines.repartitionByRange("line", "place").sortWithinPartitions("line", "place")
    return CaptureIndex(stored(ranged.mapInArrow(_blocks(block_lines), "block long, first_line string, last_line string, n_lines long, data binary"), "capture-blocks"))


def _in_directory(firsts: list[str], lasts: list[str], numbers: list[int]):
    """Queries -> a row for each block that may have their lines, by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                # Blocks that end at low or later and begin at high or sooner.
                rows += [(numbers[k], low, high) for k in range(bisect.bisect_left(lasts, low), bisect.bisect_right(firsts, high))]
            block, low, high = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(low, pa.string()), pa.array(high, pa.string())], ["block", "low", "high"])

    return run


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, its data first, then the queries that go to it -> the lines found; one block is in memory."""
    number, keys, places = None, [], []
    for batch in batches:
        out = []
        for block, data, low, high in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "low", "high")), strict=True):
            if data is not None:
                number = block
                keys, places = zip(*(x.split("\t", 1) for x in zlib.decompress(data).decode().split("\n")), strict=True)
            elif number == block:
                out += [(keys[k], *places[k].split("\t")) for k in range(bisect.bisect_left(keys, low), bisect.bisect_right(keys, high))]
        line, archive, offset, length = zip(*out, strict=True) if out else ((), (), (), ())
        numbers = [pa.array([int(x) for x in c], pa.int64()) for c in (offset, length)]
        yield pa.RecordBatch.from_arrays([pa.array(line, pa.string()), pa.array(archive, pa.string()), *numbers], ["line", "archive", "offset", "length"])


def lookup(index: CaptureIndex, queries: DataFrame, directory_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """line, archive, offset and length of the captures that queries name, each once.

    queries has url and, if only one of its captures is wanted, page_id. The directory is searched in slices of so many blocks, one after
    the other, so that what a task holds of it is bounded however many captures there are.
    """
    wanted = queries if "page_id" in queries.columns else queries.withColumn("page_id", F.lit(None).cast("long"))
    by_id = "page_id" in queries.columns

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = [], []
            for url, page_id in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                key = surt(_header_text(url or ""))
                ends = [NO_ID if page_id is None else page_id] * 2 if by_id else [NO_ID, -1 - NO_ID]
                low.append(line_key(key, ends[0]))
                high.append(line_key(key, ends[1]))
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.string()), pa.array(high, pa.string())], ["low", "high"])

    ranges = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(bounds, "low string, high string").distinct()
    ranges = stored(ranges, "lookups")
    numbered = index.directory.orderBy("block")
    n = numbered.count()
    found, after = [], -1
    for _ in range(0, n, directory_rows):
        piece = numbered.where(F.col("block") > after).limit(directory_rows).toArrow()
        numbers, firsts, lasts = (piece.column(c).to_pylist() for c in ("block", "first_line", "last_line"))
        after = numbers[-1]
        some = ranges.where((F.col("high") >= firsts[0]) & (F.col("low") <= lasts[-1]))
        at = some.mapInArrow(_in_directory(firsts, lasts, numbers), "block long, low string, high string")
        found.append(stored(at, "lookup-blocks") if n > directory_rows else at)
    none = F.lit(None).cast("string")
    rows = reduce(DataFrame.unionByName, found, ranges.where(F.lit(False)).select(F.lit(0).cast("long").alias("block"), "low", "high"))
    both = rows.select("block", F.lit(None).cast("binary").alias("data"), "low", "high").unionByName(index.blocks.select("block", "data", none.alias("low"), none.alias("high")))
    # Ascending order has nulls first: a block's data comes before its queries.
    dealt = both.repartition("block").sortWithinPartitions("block", "low")
    return dealt.mapInArrow(_in_blocks, "line string, archive string, offset long, length long")


def read_records(found: DataFrame) -> DataFrame:
    """A row of RECORD for each row of found (archive, offset, length; a stored table), each read as a range of bytes, in the order of the archive."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != uri:
                    if file:
                        file.close()
                    files, at = opened(archive)
                    uri, file = archive, files.open_input_file(at)
                r = parsed(zlib.decompress(file.read_at(length, offset), wbits=31))
                r |= {c: None if r[c] == NO_ID else r[c] for c in ("page_id", "refers_to")}
                rows.append([r[c] for c in names])
                size += r["payload_bytes"]
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if file:
            file.close()

    # A large archive is read by several tasks, each a stretch of it.
    return found.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(run, RECORD)


def archived(pages: DataFrame) -> tuple[DataFrame, CaptureIndex]:
    """The manifest of pages written to archives in the shared folder, and the index of what an indexer then finds in these."""
    manifest = write_archives(pages)
    return manifest, build_index(stored(captures(manifest), "captures"))
