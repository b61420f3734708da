"""Archives, their index, lookups and range reads: round trips and the archives' own format."""

import base64
import collections
import gzip
import hashlib
import random

import pytest

from respgrid.llm import warc
from respgrid.llm.common import stored

SCHEMA = "page_id long, url string, html string, digest string, copies long, block long, line string"


def pages_of(rows):
    return [(*r, "x", 9, 9, "x") for r in rows]


def odd_pages():
    r = random.Random(4)
    rows = [(i, f"http://www{i % 3 or ''}.Site{i % 5}.example.com/p/{i}?q={i % 7}#top", f"<p>page {i % 40}\r\n\r\n</p>" * (1 + i % 4)) for i in range(300)]
    rows += [(900 + i, "http://hot.example.org/", "the same") for i in range(120)]
    rows += [(5, rows[5][1], rows[5][2])] * 3 + [(2000, "http://hot.example.org/", "the same")] * 2
    rows += [(-7, "http://a b.example/\r\nWARC-Type: response", None), (None, None, None), (3000, None, ""), (None, "not a url", "WARC/1.1\r\n\r\nWARC-Type: revisit\r\n\r\n"), (3001, "http://[bad", "é" * 50_000)]
    r.shuffle(rows)
    return rows


def plain(rows, least=0):
    groups = collections.defaultdict(list)
    for page, url, html in rows:
        payload = (html or "").encode()
        groups[payload].append(page)
    out = []
    for payload, ids in groups.items():
        top = max(ids, key=lambda x: (x is not None, x or 0))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids.remove(top)
        out.append((top, len(payload), digest, "response", None))
        out += [(x, len(payload), digest, *(("revisit", top) if len(payload) >= least else ("response", None))) for x in ids]
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, least, tmp_path):
    rows = odd_pages()
    df = spark.createDataFrame(pages_of(rows), SCHEMA).repartition(5)
    manifest = warc.write_archives(df, f"file://{tmp_path}/warc", archive_bytes=4000, least_bytes=least)
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(rows) and manifest.count() > 5
    found = stored(warc.captures(manifest), "captures")
    index = warc.build_index(found, block_lines=7)
    assert index.blocks.count() >= len(rows) // 7
    # By id: every page, in slices of the directory.
    for slices in (10, 100_000):
        hits = stored(warc.lookup(index, df.select("url", "page_id"), directory_rows=slices), "hits")
        got = warc.read_records(hits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(str(tuple(r)) for r in got) == plain(rows, least)
    # By url only: all captures of it, however spelled.
    asked = spark.createDataFrame([("https://HOT.example.org:443/",), ("http://nowhere.example/",), ("http://site1.example.com/p/1?q=1",)], "url string")
    got = warc.read_records(stored(warc.lookup(index, asked), "hits")).collect()
    assert len(got) == 122 + 1 and {r["url"] for r in got if r["page_id"] == 1} == {rows[[x[0] for x in rows].index(1)][1]}
    texts = {x[2] or "" for x in rows}
    assert all(bytes(r["payload"]).decode() in texts for r in got if r["record_type"] == "response")


def test_archives_are_gzip_members(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.example/", "one"), (2, "http://b.example/", "one"), (3, "http://c.example/", "two")], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(df, f"{tmp_path}/warc")  # without a scheme: Hadoop's default, which is this machine here
    ((path, n, size),) = map(tuple, manifest.collect())
    data = open(path.removeprefix("file://"), "rb").read()
    assert n == 3 and size == len(data)
    text = gzip.decompress(data).decode()
    assert text.count("WARC/1.1\r\n") == 3 and text.count("WARC-Type: revisit") == 1 and text.count("\r\n\r\none\r\n\r\n") == 1
    for r in warc.captures(manifest).collect():
        member = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]).decode()
        assert member.startswith("WARC/1.1\r\n") and member.endswith("\r\n\r\n") and r["payload_digest"] in member


def test_damage_is_noticed():
    good = warc.record(1, "http://a/", b"payload", warc.base32(hashlib.sha1(b"payload").digest()), None, 0)
    assert warc.parsed(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


def test_keys():
    assert warc.surt("http://www.Example.com:80/A?b=1#c") == warc.surt("https://example.com/A?b=1") == "com,example)/A?b=1"
    assert warc.surt("http://a.b.example.org:8080") == "org,example,b,a:8080)/" and warc.surt(None) == ")/" and warc.surt("http://[bad") == "http://[bad"


def test_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    manifest, index = warc.archived(empty)
    assert manifest.count() == 0 and index.directory.count() == 0
    hits = stored(warc.lookup(index, empty.select("url", "page_id")), "hits")
    assert warc.read_records(hits).count() == 0


def test_long_lines_in_the_directory(spark):
    stem = "http://example.com/" + "x" * 700
    rows = [(i, f"{stem}{i % 50:03d}", f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    _, index = warc.archived(df)
    small = warc.build_index(stored(warc.captures(warc.write_archives(df)), "c"), block_lines=3)
    for x in (index, small):
        hits = warc.lookup(x, df.select("url", "page_id"))
        assert hits.count() == 200 and hits.select("line").distinct().count() == 200
