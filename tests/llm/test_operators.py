"""Each operator against a plain version of itself, on small tables with all kinds of odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from respgrid.llm import exact_dedup, html_extraction, license_scan, line_dedup, mixing, ngram_quality, packing, pitman_yor, simhash, token_counts
from respgrid.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use themselves.
CLASHING = "kept long, run long, fp long, block long, lines long, offset long, __hash long, class long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_texts():
    long_line = "A line that occurs in several documents"
    base = words(60, 1)
    return [
        None, "", " \n\t", "one", "one two three", base, base, base + " ", base.replace("w1 ", "w1 "), base + " end", words(300, 2), words(300, 2) + " tail",
        f"{long_line}\nx{words(9, 3)}", f"  {long_line.upper()}\t\ny", f"{long_line}\n{long_line}\nz", f"q\r\n{long_line}", "É" * 25, "é" * 25 + "\n" + "É" * 25,
        words(5000, 4), "<|endoftext|> a  b <s> </s>", "don't STOP 123 日本語 ½ Ǆ ́x", "a ▁b", " lead", "trail ", "tab\there", "emoji 😀 \x00 end",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    rows = [(i, t, ["en", "de", None][i % 3], ["hot", "hot", "b", None][i % 4], 0) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "hot", 0), (None, "no id at all", "en", "b", 0), (None, None, None, None, None), (2**40, words(60, 1), "de", "hot", 0)]
    return spark.createDataFrame([(*r, *[7] * 8) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def listed(df):
    return [tuple(r) for r in df.collect()]


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    found = packing.packed(docs, path, with_ids=True).collect()
    want = collections.Counter((d, tuple(full.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t in listed(docs.select("doc_id", "text")))
    pieces = collections.defaultdict(list)
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= 2048 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        pieces[r["doc_id"], r["doc_tokens"], r["start"]].append(tuple(ids))
    assert sum(r["length"] for r in found) == sum(len(ids) * n for (_, ids), n in want.items())
    for (doc, ids), n in want.items():
        for start in range(0, len(ids), 2048):
            assert pieces[doc, len(ids), start].count(ids[start : start + 2048]) >= n
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"], r["padded_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length, total, padded in sorted(parts):
            assert offset == at
            at += length
        assert at == total <= 2048 and padded == (total if total & (total - 1) == 0 else 2048)
    assert packing.packed(empty, path).count() == 0


def test_patterns_place_every_piece(monkeypatch):
    r, price, duals = random.Random(3), packing._price, []
    monkeypatch.setattr(packing, "_price", lambda y, sizes, room: (duals.append(dict(zip(sizes.tolist(), y.tolist(), strict=True))), price(y, sizes, room))[1])
    for _ in range(5):
        histogram = {k: r.randrange(0, 400) for k in range(1, 257, r.randrange(1, 9))}
        plan = packing.patterns_for(histogram, 256)
        placed = collections.Counter()
        for often, pattern in plan:
            assert sum(k * v for k, v in pattern.items()) <= 256
            for k, v in pattern.items():
                placed[k] += v * often
        assert placed == collections.Counter({k: v for k, v in histogram.items() if v})
        # The last duals give the linear program's value, which no plan can go below.
        bound = sum(y * histogram[k] for k, y in duals[-1].items())
        assert bound - 1e-6 <= sum(often for often, _ in plan) <= bound * 1.005 + 5
    assert packing.patterns_for({}, 256) == []


def test_token_counts(spark, docs, empty, tmp_path):
    from sentencepiece import SentencePieceProcessor

    path, cache = tokenizer("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    model = SentencePieceProcessor(model_file=path)
    want = sorted((str(d), len((t or "").encode()), len(model.encode(t or ""))) for d, t in listed(docs.select("doc_id", "text")))
    count = lambda df: sorted((str(d), b, n) for d, b, _, n in listed(token_counts.count_tokens(df, path, cache)))
    assert count(docs) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for (t,) in listed(docs.select("text"))})
    assert count(docs) == want and spark.read.parquet(cache).count() == stored  # no miss, nothing appended
    # Two writers that ran at once have appended the same digests.
    spark.read.parquet(cache).write.mode("append").parquet(cache)
    assert count(docs) == want
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(70, "a new text")], "doc_id long, text string"))
    before = spark.read.parquet(cache).count()
    assert count(more) == sorted([*want, ("70", 10, len(model.encode("a new text")))]) and spark.read.parquet(cache).count() == before + 1
    assert count(empty) == []


def test_many_misses_are_shuffled(spark, docs, monkeypatch):
    path = tokenizer("piece_bpe_32k.model")
    few = sorted(map(str, listed(token_counts.count_tokens(docs, path).drop("text_digest"))))
    monkeypatch.setattr(token_counts, "FEW_MISSES", 0)
    assert sorted(map(str, listed(token_counts.count_tokens(docs, path).drop("text_digest")))) == few


def test_word_encoders_against_the_libraries():
    import pyarrow as pa
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from respgrid.llm import encoding

    r = random.Random(5)
    texts = ["".join(r.choice(" \n\taAbZéÉß'’st1½日😀́▁<|>.,-#") for _ in range(r.randrange(40))) for _ in range(3000)]
    ids, bounds = encoding.WordIds(tokenizer("word_bpe_49k.json"))(pa.array(texts))
    full = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert np.frombuffer(ids[a:b], "<u4").tolist() == full.encode(text, add_special_tokens=False).ids, text
    other = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    ids, bounds = encoding.WordIds(tokenizer("byte_bpe_50k.json"))(pa.array(texts))
    assert [np.frombuffer(ids[a:b], "<u4").tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [other.encode(t, add_special_tokens=False).ids for t in texts]
    model = SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    counts = encoding.PieceCounts(tokenizer("piece_bpe_32k.model"))(pa.array(texts))
    assert counts.tolist() == [len(x) for x in model.encode(texts)]


PAGE = """<html><head><title>T</title></head><body><header>Site</header><nav><a>Menu</a></nav><div class="cookie-notice">We</div>
<article><h1>A &amp; B</h1><p>One <b>two</b>
three<p>Four<br>five</p><script>x="</p>"</script><div class="ad">Buy</div><section id="comments"><p>First!</p></section><ul><li>a<li>b</ul></article>
<aside>More</aside><form>Name</form><footer>&copy;</footer></body></html>"""


def test_html(spark):
    shared = "Subscribe to our letter and never miss a thing again here"
    pages = [
        (1, "http://a/1", PAGE), (2, "http://a/2", None), (3, None, ""), (4, "http://b/1", f"<div>{shared}</div><p>Only here {words(9, 1)}"), (5, "http://b/2", f"<div>{shared}</div><p>And there {words(9, 2)}"),
        (6, "http://b/3", f"<div>{shared}</div><p>Elsewhere"), (7, "not a url", "<p>x"), (4, "http://b/1", f"<div>{shared}</div><p>Only here {words(9, 1)}"), (8, "http://c/1", f"<p>{shared}</p>"), (None, "http://c/1", "<main><p>M</main>"),
    ]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, row long, text string")
    found = collections.defaultdict(list)
    for p, _, t in listed(html_extraction.main_texts(df)):
        found[p].append(t)
    assert found[1] == ["A & B\nOne two three\nFour five\na\nb"]
    assert found[2] == found[3] == [""]
    assert found[4] == [f"Only here {words(9, 1)}"] * 2 and found[5] == [f"And there {words(9, 2)}"] and found[6] == ["Elsewhere"]
    assert found[7] == ["x"] and found[8] == [shared] and found[None] == ["M"]
    assert html_extraction.main_texts(df.where("page_id = -1")).count() == 0


def base_rules(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if counts[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_rules(spark, docs, empty):
    extra = spark.createDataFrame([(100 + i, words(80, 50 + i), "en") for i in range(40)] + [(200, "#$% " * 3 + words(60, 7), "en"), (201, (words(10, 8) + " ") * 6, "en"), (202, "ZQ#&*7@ " .join(str(i) for i in range(60)), "en")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra)
    found = ngram_quality.judged(both)
    texts = collections.defaultdict(list)
    for d, t in listed(both.select("doc_id", "text")):
        texts[d].append(base_rules(t))
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r["doc_id"]].append((*[r[c] for c in ngram_quality.COLUMNS], r["base_failed"]))
        assert not (r["kept"] and r["base_failed"])
    assert {k: sorted(v) for k, v in texts.items()} == {k: sorted(v) for k, v in got.items()}
    kept = {r["doc_id"] for r in found.where("kept").collect()}
    assert set(range(100, 140)) <= kept and not kept & {201, 202}
    assert ngram_quality.judged(empty).count() == 0


def plain_model(texts):
    """Modified Kneser-Ney probabilities by recursion over dictionaries."""
    order = ngram_quality.ORDER
    counts = {order: collections.Counter()}
    for t in texts:
        framed = b"\xff" * (order - 1) + t + b"\xfe"
        counts[order].update(framed[i : i + order] for i in range(len(framed) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    taken = {k: ngram_quality.discounts([sum(v == n for v in c.values()) for n in (1, 2, 3, 4)]) for k, c in counts.items()}
    after = {k: collections.defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)

    def p(g):
        if not g:
            return 1 / 256
        k, own = len(g), after[len(g)].get(g[:-1])
        if not own:
            return p(g[1:])
        d = taken[k]
        return (max(counts[k][g] - d[min(counts[k][g], 3)], 0) + sum(d[min(n, 3)] for n in own) * p(g[1:])) / sum(own)

    return p


def mean_by(p, text):
    framed = b"\xff" * (ngram_quality.ORDER - 1) + text + b"\xfe"
    return -sum(math.log10(p(framed[i - ngram_quality.ORDER + 1 : i + 1])) for i in range(ngram_quality.ORDER - 1, len(framed))) / (len(text) + 1)


def test_perplexity_and_bands_against_plain(spark):
    r = random.Random(4)
    texts = [(i, words(60 + i, i, 90).replace("w", r.choice(["ab", "ba"])), "en" if i % 3 else "de") for i in range(60)]
    texts += [(100, " ".join("%$#" + str(r.randrange(10**6)) for _ in range(80)), "en"), (101, " ".join(["w1 w2", "w1 w3"][r.randrange(2)] for _ in range(90)), "de"), (102, None, "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    found = {x["doc_id"]: x for x in ngram_quality.judged(docs.repartition(5)).collect()}
    p = plain_model([(t or "").encode() for _, t, _ in texts])
    for d, t, _ in texts:
        assert abs(found[d]["log_perplexity"] - mean_by(p, (t or "").encode())) < 1e-9
    for lang in ("en", "de"):
        own = [d for d, _, x in texts if x == lang and not found[d]["base_failed"]]
        value = {d: found[d]["log_perplexity"] for d in own}
        middle = np.median(list(value.values()))
        at_length = {d: (value[d] - middle) / math.sqrt(1 + ngram_quality.SHORT / len(dict((i, t) for i, t, _ in texts)[d])) for d in own}
        spread = max(1.4826 * np.median([abs(x) for x in at_length.values()]), ngram_quality.LEAST_SPREAD)
        for d in own:
            # A histogram's bins stand for the values.
            assert abs(found[d]["deviation"] - at_length[d] / spread) < (2 * ngram_quality.BIN + 0.15 * abs(at_length[d])) / spread
            assert found[d]["kept"] == (abs(found[d]["deviation"]) <= 3.5)
    assert found[100]["deviation"] > 2 and not found[102]["kept"]
    assert {d: x["log_perplexity"] for d, x in found.items()} == {x["doc_id"]: x["log_perplexity"] for x in ngram_quality.judged(docs.repartition(2)).collect()}


@pytest.mark.parametrize("chunk", [ngram_quality.CHUNK, 3000])
def test_large_models_give_the_same_figures(spark, docs, chunk):
    rows = docs.select("doc_id", "text", "lang").cache()
    model, table = ngram_quality.train(rows), ngram_quality.train(rows, 1000)
    codes, p = zip(*listed(table.select("code", "p")), strict=True)
    assert len(codes) == len(set(codes)) == len(model.orders[-1][0]) > 1000
    assert np.allclose(model.probability(np.array(codes)), p, rtol=1e-9)
    figures = lambda m: sorted((str(r["doc_id"]), r["text_hash"], *(r[c] for c in ngram_quality.COLUMNS), round(r["log_perplexity"], 9)) for r in ngram_quality.score(rows, m, chunk).collect())
    assert figures(table) == figures(model)
    nothing = rows.where("doc_id = -1")
    assert ngram_quality.score(nothing, ngram_quality.train(nothing, -1)).count() == 0


def test_kneser_ney_sums_to_one(spark):
    texts = ["abracadabra", "", "banana bandana"]
    model = ngram_quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    contexts = [b"\xff\xff\xff\xff", b"abra", b"bana", b"zzzz", b"dana"]
    for c in contexts:
        codes = np.array([int.from_bytes(c + bytes([b]), "big") for b in range(256)], np.int64)
        p = model.probability(codes)
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_exact_dedup(spark, docs, empty):
    groups = collections.defaultdict(list)
    for d, t in listed(docs.select("doc_id", "text")):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d))
    want = sorted((str(d), str(min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]), len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, _, d in g)
    found = exact_dedup.exact_groups(docs)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in found.collect()) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found.collect())
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


@pytest.mark.parametrize("weights", [None, {"hot": 0.6, "b": 0.3}])
def test_mixing(spark, docs, empty, weights):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "b").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.lit("t").alias("slot"))
    found = mixing.mixed(many, weights).collect()
    assert sorted(r["mix_position"] for r in found) == list(range(3000))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in found)
    blocks = {(r["source"], r["block"]): (r["slot"], r["target_share"]) for r in found}
    assert len({s for s, _ in blocks.values()}) == len(blocks)
    first_end = min(max(s for (src, _), (s, _) in blocks.items() if src == name) for name in {k[0] for k in blocks})
    for name in {k[0] for k in blocks}:
        slots, share = {s for (src, _), (s, _) in blocks.items() if src == name}, next(w for (src, _), (_, w) in blocks.items() if src == name)
        done = 0
        for t in range(first_end + 1):
            done += t in slots
            assert abs(done - share * (t + 1)) < 1
    order = [r["slot"] for r in sorted(found, key=lambda r: r["mix_position"])]
    assert order == sorted(order)
    assert mixing.mixed(docs, weights).count() == docs.count() and mixing.in_mix_order(docs).columns == docs.columns
    assert mixing.mixed(empty, weights).count() == 0
    odd = docs.select("doc_id", "source", *[F.lit(k).alias(c) for k, c in enumerate(["share", "period", "nth", "in_period", "start", "__rank", "__source"])])
    assert {tuple(r) for r in mixing.mixed(odd, weights).select(odd.columns[2:]).collect()} == {tuple(range(7))} and mixing.in_mix_order(odd, weights).columns == odd.columns


def test_many_sources(spark):
    """Far more sources than a period has slots for shares: all are served within their windows, and each slot once a period."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.xxhash64("id") % 2500)).alias("source"))
    found = mixing.mixed(docs).select("source", "block", "release", "slot", "deadline", "mix_position").toPandas()
    assert sorted(found["mix_position"]) == list(range(30_000))
    assert ((found["release"] <= found["slot"]) & (found["slot"] < found["deadline"])).all()
    assert found.groupby("slot")[["source", "block"]].nunique().to_numpy().max() == 1
    order = found.sort_values("mix_position")["slot"]
    assert order.is_monotonic_increasing


def plain_form(text):
    """The canonical form of a text, step by step."""
    lines = []
    for line in re.split(r"[\n\r]+", text or ""):
        if re.match(r"[^\w©(]*(?:portions )?(?:copyright|copr\.|©|\(c\))(?!\w).*(?:[12][0-9]{3}|\(c\)|©|<year>|\[yyyy\])", line, re.I) and len(line) <= 200:
            continue
        if len(line) <= 200 and re.match(r"[^\w©(]*(?:portions )?copyright\W+(?:(?:authors|contributors)|.*(?:authors|contributors))\W*$", line, re.I):
            continue
        if len(line) <= 200 and re.search("[a-z]", line) and re.match(r"[^\w©(]*[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]\W+(?:by )?(?!(?i:notice|holder|owner|law|and\b|or\b))(?:[A-Z][\w.&'’-]*[, ]*){1,6}$", line):
            continue
        if re.match(r"[^\w©(]*all rights reserved\W*$", line, re.I):
            continue
        line = re.sub(r"^\W*(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)](?=\s)", " ", line.lower())
        if plain := " ".join(re.findall(r"[^\W_]+", line)):
            for variant, one in license_scan.SPELLINGS:
                plain = re.sub(rf"(?<!\S){variant}(?!\S)", one, plain)
            lines.append(plain)
    whole = " ".join(lines)
    for variant, one in license_scan.SPELLINGS:
        if " " in variant:
            whole = re.sub(rf"(?<!\S){variant}(?!\S)", one, whole)
    return lines, whole


def test_licenses(spark, docs, empty):
    known = license_scan.registry(spark)
    built_in = license_scan.built_in()
    mit, bsd, apache = license_scan.MIT, license_scan.BSD_LIST + license_scan.BSD_NAMES + license_scan.BSD_WARRANTY, dict(built_in)["Apache-2.0"]
    apache = next(t for k, t in built_in if k == "Apache-2.0" and len(t) > 1000)
    texts = {
        900: mit, 901: "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;"), 902: "The MIT Licence (MIT)\n© 1999 X\n" + mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT"), 903: mit + " and more",
        904: "Some text\nReleased under the MIT Licence.\nMore\nreleased under the mit license", 905: license_scan.ISC, 906: "Copyright 2020 Only",
        907: "Copyright Jane Doe\n" + mit, 908: "Copyright The X Authors\nAll rights reserved.\n\n" + bsd.replace("3. ", "c) "), 909: apache.replace("\n", "\r\n").upper(), 910: "x " + apache, 911: apache * 300,
        912: mit.replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS"), 913: "This file is licensed under the LGPLv2.1.",
    }
    texts |= {2000 + i: f"Copyright (c) {1990 + i % 30} A. Person\n{t}" for i, (_, t) in enumerate(built_in)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("lines", F.lit("clash")).withColumn("digest", F.lit(1))
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(df, known).collect()}
    assert [found[i]["license_id"] for i in range(900, 914)] == ["MIT", "MIT", "MIT", None, None, "ISC", None, "MIT", "BSD-3-Clause", "Apache-2.0", None, None, "MIT", "LGPL-2.1"]
    assert found[904]["notice_ids"] == ["MIT"] and found[904]["n_notices"] == 2 and found[906]["n_notices"] == 0
    # All rows against the plain form's lookup.
    ids, notices = {}, {}
    for key, text in built_in:
        lines, whole = plain_form(text)
        ids[whole] = min(key, ids.get(whole, key))
        if len(lines) == 1:
            notices[whole] = min(key, notices.get(whole, key))
    every = df.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    want = []
    for d, t in listed(every):
        lines, whole = plain_form(t)
        hits = [notices[x] for x in lines if x in notices]
        want.append((str(d), hashlib.sha256(whole.encode()).hexdigest(), ids.get(whole), tuple(sorted(set(hits))), len(hits)))
    got = [(str(r["doc_id"]), r["text_digest"], r["license_id"], tuple(r["notice_ids"]), r["n_notices"]) for r in license_scan.scan_licenses(every, known).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert license_scan.scan_licenses(empty, known).count() == 0
    assert license_scan.scan_licenses(docs, license_scan.registry(spark, [])).where("license_id is not null or n_notices > 0").count() == 0


def test_pitman_yor(spark, docs, empty):
    texts = [(i, words(40 + i % 7, i % 90, 60) + " Rare%d" % i, None) for i in range(300)] + [(None, "null id", True), (7, None, False), (8, "  \n", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, sizes boolean").repartition(4)
    found = pitman_yor.score_texts(pitman_yor.one_fifth(df)).collect()
    tokens = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = collections.Counter(w for d, t, _ in texts if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t, _ in texts)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    out = [r for r in found if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert pitman_yor.score_texts(pitman_yor.one_fifth(empty)).count() == 0
    nothing = pitman_yor.score_texts(df.withColumn("held", F.lit(True))).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in nothing)


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 3000)
    texts = [(i, words(30 + i % 40, i % 50, 80) + " rare%d" % (i % 70)) for i in range(150)] + [(7, None), (None, "w1 w2")]
    df = pitman_yor.one_fifth(spark.createDataFrame(texts, "doc_id long, text string"))
    scores = [sorted(map(str, listed(pitman_yor.score_texts(df.repartition(n))))) for n in (1, 13)]
    assert scores[0] == scores[1] and len(scores[0]) == len(texts)


def test_predictive_sums_to_one():
    r = np.random.default_rng(2)
    for discount in (0.4, 0.5, 0.8):
        seats = pitman_yor.Seats(discount)
        counts = np.r_[r.integers(0, 5, 300), 40, 1000, 200_000]
        roots = r.dirichlet(np.full(len(counts), 0.3), 3)
        weights = np.array([3.0, 50.0, 700.0])
        tables = [np.minimum(counts, 1).astype(float) for _ in weights]
        for t, w, root in zip(tables, weights, roots, strict=True):
            t[counts > 1] = seats.expected(counts[counts > 1], w * root[counts > 1])
        rest = np.array([pitman_yor.STRENGTH + discount * t.sum() for t in tables])
        same = lambda x: np.full(len(counts), x)
        for root, open_seats, weight in zip(roots, rest, weights, strict=True):
            p = pitman_yor.predictive(seats, counts, same(counts.sum()), root, same(open_seats), same(weight))
            assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_tables_of_many_customers(monkeypatch):
    """Where exact tables end, the Poisson law takes over without a step."""
    weight = np.array([0.01, 0.1, 0.5, 1.0, 2.0, 4.0])
    for discount in (0.4, 0.6, 0.8):
        exact = pitman_yor.Seats(discount).expected(np.full(6, pitman_yor.LIMIT), weight)
        beyond = pitman_yor.Seats(discount).expected(np.full(6, pitman_yor.LIMIT + 1), weight)
        assert np.allclose(exact, beyond, rtol=0.08)
        drawn = np.mean([pitman_yor.Seats(discount).drawn(np.full(6, 30), weight, np.random.default_rng(k)) for k in range(300)], axis=0)
        assert np.allclose(drawn, pitman_yor.Seats(discount).expected(np.full(6, 30), weight), rtol=0.12)


def seated(pairs, vocabulary, discount, parent_discount, sweeps, burn_in, seed):
    """Mean predictive probabilities of a plain sampler that takes out and seats one customer after another."""
    r = random.Random(seed)
    strength, base = pitman_yor.STRENGTH, 1 / (vocabulary + 1)
    rooms = collections.defaultdict(lambda: collections.defaultdict(list))  # restaurant -> dish -> customers by table
    size = collections.defaultdict(lambda: [0, 0])  # restaurant -> customers, tables

    def below(room, dish):
        return base if room is None else p(None, dish)

    def p(room, dish):
        d, own, (n, t) = parent_discount if room is None else discount, rooms[room][dish], size[room]
        return (sum(own) - d * len(own) + (strength + d * t) * below(room, dish)) / (strength + n)

    def add(room, dish):
        d, own = parent_discount if room is None else discount, rooms[room][dish]
        x = r.random() * (sum(own) - d * len(own) + (strength + d * size[room][1]) * below(room, dish))
        for k, n in enumerate(own):
            if (x := x - (n - d)) < 0:
                own[k] += 1
                break
        else:
            own.append(1)
            size[room][1] += 1
            if room is not None:
                add(None, dish)
        size[room][0] += 1

    def take(room, dish):
        own = rooms[room][dish]
        k = r.choices(range(len(own)), own)[0]
        own[k] -= 1
        size[room][0] -= 1
        if not own[k]:
            del own[k]
            size[room][1] -= 1
            if room is not None:
                take(None, dish)

    for c, w in pairs:
        add(c, w)
    total, every = collections.Counter(), {*pairs}
    for sweep in range(sweeps):
        for c, w in pairs:
            take(c, w)
            add(c, w)
        if sweep >= burn_in:
            for c, w in every:
                total[c, w] += p(c, w) / (sweeps - burn_in)
    return total


def test_score_against_plain_sampler(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 700)
    monkeypatch.setattr(pitman_yor, "SAMPLES", 8)
    r = random.Random(8)
    texts = [(i, " ".join(f"v{min(int(r.expovariate(0.4)), 14)}" for _ in range(20))) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("held", F.lit(False))
    found = {x["doc_id"]: x["score"] for x in pitman_yor.score_texts(df.repartition(3)).collect()}
    tokens = {i: [*t.split(), "$"] for i, t in texts}
    pairs = [(c, w) for t in tokens.values() for c, w in zip(["$", *t[:-1]], t, strict=True)]
    counts = collections.Counter(pairs)
    n = collections.Counter(counts.values())
    discount = pitman_yor.estimated_discount(n[1], n[2])
    kinds = collections.Counter(w for _, w in counts)
    n = collections.Counter(kinds.values())
    p = seated(pairs, len(kinds), discount, pitman_yor.estimated_discount(n[1], n[2]), 120, 30, 1)
    for i, t in tokens.items():
        want = sum(math.log10(p[c, w]) for c, w in zip(["$", *t[:-1]], t, strict=True))
        assert abs(found[i] - want) < 0.02 * abs(want)
    assert abs(sum(found.values()) / sum(math.log10(p[c, w]) for c, w in pairs) - 1) < 0.005


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, empty):
    rows = [(d, plain_fingerprint(t)) for d, t in listed(docs.select("doc_id", "text"))]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
            parent[find(j)] = find(i)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    want = sorted((str(d), f, str(min((x for x in least[find(i)] if x is not None), default=None))) for i, (d, f) in enumerate(rows))
    found = simhash.near_groups(docs).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in found) == want
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(docs).columns == docs.columns


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_links_lose_none(spark, hot):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = list(dict.fromkeys([*base, *[b ^ sum(1 << k for k in r.sample(range(64), r.randrange(1, 7))) for b in base for _ in range(12)]]))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = dict(listed(simhash.components(simhash.links(df, hot))))
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(fps, 2):
        if (x ^ y).bit_count() <= 4:
            parent[find(y)] = find(x)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    ours = lambda x: roots.get(sign(x), sign(x))
    pairs = {(find(x), ours(x)) for x in fps}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_crowded_keys_are_cut_until_they_fit(spark):
    r = random.Random(11)
    base = r.getrandbits(63)
    fps = {base ^ sum(1 << k for k in r.sample(range(63), r.randrange(1, 3))) for _ in range(300)}
    keyed = simhash._keyed(spark.createDataFrame([(x,) for x in fps], "fp long"), 50)
    sizes = keyed.groupBy("pair", "key").count()
    assert sizes.agg(F.max("count")).first()[0] <= 50 and keyed.agg(F.max("pair")).first()[0] >= 15 + 15 * 5
    # What is linked meets under a key.
    met = collections.defaultdict(set)
    for pair, key, fp in keyed.collect():
        met[fp].add((pair, key))
    some = r.sample(sorted(fps), 120)
    assert all(met[x] & met[y] for x, y in itertools.combinations(some, 2) if (x ^ y).bit_count() <= 4)


def test_hot_keys_meet_their_values(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(100 + F.col("id")).alias("k"), "id")
    values = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.first("k") * 2).alias("twice"))
    joined = simhash._to_each(rows, values, "k", 6000)
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
    assert sorted(listed(joined.select("id", "k", "twice"))) == [(i, k, 2 * k) for i, k in ((i, 7 if i % 3 == 0 else 100 + i) for i in range(6000))]


def plain_lines(rows):
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    holders = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[low(line)].add(-(2**63) if d is None else d)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if gone.get(low(x), d) == d]
        out.append((str(d), len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark, docs, empty):
    r = random.Random(2)
    many = [(i, "\n".join(f"a shared line with the number {int(r.expovariate(0.5))}" for _ in range(r.randrange(6)))) for i in range(400)]
    df = spark.createDataFrame(many, "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id is null or doc_id > 1000000"))
    for some in (df, docs):
        found = line_dedup.kept_digests(some, line_dedup.keep_bitmaps(some))
        assert sorted((str(d), *x) for d, *x in listed(found)) == plain_lines(listed(some.select("doc_id", "text")))
    assert line_dedup.kept_digests(empty, line_dedup.keep_bitmaps(empty)).count() == 0


@pytest.mark.parametrize("batch", [1, 2, 3, 7, 100])
def test_lines_over_batches_and_partitions(batch):
    """However sorted rows are cut into partitions and batches, the same lines go."""
    import pyarrow as pa

    r = random.Random(batch)
    rows = sorted({(f"{int(r.expovariate(0.4)):016d}".encode(), -r.randrange(30), p) for p in range(120)})
    holders = collections.defaultdict(set)
    for k, d, _ in rows:
        holders[k].add(-d)
    want = {(k, -d, p) for k, d, p in rows if len(holders[k]) >= 3 and -d != max(holders[k])}
    cuts = sorted(r.sample(range(len(rows)), 3))
    cuts = [0, *[next((j for j in range(c, len(rows)) if rows[j][:2] != rows[j - 1][:2]), len(rows)) for c in cuts], len(rows)]
    drops, pending, totals = set(), [], collections.defaultdict(lambda: [0, -1])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = rows[a:b]
        table = pa.table({"line_key": pa.array([x[0] for x in part], pa.binary()), "doc_id": pa.array([-x[1] for x in part], pa.int64()), "text_hash": pa.array([0] * len(part), pa.int64()), "pos": pa.array([x[2] for x in part], pa.int32())})
        for out in line_dedup._settle(3)(iter(table.to_batches(max_chunksize=batch))):
            for x in out.to_pylist():
                place = (x["line_key"], x["doc_id"], x["pos"])
                if x["kind"] == line_dedup.DROP:
                    drops.add(place)
                elif x["kind"] == line_dedup.PENDING:
                    pending.append(place)
                else:
                    totals[x["line_key"]][0] += x["n_docs"]
                    totals[x["line_key"]][1] = max(totals[x["line_key"]][1], x["doc_id"])
    drops |= {x for x in pending if totals[x[0]][0] >= 3 and x[1] != totals[x[0]][1]}
    assert drops == want
