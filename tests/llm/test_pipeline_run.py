"""run() as a whole against a plain version, and the mixture's part in its rows."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from respgrid.llm import mixing
from respgrid.llm.queries import tokenizer
from tokenizers import Tokenizer

from test_operators import plain_fingerprint, words
from test_pipeline import COLUMNS

BLOCK, RANGE = 2, 32


@pytest.fixture
def table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", BLOCK)
    monkeypatch.setattr(corpus_pipeline, "RANGE", RANGE)
    clean = [(i, words(60 + i * 37 % 900, 1000 + i), "en", "aaab"[i % 4], 1) for i in range(160)]
    clean.append((160, words(9000, 7), "en", "a", 1))
    copies = [(500 + i, clean[i][1].replace(" ", "  ", 3), "en", "b", 1) for i in range(10)]
    short = [(600, "too short", "en", "b", 1), (601, None, "en", "b", 1)]
    spark.createDataFrame(clean + copies + short, COLUMNS).repartition(5).write.parquet(f"file://{tmp_path}/documents.parquet")
    # What the first three stages keep: whole texts, of exact copies the longest, no near copies.
    kept = clean[10:] + copies
    prints = [plain_fingerprint(r[1]) for r in kept]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    return f"file://{tmp_path}", kept


def plain_mix(spark, rows):
    """doc_ids in the mixture's order: each source's blocks, earliest deadline first, until all are dealt."""
    hashed = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, source string").select("*", F.xxhash64("doc_id").alias("h")).collect()
    queues = {s: [r["doc_id"] for r in sorted((x for x in hashed if x["source"] == s), key=lambda r: ((r["h"] % 2**64 >> 20) % mixing.PARTS, r["h"]))] for s in "ab"}
    weight = {s: len(q) ** mixing.TEMPERATURE for s, q in queues.items()}
    share = {s: max(1, round(w / sum(weight.values()) * mixing.PERIOD)) for s, w in weight.items()}
    period, done, out, t = sum(share.values()), dict.fromkeys(queues, 0), [], 0
    while len(out) < len(rows):
        ready = [(-(-(done[s] + 1) * period // share[s]), s) for s in queues if done[s] * period // share[s] <= t]
        if ready:
            s = min(ready)[1]
            out += queues[s][done[s] * BLOCK : (done[s] + 1) * BLOCK]
            done[s] += 1
        t += 1
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_run_against_plain(spark, table):
    path, kept = table
    found = corpus_pipeline.run(spark, path).collect()
    full = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    sizes = {r[0]: len(full.encode(r[1], add_special_tokens=False).ids) + 1 for r in kept}
    want = collections.Counter((d, start, min(2048, n - start), n) for d, n in sizes.items() for start in range(0, n, 2048))
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in found) == want
    place = {d: i // RANGE for i, d in enumerate(plain_mix(spark, kept))}
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    ranges = [{place[r["doc_id"]] for r in sequences[k]} for k in sorted(sequences)]
    assert all(len(x) == 1 for x in ranges)
    order = [x.pop() for x in ranges]
    assert order == sorted(order) and len(set(order)) == -(-len(kept) // RANGE)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == rows[0]["sequence_tokens"] <= 2048
    # No range takes many more sequences than its tokens fill.
    tokens = collections.Counter()
    for d, n in sizes.items():
        tokens[place[d]] += n
    assert all(order.count(k) <= -(-n // 2048) * 1.1 + 1 for k, n in tokens.items())


def test_mixture_reaches_the_rows(spark, table, monkeypatch):
    path, _ = table
    rows = rows_of(corpus_pipeline.run(spark, path))
    assert rows == rows_of(corpus_pipeline.run(spark, path))
    stages = corpus_pipeline.STAGES
    for mix in (lambda s, d, _: mixing.in_mix_order(d, {"a": 1.0, "b": 9.0}), lambda s, d, _: d):
        monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:3], ("mixing sources", mix), stages[4]])
        other = rows_of(corpus_pipeline.run(spark, path))
        assert other != rows and [r[:5] for r in other] == [r[:5] for r in rows]


def test_empty_table_and_clashing_columns(spark, table, tmp_path):
    path, kept = table
    rows = rows_of(corpus_pipeline.run(spark, path))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clashing = docs.withColumns({c: F.lit(7).cast("long") for c in ("kept", "run", "fp", "block", "slot", "offset", "class", "length", "start", "digest")})
    # A row without a doc_id, and one that is there twice.
    odd = clashing.unionByName(clashing.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(words(200, 99)))).unionByName(clashing.where("doc_id = 20"))
    odd.write.parquet(f"file://{tmp_path}/odd/documents.parquet")
    found = rows_of(corpus_pipeline.run(spark, f"file://{tmp_path}/odd"))
    assert [r[:5] for r in found if r[0] is not None] == [r[:5] for r in rows] and sum(r[0] is None for r in found) == 1
    docs.where("false").write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
