"""The pipeline's stages against plain versions of what they should keep."""



import corpus_pipeline

from test_operators import plain_fingerprint, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    clean = [(i, words(60 + i % 50, 1000 + i), "en", "ab"[i % 2], 1) for i in range(120)]
    copies = [(500 + i, clean[i][1].replace(" ", "  ", 3), "en", "a", 1) for i in range(10)]
    short = [(600, "too short", "en", "b", 1), (601, None, "en", "b", 1)]
    docs = spark.createDataFrame(clean + copies + short, COLUMNS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), COLUMNS)
        assert docs.columns == before.columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k == 0:
            assert not ids & {600, 601} and set(range(120)) <= ids
        if k == 1:
            # The copies have more code points, so that they stay and their sources go.
            assert ids == set(range(10, 120)) | set(range(500, 510))
        if k == 2:
            fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in before.collect()}
            lone = {d for d in fps if all((fps[d] ^ fps[e]).bit_count() > 4 for e in fps if e != d)}
            assert lone <= ids
        if k == 3:
            assert ids == {r["doc_id"] for r in before.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r["doc_id"] for r in pieces.collect()} == ids

