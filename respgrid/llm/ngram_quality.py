"""Quality rules with n-gram perplexity.

The model is a modified Kneser-Ney model of order five over UTF-8 bytes, with marks around each
text. Spark counts the n-grams of all texts; five bytes are an n-gram's hash, without collisions. Lower
orders count in how many n-grams of the next order theirs ends. The model is kept as sorted arrays of these
hashes with probabilities and back-off weights, one pair of arrays for each order, and goes out to the workers
if it has at most MOST_ENTRIES n-grams in all. A larger one stays a table: Spark joins probabilities order by order, the
texts are dealt into chunks, and each chunk gets the sorted array of its own n-grams. Figures are the same either way.

A text's figure is its mean negative log10 probability of a byte, the logarithm of its perplexity. The
bands follow each language's own distribution: of the texts that pass the base rules, the median,
plus and minus a number of deviations (the median absolute one, scaled to a normal's). Short texts spread
more widely, so that a text's deviation is measured at its own length. A text outside the band is rejected: above it
lie strange words and symbols, below it texts that say the same again and again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respgrid.llm import encoding
from respgrid.llm.common import small, stored, text_or_empty, without

#: Order of the model, and bytes of text whose n-grams are sorted at once.
ORDER, AT_ONCE = 5, 2_000_000
#: Marks before a text (ORDER - 1 times) and after it: bytes that UTF-8 never has.
BEGIN, END = 0xFF, 0xFE
#: N-grams of a model that goes out whole, all orders together: some 70 MB.
MOST_ENTRIES = 4_000_000
#: Bytes of text in a chunk, where the model is larger.
CHUNK = 64_000_000
#: Deviations that a language's band leaves below and above its median.
BELOW, ABOVE = 3.5, 3.5
#: Bytes at which a text's spread is twice the variance of a long one, and the width of a histogram's bins.
SHORT, BIN = 2500, 0.001
#: The least deviation, for languages whose texts hardly differ.
LEAST_SPREAD = 0.005
# The base rules' symbols, window and limits.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = b"[#*$%&|<>]", 8, 20, 30
SPACES = b" \t\n\v\f\r"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _framed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all n-grams that end in a text or its end mark, and where each text's begin and end."""
    joined = np.frombuffer(b"".join([bytes([BEGIN]) * (ORDER - 1) + t + bytes([END]) for t in texts]), np.uint8)
    codes = np.zeros(len(joined) - ORDER + 1, np.int64)
    for k in range(ORDER):
        codes = codes << 8 | joined[k : k + len(codes)]
    codes = codes[joined[ORDER - 1 :] != BEGIN]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return codes, np.r_[0, ends[:-1]], ends


def discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and more, given how many n-grams have counts of 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = np.zeros(4)
    for k in (1, 2, 3):
        estimate = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2
        out[k] = min(max(estimate, 0.1), k - 0.1 if k == 1 else k)
    return out


class Model:
    """Sorted codes with probabilities, and sorted contexts with what they leave to the order below, from order one up."""

    def __init__(self) -> None:
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray, counts: np.ndarray, totals: np.ndarray, taken: np.ndarray) -> None:
        """The next order: n-grams, their counts, the counts of all n-grams of their contexts, and discounts."""
        at = np.argsort(codes)
        codes, share = codes[at], (counts[at] - taken[np.minimum(counts[at], 3)]) / totals[at]
        contexts, which = np.unique(codes >> 8, return_inverse=True)
        rest = 1 - np.bincount(which, share, len(contexts))
        below = self.probability(codes & (1 << 8 * len(self.orders)) - 1)
        self.orders.append((codes, share + rest[which] * below, contexts, rest))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Of each n-gram's last byte after the others; codes have as many bytes as there are orders."""
        out, weight, at = np.full(len(codes), 1 / 256), np.ones(len(codes)), np.arange(len(codes))
        for order in range(len(self.orders), 0, -1):
            known, p, contexts, rest = self.orders[order - 1]
            if not len(known):
                continue
            own = codes[at] & (1 << 8 * order) - 1
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[place] == own
            out[at[hit]] = weight[at[hit]] * p[place[hit]]
            at, own = at[~hit], own[~hit] >> 8
            place = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            weight[at] *= np.where(contexts[place] == own, rest[place], 1)
        out[at] = weight[at] / 256
        return out


def _means(texts: list[bytes], probability: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Each text's mean negative log10 probability."""
    codes, begins, ends = _framed(texts)
    distinct, at = np.unique(codes, return_inverse=True)
    return -np.add.reduceat(np.log10(probability(distinct))[at], begins) / (ends - begins)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["code", "n"])

    for whole in batches:
        for batch in encoding.slices(whole, at_once=AT_ONCE):
            held.append(np.unique(_framed(pc.cast(encoding.filled(batch), pa.binary()).to_pylist())[0], return_counts=True))
            if sum(len(c) for c, _ in held) > MOST_ENTRIES // 4:
                held = [merged()]
                if len(held[0][0]) > MOST_ENTRIES // 8:
                    yield out()
                    held = []
    if held:
        held = [merged()]
        yield out()


def train(docs: DataFrame, most_entries: int = MOST_ENTRIES) -> Model | DataFrame:
    """The model of all texts of docs; with more n-grams than most_entries a stored table: code, p for each n-gram of the highest order."""
    level = stored(docs.select(text_or_empty().alias("text")).mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "ngrams")
    orders, entries = [], 0
    for order in range(ORDER, 0, -1):
        kinds = {r["kind"]: r["often"] for r in level.groupBy(F.least("n", F.lit(5)).alias("kind")).agg(F.count(F.lit(1)).alias("often")).collect()}
        entries += sum(kinds.values())
        # A context has at most as many n-grams as there are bytes.
        totals = level.withColumn("total", F.sum("n").over(Window.partitionBy(F.shiftright("code", 8))))
        orders.append((totals, discounts([kinds.get(k, 0) for k in (1, 2, 3, 4)])))
        level = level.groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        if entries > most_entries:
            level = stored(level, "ngrams")
    if entries > most_entries:
        return _probabilities(orders[::-1])
    model = Model()
    for totals, taken in reversed(orders):
        table = totals.toArrow()
        model.add(*(table.column(c).to_numpy() for c in ("code", "n", "total")), taken)
    return model


def _probabilities(orders: list[tuple[DataFrame, np.ndarray]]) -> DataFrame:
    """code, p of the highest order. Each n-gram's shorter one was counted too, and is that of at most as many as there are bytes."""
    below = None
    for k, (totals, taken) in enumerate(orders):
        cut = F.when(F.col("n") == 1, float(taken[1])).when(F.col("n") == 2, float(taken[2])).otherwise(float(taken[3]))
        shares = totals.withColumn("share", (F.col("n") - cut) / F.col("total"))
        shares = shares.withColumn("rest", 1 - F.sum("share").over(Window.partitionBy(F.shiftright("code", 8))))
        if below is None:
            shares = shares.withColumn("below", F.lit(1 / 256))
        else:
            shorter = below.select(F.col("code").alias("shorter"), F.col("p").alias("below"))
            shares = shares.withColumn("shorter", F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(shorter, "shorter")
        below = stored(shares.select("code", (F.col("share") + F.col("rest") * F.col("below")).alias("p")), "probabilities")
    return below


def base_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """COLUMNS for one text."""
    marks = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    points = len(text) - int(marks[0x80:0xC0].sum()) - int(marks[list(SPACES)].sum())
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    if len(words) > WINDOW:
        ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        n = len(words) - WINDOW + 1
        windows = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] ^ (ids[k : k + n] >> np.uint64(29)))
        ordered = np.sort(windows)
        if (ordered[1:] == ordered[:-1]).any():
            _, at, often = np.unique(windows, return_inverse=True, return_counts=True)
            starts = np.flatnonzero(often[at] > 1)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + WINDOW, -1)
            repeated = int((np.cumsum(change) > 0).sum())
    return len(words), points, int(marks[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated


_IDS, _NUMBERS = ["doc_id", "lang", "text_hash"], ["n_bytes", *COLUMNS]


def _figures(batch: pa.RecordBatch, probability: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    texts = pc.cast(encoding.filled(batch), pa.binary()).to_pylist()
    means = _means(texts, probability)
    figures = [(len(t), *base_figures(t)) for t in texts]
    columns = [pa.array(x, pa.int64()) for x in zip(*figures, strict=True)]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in _IDS), *columns, pa.array(means)], [*_IDS, *_NUMBERS, "log_perplexity"])


def _score_in_chunks(rows: DataFrame, known: DataFrame, kinds: str, chunk: int) -> DataFrame:
    """rows with their figures by known (code, p). A chunk takes the n-grams that it has, so that what moves grows with the text alone."""
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = n_bytes // chunk + 1
    dealt = stored(rows.withColumn("chunk", F.floor(F.rand(1) * parts).cast("long")).repartition("chunk"), "quality-texts")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in encoding.slices(whole, at_once=AT_ONCE):
                which = batch.column("chunk").to_numpy()
                for c in np.unique(which).tolist():
                    texts = pc.cast(encoding.filled(batch.filter(pa.array(which == c))), pa.binary()).to_pylist()
                    codes = np.unique(_framed(texts)[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), c, np.int64)), pa.array(codes)], ["chunk", "code"])

    def figures(array: pa.Table, texts: pa.Table) -> pa.Table:
        at = np.argsort(array.column("code").to_numpy())
        codes, p = array.column("code").to_numpy()[at], array.column("p").to_numpy()[at]
        found = [_figures(part, lambda x: p[np.searchsorted(codes, x)]) for batch in texts.to_batches() for part in encoding.slices(batch, at_once=AT_ONCE)]
        return pa.Table.from_batches(found)

    arrays = dealt.select("chunk", "text").mapInArrow(own, "chunk long, code long").distinct().join(known, "code")
    return arrays.groupBy("chunk").cogroup(dealt.groupBy("chunk")).applyInArrow(figures, kinds)


def score(docs: DataFrame, model: Model | DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, lang, text_hash, n_bytes, COLUMNS, base_failed and log_perplexity for each row. A model that is a table has to be of these texts."""
    rows = docs.select("doc_id", "lang", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, text_hash long, {', '.join(f'{x} long' for x in _NUMBERS)}, log_perplexity double"
    if isinstance(model, Model):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in encoding.slices(whole, at_once=AT_ONCE):
                    yield _figures(batch, shared.value.probability)

        scored = rows.mapInArrow(run, kinds)
    else:
        scored = _score_in_chunks(rows, model, kinds, chunk)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed)


def _deviation() -> Column:
    """Of a text from its language's median, as it would be at great length."""
    return (F.col("log_perplexity") - F.col("middle")) / F.sqrt(1 + SHORT / F.greatest(F.col("n_bytes"), F.lit(1)))


def _weighted_median(df: DataFrame, value: Column, name: str) -> DataFrame:
    """The median of value by __lang, from a histogram with bins of BIN: a few thousand rows for a language."""
    bins = df.groupBy("__lang", F.round(value / BIN).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("__lang").orderBy("bin")
    every = Window.partitionBy("__lang")
    half = bins.select("__lang", "bin", (F.sum("n").over(upto) * 2 >= F.sum("n").over(every)).alias("past"))
    return half.where("past").groupBy("__lang").agg((F.min("bin") * BIN).alias(name))


def _bands(scored: DataFrame) -> DataFrame:
    """__lang, middle and spread, a row for each language."""
    middles = stored(_weighted_median(scored, F.col("log_perplexity"), "middle"), "middles")
    spreads = _weighted_median(scored.join(small(middles), "__lang"), F.abs(_deviation()), "spread")
    return stored(middles.join(spreads, "__lang").withColumn("spread", F.greatest(F.col("spread") * 1.4826, F.lit(LEAST_SPREAD))), "bands")


def judged(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, COLUMNS, base_failed, log_perplexity, deviation and kept.

    deviation: how many of its language's deviations the text lies from the median; null if no text of
    the language passes the base rules. kept: the base rules passed and -below <= deviation <= above.

    Defined cases: a null or empty text has no words and fails the base rules; null is a language of its own;
    rows that repeat a doc_id, or equal texts, are judged each for itself, and count as often as they are there;
    a null doc_id stays null. An empty table gives an empty result. Further columns are ignored.
    """
    scored = stored(score(docs, train(docs)), "quality").withColumn("__lang", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")))
    bands = _bands(scored.where(~F.col("base_failed")))
    with_band = scored.join(small(bands), "__lang", "left").withColumn("deviation", _deviation() / F.col("spread"))
    inside = F.coalesce(F.col("deviation").between(-below, above), F.lit(False))
    return with_band.select("doc_id", "text_hash", *COLUMNS, "base_failed", "log_perplexity", "deviation", (~F.col("base_failed") & inside).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns; rows that share a doc_id and a text have one verdict, the strictest."""
    return without(docs, judged(docs).where(~F.col("kept")))
