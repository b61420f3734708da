"""Language-model scoring with a hierarchical Pitman-Yor model.

Each word before another is a context with a restaurant of its own, whose dishes are the words that follow
it and whose customers are the training tokens. The tables of all restaurants are the customers of one
parent, the restaurant of the words without context, whose base is uniform over the vocabulary and one
unknown word. Gibbs sweeps seat the customers anew:

  - given a restaurant's tables T, an auxiliary g is drawn from Gamma(strength / discount + T);
  - given g and the parent's probability p of a dish, the tables t of its c customers are independent
    of all other dishes, with weights S(c, t) (discount * g * p)^t, S the generalised Stirling numbers. Up to LIMIT
    customers these are tabled and t is drawn exactly; beyond, t - 1 is drawn from the Poisson law that they go
    over to, with the mean that fits S(c, 2) / S(c, 1) (within 7 % where both are known);
  - the parent is seated in the same way, and its probabilities follow from its customers and tables.

So a sweep needs nothing but each restaurant's T and the parent's probabilities. A dish with one customer has one
table for good, so that sweeps go over pairs of count two and more. The predictive probability takes the expected
tables instead of drawn ones, sums to one over vocabulary and unknown word, and is averaged over the
samples after the burn-in. Discounts are estimated from the counts of counts, as n1 / (n1 + 2 n2).

Texts are read once, in chunks. A chunk's distinct pairs go to buckets by their context, which count them over all
chunks and send back nothing but the counts; its words go to buckets in the same way. The number of buckets, the
hashes' width and all seeds follow from the input's bytes, so that the scores are the same however rows are dealt. A bucket
holds the contexts of some BUCKET_BYTES of text: a context lies in one bucket, with at most as many dishes as there are words.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respgrid.llm import encoding
from respgrid.llm.common import remove, text_or_empty, written

#: Bytes of text in a chunk, and for which there is a bucket.
CHUNK_BYTES, BUCKET_BYTES = 16_000_000, 32_000_000
#: Buckets or chunks are dealt to so many tasks at most; a task takes one after another.
MOST_TASKS = 20_000
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
BURN_IN, SAMPLES, SEED = 2, 3, 20_231
#: Customers of a dish up to which tables are drawn exactly.
LIMIT = 128
#: The hash of the end of a text, which no word can equal as bytes: words have no blanks.
END = xxhash.xxh64_intdigest(b" ")

#: One row of any kind; what a to f hold depends on it.
ROW = "kind string, bucket int, other long, x long, y long, a binary, b binary, c binary, d binary, e binary, f binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]
FIELDS = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("other", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), *((x, pa.binary()) for x in "abcdef")])


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned whole numbers as compressed bytes, the lowest bytes of all numbers first."""
    numbers = np.ascontiguousarray(numbers, "<u8")
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return bytes([width]) + zstandard.compress(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def pack_sorted(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_floats(x: np.ndarray) -> bytes:
    """32-bit floats; many are equal."""
    return pack(np.ascontiguousarray(x, "<f4").view("<u4"))


def unpack_floats(data: bytes) -> np.ndarray:
    return unpack(data).astype("<u4").view("<f4").astype(np.float64)


def pack_samples(samples: list[np.ndarray]) -> bytes:
    """The same floats of several samples: the first, and where the others differ from it, which most don't."""
    bits = np.array([np.ascontiguousarray(x, "<f4").view("<u4") for x in samples])
    bits[1:] ^= bits[0]
    return pack(bits.ravel())


def unpack_samples(data: bytes, n: int) -> np.ndarray:
    bits = unpack(data).astype("<u4").reshape(n, -1)
    bits[1:] ^= bits[0]
    return bits.view("<f4").astype(np.float64)


class Seats:
    """Tables of dishes, given their customers and the weight of a table, for one discount."""

    def __init__(self, discount: float):
        self.discount = d = discount
        logs = np.full((LIMIT + 1, LIMIT + 2), -np.inf)
        logs[1, 1] = 0
        t = np.arange(LIMIT + 2)
        for c in range(2, LIMIT + 1):
            with np.errstate(divide="ignore", invalid="ignore"):
                stay = logs[c - 1] + np.log(np.maximum(c - 1 - t * d, 0))
            logs[c] = np.logaddexp(np.r_[-np.inf, logs[c - 1, :-1]], np.where(np.isnan(stay), -np.inf, stay))
        self.logs = logs

    def _shares(self, customers: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dishes of equal customers (2 to LIMIT) at a time: which, and the probabilities of 1, 2, ... tables."""
        if not len(customers):
            return
        order = np.argsort(customers, kind="stable")
        kinds, begins = np.unique(customers[order], return_index=True)
        for k, a, b in zip(kinds.tolist(), begins, [*begins[1:], len(order)], strict=True):
            if 2 <= k <= LIMIT:
                for at in range(a, b, 1 << 16):
                    some = order[at : min(b, at + (1 << 16))]
                    logs = self.logs[k, 1 : k + 1] + np.log(weight[some])[:, None] * np.arange(1, k + 1)
                    shares = np.exp(logs - logs.max(axis=1, keepdims=True))
                    yield some, shares / shares.sum(axis=1, keepdims=True)

    def _mean_beyond(self, customers: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The Poisson law's mean for dishes of more than LIMIT customers."""
        d = self.discount
        back = 0.0 if abs(d - 0.5) < 1e-9 else math.gamma(1 - d) / math.gamma(1 - 2 * d)
        return weight * (1 - back * customers.astype(float) ** -d) / d

    def drawn(self, customers: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        out = np.minimum(customers, 1).astype(np.int64)
        for some, shares in self._shares(customers, weight):
            out[some] += (np.cumsum(shares, axis=1)[:, :-1] < rng.random(len(some))[:, None]).sum(axis=1)
        many = np.flatnonzero(customers > LIMIT)
        out[many] += np.minimum(rng.poisson(self._mean_beyond(customers[many], weight[many])), customers[many] - 1)
        return out

    def expected(self, customers: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.minimum(customers, 1).astype(np.float64)
        for some, shares in self._shares(customers, weight):
            out[some] = shares @ np.arange(1, shares.shape[1] + 1)
        many = np.flatnonzero(customers > LIMIT)
        out[many] += np.minimum(self._mean_beyond(customers[many], weight[many]), customers[many] - 1.0)
        return out


def estimated_discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice), 0.3), 0.95) if once else 0.75


class Chunk:
    """The words of some texts, sorted by hash, and their tokens."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray):
        self.words, self.tokens, self.sizes, self.held = words, tokens.astype(np.int32), sizes, held
        self.ends = np.cumsum(sizes)
        codes = np.empty(len(tokens), np.int64)
        codes[1:] = self.tokens[:-1]
        # The end is the context of each text's first token.
        codes[np.r_[0, self.ends[:-1]]] = int(np.searchsorted(words, np.uint64(END)))
        codes *= len(words)
        codes += self.tokens
        codes, at = np.unique(codes, return_inverse=True)
        self.at, self.n_pairs = at.astype(np.int32), len(codes)
        self.context, self.word = (codes // len(words)).astype(np.int32), (codes % len(words)).astype(np.int32)

    @classmethod
    def of(cls, texts: pa.Array, held: np.ndarray) -> Chunk:
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = parts.flatten()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))[real]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        hashes = np.array([*(xxhash.xxh64_intdigest(w) for w in pc.cast(coded.dictionary, pa.binary()).to_pylist()), END], np.uint64)
        sizes = np.bincount(row, minlength=len(texts)) + 1
        inner = np.ones(int(sizes.sum()), bool)
        inner[np.cumsum(sizes) - 1] = False
        words, rank = np.unique(hashes, return_inverse=True)
        tokens = np.full(len(inner), rank[-1], np.int64)
        tokens[inner] = rank[coded.indices.to_numpy()]
        return cls(words, tokens, sizes, held)

    def cuts(self, buckets: int) -> np.ndarray:
        """Where the words of each bucket begin; a last number ends the last."""
        bucket = (self.words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return np.searchsorted(bucket, np.arange(buckets + 1))

    def rows(self, name: int, buckets: int, shift: int, ids: bytes, nulls: np.ndarray) -> Iterator[dict]:
        training = np.repeat(~self.held, self.sizes)
        counts = np.bincount(self.at[training], minlength=self.n_pairs)
        word_counts = np.bincount(self.tokens[training], minlength=len(self.words))
        # Frequent words get the small numbers: they compress better.
        order = np.argsort(-np.bincount(self.tokens, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        flags = self.held + 2 * nulls
        yield {"kind": "texts", "bucket": -1, "other": name, "a": ids, "b": pack(flags), "c": pack(self.sizes), "d": pack(rank[self.tokens]), "e": pack_sorted(self.words), "f": pack(order)}
        cuts = self.cuts(buckets)
        pair_cuts = np.searchsorted(self.context, cuts)
        short = self.words >> np.uint64(shift)
        for k, (a, b, x, y) in enumerate(zip(cuts[:-1], cuts[1:], pair_cuts[:-1], pair_cuts[1:], strict=True)):
            if b > a:
                yield {"kind": "words", "bucket": k, "other": name, "a": pack_sorted(self.words[a:b]), "b": pack(word_counts[a:b])}
            if y > x:
                contexts, each = np.unique(self.context[x:y], return_counts=True)
                dishes, which = np.unique(self.word[x:y], return_inverse=True)
                begins = np.r_[0, np.cumsum(each)[:-1]]
                steps = np.diff(which, prepend=0)
                steps[begins] = which[begins]
                yield {"kind": "pairs", "bucket": k, "other": name, "a": pack_sorted(short[contexts]), "b": pack(each), "c": pack_sorted(short[dishes]), "d": pack(steps), "e": pack(counts[x:y])}


def _free() -> None:
    """Gives back what Arrow keeps for later: workers live on through stages whose memory is another's."""
    pa.default_memory_pool().release_unused()


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{c: r.get(c) for c in NAMES} for r in rows], FIELDS)


def _chunks(buckets: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in encoding.slices(whole, at_once=CHUNK_BYTES):
                found = Chunk.of(encoding.filled(batch), batch.column("held").to_numpy(zero_copy_only=False))
                ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy().astype("<i8").tobytes()
                nulls = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                yield _batch(list(found.rows((task << 32) + number, buckets, shift, ids, nulls)))
                number += 1
                del found
                _free()

    return run


def _by_kind(*tables: pa.Table) -> tuple[int, dict[str, list[dict]]]:
    """The bucket, and its rows by kind in the order of other."""
    out: dict[str, list[dict]] = defaultdict(list)
    for table in tables:
        for r in table.to_pylist():
            out[r["kind"]].append(r)
    bucket = next(r["bucket"] for rows in out.values() for r in rows)
    return bucket, {k: sorted(rows, key=lambda r: r["other"]) for k, rows in out.items()}


def _joined(rows: list[dict], column: str, of: Callable[[bytes], np.ndarray] = unpack) -> np.ndarray:
    return np.concatenate([of(r[column]) for r in rows]) if rows else np.empty(0, np.uint64)


def _sliced(buckets: int, width: int, short: np.ndarray) -> np.ndarray:
    """Where the short hashes of each bucket begin and end in a sorted list."""
    bits = np.uint64(8 * width - 32)
    return np.searchsorted((short >> bits) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def _merged(buckets: int, width: int):
    """Pairs of all chunks -> counts for each chunk, the contexts, the pairs that are sampled, and what else their words need."""

    def run(table: pa.Table) -> pa.Table:
        bucket, kinds = _by_kind(table)
        rows = kinds["pairs"]
        owns, lists = [unpack_sorted(r["a"]) for r in rows], [unpack_sorted(r["c"]) for r in rows]
        context, dish = np.unique(np.concatenate(owns)), np.unique(np.concatenate(lists))
        codes, counts = [], []
        for r, own, listed in zip(rows, owns, lists, strict=True):
            each, steps = unpack(r["b"]).astype(np.int64), unpack(r["d"]).astype(np.int64)
            # Steps start anew in each context.
            sums, begins = np.cumsum(steps), np.r_[0, np.cumsum(each)[:-1]]
            which = sums - np.repeat(sums[begins] - steps[begins], each)
            codes.append(np.repeat(np.searchsorted(context, own) * len(dish), each) + np.searchsorted(dish, listed)[which])
            counts.append(unpack(r["e"]))
        ends = [len(x) for x in codes]
        codes, at = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(codes)).astype(np.int64)
        out = [{"kind": "counts", "bucket": bucket, "other": r["other"], "a": pack(n[x])} for r, x in zip(rows, np.split(at, np.cumsum(ends)[:-1]), strict=True)]
        of, word = codes // len(dish), codes % len(dish)
        single = n == 1
        customers = np.bincount(of, n, len(context))
        alone = np.bincount(of[single], minlength=len(context))
        some = np.flatnonzero(n > 1)
        lively, at_lively = np.unique(of[some], return_inverse=True)
        moving, at_moving, often = np.unique(word[some], return_inverse=True, return_counts=True)
        out.append({"kind": "contexts", "bucket": bucket, "other": 0, "a": pack_sorted(context), "b": pack(customers), "c": pack(alone), "d": pack_sorted(lively)})
        out.append({"kind": "state", "bucket": bucket, "other": 0, "a": pack(at_lively), "b": pack(at_moving), "c": pack(n[some]), "d": pack(alone[lively])})
        out.append({"kind": "seen", "bucket": bucket, "other": 0, "x": int(single.sum()), "y": int((n == 2).sum())})
        # Words go to the buckets of their own hashes.
        once = np.bincount(word[single], minlength=len(dish))
        listed = np.flatnonzero(once)
        for name, short, values in (("singles", dish[listed], once[listed]), ("moving", dish[moving], often)):
            cuts = _sliced(buckets, width, short)
            out += [{"kind": name, "bucket": k, "other": bucket, "a": pack_sorted(short[a:b]), "b": pack(values[a:b])} for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.Table.from_batches([_batch(out)])

    return run


def _vocabulary(shift: int):
    """Words of all chunks, with training counts and contexts in which they are single; where the moving words of other buckets are among them."""

    def run(table: pa.Table) -> pa.Table:
        bucket, kinds = _by_kind(table)
        words, at = np.unique(_joined(kinds.get("words", []), "a", unpack_sorted), return_inverse=True)
        counts = np.bincount(at, _joined(kinds.get("words", []), "b").astype(float), len(words)).astype(np.int64)
        short, single, least = words >> np.uint64(shift), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for r in kinds.get("singles", []):
            np.add.at(single, np.searchsorted(short, unpack_sorted(r["a"])), unpack(r["b"]).astype(np.int64))
        out = []
        for r in kinds.get("moving", []):
            place = np.searchsorted(short, unpack_sorted(r["a"]))
            np.add.at(least, place, unpack(r["b"]).astype(np.int64))
            out.append({"kind": "places", "bucket": bucket, "other": r["other"], "a": pack_sorted(place), "b": r["b"]})
        in_all = single + least
        out.append({"kind": "vocabulary", "bucket": bucket, "other": 0, "a": pack_sorted(words), "b": pack(counts)})
        out.append({"kind": "single", "bucket": bucket, "other": 0, "a": pack(single)})
        out.append({"kind": "seen", "bucket": bucket, "other": 0, "x": int((in_all == 1).sum()), "y": int((in_all == 2).sum())})
        out.append({"kind": "size", "bucket": bucket, "other": 0, "x": int(counts.sum()), "y": int((counts > 0).sum())})
        return pa.Table.from_batches([_batch(out)])

    return run


def _parent_step(seats: Seats, weight: float, sweep: int, sample: bool):
    """The parent's customers and tables, word by word, from the tables of all contexts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket, kinds = _by_kind(left, right)
        customers = unpack(kinds["single"][0]["a"]).astype(np.int64)
        places = {r["other"]: unpack_sorted(r["a"]).astype(np.int64) for r in kinds.get("places", [])}
        # The first sweep finds one table for each pair.
        tables = {r["other"]: r["a"] for r in kinds["tables"]} if "tables" in kinds else {r["other"]: r["b"] for r in kinds.get("places", [])}
        for k, place in places.items():
            np.add.at(customers, place, unpack(tables[k]).astype(np.int64))
        own = seats.drawn(customers, np.full(len(customers), weight), np.random.default_rng([SEED, 1, sweep, bucket]))
        left_over = customers - seats.discount * own
        out = [{"kind": "shares", "bucket": k, "other": bucket, "a": pack_floats(left_over[place])} for k, place in places.items()]
        out.append({"kind": "sums", "bucket": bucket, "other": 0, "x": int(customers.sum()), "y": int(own.sum())})
        if sample:
            out.append({"kind": "parent", "bucket": bucket, "other": sweep, "a": pack_floats(left_over)})
        return pa.Table.from_batches([_batch(out)])

    return run


def _context_step(seats: Seats, parent: tuple[float, float], sweep: int, sample: bool):
    """The tables of each moving pair; parent: what its probabilities have in common, and what they are divided by."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket, kinds = _by_kind(left, right)
        state = kinds["state"][0]
        of, word, customers, alone = (unpack(state[x]).astype(np.int64) for x in "abcd")
        p = (_joined(kinds.get("shares", []), "a", unpack_floats) + parent[0]) / parent[1]
        rng = np.random.default_rng([SEED, 2, sweep, bucket])
        held = unpack(kinds["held"][0]["a"]).astype(np.int64) if "held" in kinds else alone + np.bincount(of, minlength=len(alone))
        g = rng.gamma(STRENGTH / seats.discount + held)
        weight = seats.discount * g[of] * p[word]
        tables = seats.drawn(customers, weight, rng)
        out = [{"kind": "held", "bucket": bucket, "other": 0, "a": pack(alone + np.bincount(of, tables, len(alone)).astype(np.int64))}]
        sums, at = np.bincount(word, tables, len(p)).astype(np.int64), 0
        for r in kinds.get("shares", []):
            n = len(unpack(r["a"]))
            out.append({"kind": "tables", "bucket": r["other"], "other": bucket, "a": pack(sums[at : at + n])})
            at += n
        if sample:
            expected = alone + np.bincount(of, seats.expected(customers, weight), len(alone))
            out.append({"kind": "sample", "bucket": bucket, "other": sweep, "a": pack_floats(expected), "b": pack_floats(seats.discount * g)})
        return pa.Table.from_batches([_batch(out)])

    return run


def _replies(shift: int):
    """For the words of each chunk: training counts and what is left to the parent's customers; as contexts, customers, tables and weights."""

    def run(table: pa.Table) -> pa.Table:
        bucket, kinds = _by_kind(table)
        vocabulary = kinds["vocabulary"][0]
        words, counts = unpack_sorted(vocabulary["a"]), unpack(vocabulary["b"])
        left = [unpack_floats(r["a"]) for r in kinds["parent"]]
        customers, samples = np.zeros(len(words)), [(np.zeros(len(words)), np.zeros(len(words))) for _ in left]
        if "contexts" in kinds:
            r = kinds["contexts"][0]
            own, n, alone, lively = unpack_sorted(r["a"]), unpack(r["b"]), unpack(r["c"]), unpack_sorted(r["d"]).astype(np.int64)
            short = words >> np.uint64(shift)
            place = np.minimum(np.searchsorted(own, short), len(own) - 1)
            known = np.flatnonzero(own[place] == short)
            customers[known] = n[place[known]]
            for (tables, weights), s in zip(samples, kinds["sample"], strict=True):
                t, w = alone.astype(float), np.zeros(len(own))
                t[lively], w[lively] = unpack_floats(s["a"]), unpack_floats(s["b"])
                tables[known], weights[known] = t[place[known]], w[place[known]]
        out = []
        for r in kinds["words"]:
            at = np.searchsorted(words, unpack_sorted(r["a"]))
            out.append({
                "kind": "replies", "bucket": bucket, "other": r["other"], "a": pack(counts[at]), "b": pack(customers[at]),
                "c": pack_samples([x[at] for x in left]), "d": pack_samples([t[at] for t, _ in samples]), "e": pack_samples([w[at] for _, w in samples]),
            })
        return pa.Table.from_batches([_batch(out)])

    return run


def predictive(seats: Seats, counts: np.ndarray, customers: np.ndarray, root: np.ndarray, rest: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each pair's probability in one sample, from its count, the parent's probability of its word, and its context's customers, open seats and weight."""
    some = np.flatnonzero(counts > 1)
    tables = np.minimum(counts, 1).astype(float)
    tables[some] = seats.expected(counts[some], weight[some] * root[some])
    return (counts - seats.discount * tables + rest * root) / (STRENGTH + customers)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(seats: Seats, train_tokens: int, vocabulary: int, parents: list[tuple[float, float]]):
    def run(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        del table
        _free()
        text = found[0]  # its bucket is -1
        ids, flags, sizes = np.frombuffer(text["a"], "<i8"), unpack(text["b"]).astype(int), unpack(text["c"]).astype(np.int64)
        held = (flags & 1) == 1
        chunk = Chunk(unpack_sorted(text["e"]), unpack(text["f"]).astype(np.int64)[unpack(text["d"]).astype(np.int64)], sizes, held)
        replies = [r for r in found if r["kind"] == "replies"]
        by_sample = lambda c: np.concatenate([unpack_samples(r[c], len(parents)) for r in replies], axis=1)
        c, customers = _joined(replies, "a").astype(np.int64), _joined(replies, "b").astype(np.int64)
        counts = _joined([r for r in found if r["kind"] == "counts"], "a").astype(np.int64)
        of, word, total = chunk.context, chunk.word, np.zeros(len(counts))
        for left, tables, weight, (shared, size) in zip(by_sample("c"), by_sample("d"), by_sample("e"), parents, strict=True):
            root, rest = (left + shared) / size, STRENGTH + seats.discount * tables
            total += predictive(seats, counts, customers[of], root[word], rest[of], weight[of])
        p = np.log10(total / len(parents))
        base = np.log10((c + 0.5) / (train_tokens + 0.5 * (vocabulary + 1)))
        starts = np.r_[0, chunk.ends[:-1]]
        columns = {
            "doc_id": pa.array(ids, mask=flags >= 2),
            "held_out": pa.array(held),
            "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.add.reduceat((c > 0)[chunk.tokens].astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(ids), train_tokens)),
            "base_score": pa.array(np.add.reduceat(base[chunk.tokens], starts)),
            "score": pa.array(np.add.reduceat(p[chunk.at], starts)),
        }
        return pa.table(columns)

    return run


def score_texts(docs: DataFrame, held_out: str = "held") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out names a boolean column; texts where it is false are learnt from, all texts are scored. Tokens are the
    words, A-Z lower-cased, and one end. n_known counts tokens that training has; base_score is the sum over tokens of
    log10((c + 0.5) / (N + 0.5 (V + 1))) with a token's count c, all training tokens N and distinct ones V;
    score is the model's log10 probability.

    Defined cases: a null or empty text is its end alone; a null in held_out is false; rows that repeat a
    doc_id are learnt from and scored each for itself; a null doc_id stays null; without training texts
    every token is unknown and has the base's probability. An empty table gives an empty result. Further
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held"), text_or_empty().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
    if size is None:
        return spark.createDataFrame([], SCORES)
    buckets = -(-size // BUCKET_BYTES) or 1
    width = min(8, max(5, -(-(size.bit_length() + 10) // 8)))
    shift = 64 - 8 * width
    kind = lambda df, *names: df.where(F.col("kind").isin(*names)).select(*NAMES)

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = written(df, name, ["kind"], "none")
        return spark.read.schema(ROW).parquet(path), path

    def sums(df: DataFrame, name: str) -> tuple[int, int]:
        x, y = kind(df, name).agg(F.sum("x"), F.sum("y")).first()
        return x or 0, y or 0

    # A task for each bucket, whatever their hashes, as long as there aren't too many.
    tasks = min(buckets, MOST_TASKS)
    spread = lambda df: df.repartitionByRange(tasks, "bucket")
    chunks, path = kept(rows.mapInArrow(_chunks(buckets, shift), ROW), "lm-chunks")
    pairs, _ = kept(spread(kind(chunks, "pairs")).groupBy("bucket").applyInArrow(_merged(buckets, width), ROW), "lm-pairs")
    remove(spark, f"{path}/kind=pairs")
    seats = Seats(estimated_discount(*sums(pairs, "seen")))
    own = kind(chunks, "words").unionByName(kind(pairs, "singles", "moving"))
    words, _ = kept(spread(own).groupBy("bucket").applyInArrow(_vocabulary(shift), ROW), "lm-words")
    (train_tokens, vocabulary), parent_seats = sums(words, "size"), Seats(estimated_discount(*sums(words, "seen")))

    # What each sweep reads stays where it is.
    dealt = lambda df: df.repartition(tasks, "bucket").persist(StorageLevel.DISK_ONLY)
    state, single = dealt(kind(pairs, "state")), dealt(kind(words, "single", "places"))
    tables = held = spark.createDataFrame([], ROW)
    samples, parents, parent_tables = [], [], vocabulary
    for sweep in range(BURN_IN + SAMPLES):
        sample = sweep >= BURN_IN
        g = np.random.default_rng([SEED, 0, sweep]).gamma(PARENT_STRENGTH / parent_seats.discount + parent_tables)
        seat = _parent_step(parent_seats, parent_seats.discount * g / (vocabulary + 1), sweep, sample)
        above, _ = kept(single.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(seat, ROW), "lm-parent")
        customers, parent_tables = sums(above, "sums")
        parent = ((PARENT_STRENGTH + parent_seats.discount * parent_tables) / (vocabulary + 1), PARENT_STRENGTH + customers)
        given = kind(above, "shares").unionByName(held)
        below, _ = kept(state.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(_context_step(seats, parent, sweep, sample), ROW), "lm-tables")
        tables, held = kind(below, "tables"), kind(below, "held")
        if sample:
            samples += [kind(above, "parent"), kind(below, "sample")]
            parents.append(parent)
    state.unpersist()
    single.unpersist()

    asked = kind(chunks, "words").unionByName(kind(words, "vocabulary")).unionByName(kind(pairs, "contexts"))
    for df in samples:
        asked = asked.unionByName(df)
    replies = spread(asked).groupBy("bucket").applyInArrow(_replies(shift), ROW)
    told = kind(chunks, "texts").unionByName(kind(pairs, "counts")).unionByName(replies)
    n_chunks = kind(chunks, "texts").count()
    return told.repartitionByRange(min(n_chunks, MOST_TASKS), "other").groupBy("other").applyInArrow(_scores(seats, train_tokens, vocabulary, parents), SCORES)


def one_fifth(docs: DataFrame) -> DataFrame:
    """docs with held: whether crc32 of doc_id as text leaves 1 when divided by 5."""
    return docs.withColumn("held", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))
