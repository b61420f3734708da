"""Spelling variants: words that differ by one inserted, deleted or replaced character, grouped under the more frequent one.

If two words differ by one character, they share the shorter one's first half or its second half. So words are dealt out by
halves, and each task puts its words into a minimal acyclic automaton: forward, by first halves, or backward, by second halves of words
read from their end. A query walks its half exactly and completes it with one error in the rest. Each word of an
automaton has a number, its rank, which the walk adds up; so a find is a number, and ids and counts lie in plain arrays. Halves that
very many words share are cut into slices, each with an automaton of its own, and their queries go to all of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respgrid.llm.common import small, stored

LEAST_POINTS, LEAST_COUNT, RATIO = 5, 3, 2
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: One of so many runs loses a character.
ALTERED = 97
#: Words that a task counts before it hands them on; words of one automaton, of one half in one slice.
COUNTED, AUTOMATON, SLICE = 200_000, 40_000, 40_000
#: A text is searched in pieces of about so many characters.
PIECE = 1 << 20
FOUND = "id long, n long, near long, near_n long, near_word string"


# Words


def _runs(text: str) -> Iterator[str]:
    """The maximal runs of a text, lower-cased."""
    begin = 0
    while begin < len(text):
        end = begin + PIECE
        if end < len(text):
            # A run isn't cut: the piece goes on to where it ends.
            rest = RUN.match(text, end)
            end = rest.end() if rest else end
        yield from RUN.findall(text[begin:end].translate(LOWER))
        begin = end


def altered(doc: str, run: str) -> str:
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % ALTERED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(least_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def batch_of(counts: Counter[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for k in range(len(batch)):
                doc, text = (batch.column(c)[k].as_py() for c in ("doc_id", "text"))
                for word, n in Counter(_runs(text or "")).items():
                    word = altered("" if doc is None else doc, word)
                    if len(word) >= least_points:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield batch_of(total)
                    total = Counter()
        if total:
            yield batch_of(total)

    return run


def word_counts(docs: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """id, word and n of the words of all texts with so many code points and occurrences; ids rise with the words' order by code points."""
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = own.mapInArrow(_counts(least_points), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    ranged = stored(found, "word-counts").repartitionByRange("word").sortWithinPartitions("word")
    return stored(ranged.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


# Automata


class Automaton:
    """A minimal acyclic automaton of words that come in order, with the words' ranks.

    A state is a dict from a character to (next state, how many words of this state come before those beyond the character); the
    key '' stands for the word that ends here.
    """

    def __init__(self, words: list[str]):
        known: dict[tuple, tuple[dict, int]] = {}
        # The states on the latest word's path, each with its edges so far; settled ones are in known.
        path: list[list[tuple[str, dict | None, int]]] = [[]]
        last = ""

        def settle(depth: int) -> None:
            """States below depth become shared ones, the deepest first."""
            while len(path) > depth + 1:
                state = shared(path.pop())
                char = path[-1].pop()[0]
                path[-1].append((char, *state))

        def shared(edges: list[tuple[str, dict | None, int]]) -> tuple[dict, int]:
            key = tuple((c, id(to), size) for c, to, size in edges)
            if key not in known:
                made, before = {}, 0
                for c, to, size in edges:
                    made[c] = (to, before)
                    before += size
                known[key] = made, before
            return known[key]

        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            settle(common)
            for c in word[common:]:
                path[-1].append((c, None, 0))
                path.append([])
            path[-1].append(("", None, 1))
            last = word
        settle(0)
        self.root, self.size = shared(path.pop())
        self.states = len(known)

    @staticmethod
    def walk(state: dict | None, number: int, text: str) -> tuple[dict | None, int]:
        """The state after text, None if there is none, and the number so far."""
        for c in text:
            step = state.get(c)
            if step is None:
                return None, 0
            state, number = step[0], number + step[1]
        return state, number

    def number(self, word: str) -> int | None:
        state, number = self.walk(self.root, 0, word)
        return number + state[""][1] if state and "" in state else None

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with word's first characters, so many, and then have one character replaced or one more.

        One character less isn't searched: such a word finds this one when it is the query.
        """
        found: set[int] = set()
        state, number = self.walk(self.root, 0, word[:exact])
        if state is None:
            return found

        def complete(state: dict, number: int, rest: str) -> None:
            end, number = self.walk(state, number, rest)
            if end is not None and "" in end:
                found.add(number + end[""][1])

        for at in range(exact, len(word) + 1):
            here = word[at : at + 1]
            for c, (to, before) in state.items():
                if c:
                    complete(to, number + before, word[at:])
                    if here and c != here:
                        complete(to, number + before, word[at + 1 :])
            if here:
                step = state.get(here)
                if step is None:
                    return found
                state, number = step[0], number + step[1]
        return found


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by automaton, first its words in order, then the queries to it -> rows of FOUND, both ways for words that differ in length."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    current, words, ids, counts, automaton = None, [], [], [], None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows: list[tuple] = []
    for batch in batches:
        for place, query, backward, word, exact, key, n in zip(*(batch.column(c).to_pylist() for c in ("automaton", "query", "backward", "word", "exact", "id", "n")), strict=True):
            if place != current:
                current, words, ids, counts, automaton = place, [], [], [], None
            if not query:
                if not words or words[-1] != word:
                    words.append(word)
                    ids.append(key)
                    counts.append(n)
                continue
            if automaton is None:
                automaton = Automaton(words)
            for k in automaton.one_error(word, exact):
                other = words[k][::-1] if backward else words[k]
                rows.append((key, n, ids[k], counts[k], other))
                if len(other) > len(word):
                    rows.append((ids[k], counts[k], key, n, word[::-1] if backward else word))
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
    if rows:
        yield batch_of(rows)


def near_words(words: DataFrame, automaton: int = AUTOMATON, most: int = SLICE) -> DataFrame:
    """FOUND: each pair of words (id, word, n; stored) that differ by one character, in both directions, once each.

    automaton and most: words of an automaton, and of one half in one slice, at most but for chance; any number gives the same rows.
    """
    n = F.length("word")
    half = lambda q: F.floor(q / 2).cast("int")
    sides = []
    for backward in (False, True):
        text = F.reverse("word") if backward else F.col("word")
        # A query of q characters shares q // 2 from the front, or the other q - q // 2 from the end; words of q and q + 1 characters can answer.
        exact = lambda q: q - half(q) if backward else half(q)  # noqa: E731, B023
        row = lambda query, q: F.struct(F.lit(query).alias("query"), q.cast("int").alias("q"), exact(q).alias("exact"))  # noqa: E731, B023
        placed = words.select("id", "n", F.lit(backward).alias("backward"), text.alias("word"), F.explode(F.array(row(True, n), row(False, n), row(False, n - 1))).alias("r"))
        sides.append(placed.select("id", "n", "backward", "word", "r.*").withColumn("half", F.substring("word", 1, F.col("exact"))))
    rows = sides[0].unionByName(sides[1])
    key = ["backward", "q", "half"]
    crowded = rows.where("not query").groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most)
    crowded = small(stored(crowded.select(*key, F.ceil(F.col("size") / most).cast("int").alias("slices")), "crowded-halves"))
    cut = rows.join(crowded, key, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("slices").cast("long"))
    slices = F.when(F.col("query"), F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)).otherwise(F.array(own))
    dealt = cut.withColumn("slice", F.explode(slices))
    places = max(1, -(-words.count() * 4 // automaton))
    # Halves without number share an automaton; a find that its half didn't call for is as true.
    dealt = dealt.withColumn("automaton", F.pmod(F.xxhash64(*key, "slice"), F.lit(places)).cast("int") * 2 + F.col("backward").cast("int"))
    sorted_rows = dealt.select("automaton", "query", "backward", "word", "exact", "id", "n").repartition("automaton").sortWithinPartitions("automaton", "query", "word")
    # A pair can be found from both sides, or twice where a character repeats. Both steps below have a word's finds together.
    return sorted_rows.mapInArrow(_near, FOUND).repartition("id").dropDuplicates(["id", "near"])


# Groups


def roots(links: DataFrame) -> DataFrame:
    """id and root of the words that have a form (id, to): the last that one comes to by going on from form to form.

    A form has at least twice its word's count, so that ways are short; each round doubles the steps taken.
    """
    now = stored(links.select("id", F.col("to").alias("root")), "roots")
    while True:
        step = small(now.select(F.col("id").alias("root"), F.col("root").alias("further")))
        moved = now.join(step, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = stored(moved, "roots")
        now = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return now


def variant_groups(docs: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the texts (doc_id, text).

    A word's form is its near word of the largest count, of several the first by code points, if that count is at least ratio times its own.

    Defined cases: a null or empty text has no words; a null doc_id counts as an empty one where runs are altered; repeated rows
    count each; no word at all gives an empty result. Further columns are ignored. A text is searched as a whole, however long.
    """
    if ratio < 2:
        raise ValueError("forms must have at least twice their words' counts, else they may go round in circles")
    words = word_counts(docs, least_points, least_count)
    near = near_words(words).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("earlier"), "near_word")).alias("best"), F.first("n").alias("n"))
    forms = F.col("best.near_n") >= ratio * F.col("n")
    chosen = stored(near.select("id", "n_near", *[F.when(forms, c).alias(a) for c, a in ((-F.col("best.earlier"), "to"), (F.col("best.near_word"), "form"), (F.col("best.near_n"), "form_n"))]), "forms")
    last = roots(chosen.where("to is not null"))
    named = last.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    rows = words.join(chosen.drop("to"), "id", "left").join(named, "id", "left")
    return rows.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
