"""Spelling variants against plain versions."""

import collections
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from respgrid.llm import spelling
from respgrid.llm.common import stored


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def random_words(n, seed, letters="abcéÿ", longest=9):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, longest))) for _ in range(n)})


def test_automaton_is_minimal_and_numbers_words():
    words = random_words(600, 2)
    automaton = spelling.Automaton(words)
    assert automaton.size == len(words) and [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number("zz") is None and automaton.number(words[3] + "zzz") is None
    # As many states as there are distinct sets of endings.
    endings = collections.defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            endings[w[:i]].add(w[i:])
    assert automaton.states == len({frozenset(x) for x in endings.values()})
    for w in random_words(200, 3):
        for exact in (0, len(w) // 2):
            want = {i for i, v in enumerate(words) if len(v) >= len(w) and distance_one(w, v) and v[:exact] == w[:exact]}
            # A character before the half can double one in it: such a word is found too.
            found = automaton.one_error(w, exact)
            assert found == want
    assert spelling.Automaton([]).one_error("abc", 1) == set()


@pytest.mark.parametrize(("automaton", "most"), [(40_000, 40_000), (30, 5), (1, 1)])
def test_near_words_lose_none(spark, automaton, most):
    words = [w for w in random_words(500, 5, "abé") if len(w) >= 2]
    table = stored(spark.createDataFrame([(10 * i, w, 3 + i % 4) for i, w in enumerate(words)], "id long, word string, n long"), "w")
    got = sorted((r["id"], r["near"]) for r in spelling.near_words(table, automaton, most).collect())
    want = sorted((10 * i, 10 * k) for (i, a), (k, b) in itertools.permutations(enumerate(words), 2) if distance_one(a, b))
    assert got == want


def plain(rows, least_points=5, least_count=3):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_points and n >= least_count}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {w: (best if words[best := min(vs, key=lambda v: (-words[v], v))] >= 2 * words[w] else None) if (vs := near[w]) else None for w in words}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, str(form[w]), root(w), n, len(near[w]), str(words.get(form[w]))) for w, n in words.items())


def texts(seed):
    r = random.Random(seed)
    vocabulary = [w for w in random_words(150, seed, "aboÉéß÷", 8) if len(w) >= 4]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    rows = [(i, " ".join(r.choices(vocabulary, weights, k=200)).replace(" a", " A")) for i in range(30)]
    # A chain of forms, a hot word, and runs that end at characters outside the range.
    rows += [(50, "chainaa " * 3 + "chainab " * 6 + "chainbb " * 12 + "chaincb " * 24), (51, "hotword " * 5000), (52, "Hotword HOTWORDĀhotword hotwordx,hotwordx-hotwordx")]
    return [*rows, (53, None), (None, "nullable nullable nullable"), (54, ""), (54, "repeated repeated"), (54, "repeated repeated")]


def test_groups_against_plain(spark, monkeypatch):
    rows = texts(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "word", "n", "half", "automaton")}).repartition(4)
    for piece in (1 << 20, 50):
        monkeypatch.setattr(spelling, "PIECE", piece)
        got = sorted((w, str(f), root, n, k, str(m)) for w, f, root, n, k, m in map(tuple, spelling.variant_groups(df).collect()))
        assert got == plain(rows)
    assert ("chainaa", "chainab", "chaincb", 3, 1, "6") in got


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(empty).count() == 0
    assert spelling.variant_groups(spark.createDataFrame([(1, None), (2, "ab ab ab")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling.variant_groups(empty, ratio=1)


def test_runs_are_not_cut(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "Über-straße x" + "é" * 40 + " A,b" * 9
    assert list(spelling._runs(text)) == [x.translate(spelling.LOWER) for x in re.findall("[A-Za-zÀ-ÿ]+", text)]
