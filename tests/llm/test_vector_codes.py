"""Vector codes against a plain version."""

import random

import numpy as np
import pytest

from respgrid.llm import vector_codes
from respgrid.llm.common import stored

SCHEMA = "vec_id long, embedding array<float>, label int, weight long, part int, row long"


def plain(rows, parts, entries, rounds):
    """rows: id, vector, label -> (id, codes, error) in order, and the codebooks."""
    kept = [(i, [int(1024 * x // 1) for x in v], label) for i, v, label in rows if v and all(x is not None and abs(x) < 1e30 and x == x for x in v)]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first.setdefault(i, v)
    width = len(kept[0][1]) // parts
    books = [[first[i][p * width : (p + 1) * width] for i in sorted(first)[:entries]] for p in range(parts)]
    nearest = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(books[p], cut(v, p))[1], []).append(cut(v, p))
            for k, own in groups.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, v, label in kept:
        found = [nearest(books[p], cut(v, p)) for p in range(parts)]
        out.append((str(i), bytes(k for _, k in found), sum(d for d, _ in found), str(label)))
    return sorted(out), books


def vectors(n, seed, width=8):
    r = random.Random(seed)
    rows = [(i, [r.choice([-0.5, 0.25, 0.125, r.random()]) for _ in range(width)], r.choice([0, 1, None])) for i in range(n)]
    # A vector that a third of all rows have, whose parts are hot.
    rows += [(1000 + i, [0.125] * width, 5) for i in range(n // 2)]
    return rows


@pytest.mark.parametrize("entries", [6, 256])
def test_against_plain(spark, entries):
    odd = [(-3, None, 1), (-2, [], 1), (-1, [None] * 8, 1), (-4, [float("nan")] + [0.0] * 7, 1), (-5, [float("inf")] * 8, 2), (None, [0.5] * 8, None), (7, [0.25] * 8, 3), (-6, [3e38] * 8, 1)]
    rows = [(i, v and [None if x is None else float(x) for x in v], label) for i, v, label in vectors(60, 3) + odd]
    rows = [(i, v and [x if x is None else np.float32(x).item() for x in v], label) for i, v, label in rows]
    # Of vectors with one id that of the least packed bytes starts a codebook; the plain version takes the first, so there is none here.
    rows = [x for x in rows if x[0] != 7 or x[2] != 3]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], SCHEMA).repartition(3)
    coded, books = vector_codes.compress(df, entries=entries)
    want, plain_books = plain(rows, 4, entries, 4)
    assert sorted((str(i), bytes(c), e, str(label)) for i, label, c, e in map(tuple, coded.collect())) == want
    assert books.entries.tolist() == plain_books
    totals = {}
    for _, _, error, label in want:
        totals[label] = totals.get(label, 0) + error
    for r in vector_codes.with_label_error(stored(coded, "t")).collect():
        assert r["label_error"] == totals[str(r["label"])]


def test_large_numbers_are_exact(spark):
    r = random.Random(5)
    rows = [(i, [float(r.randrange(-200_000, 200_000)) for _ in range(4)], None) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = vector_codes.compress(df, entries=5)
    want, plain_books = plain(rows, 4, 5, 4)
    assert sorted((str(i), bytes(c), e, str(label)) for i, label, c, e in map(tuple, coded.collect())) == want and books.entries.tolist() == plain_books


def test_nothing_and_odd_shapes(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    coded, books = vector_codes.compress(empty)
    assert coded.count() == 0 and books is None and vector_codes.with_label_error(stored(coded, "t")).count() == 0
    one = spark.createDataFrame([(4, [1.0, 2.0, 3.0, 4.0]), (5, [1.0] * 8)], "vec_id long, embedding array<float>")
    coded, books = vector_codes.compress(one)  # the vector of another length drops
    assert [(r["vec_id"], bytes(r["codes"]), r["error"]) for r in coded.collect()] == [(4, bytes(4), 0)] and books.entries.shape == (4, 1, 1)
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(4, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"))
