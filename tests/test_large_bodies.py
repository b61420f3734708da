"""Bodies in chunks give the rows and sheets that whole bodies give."""

import random

import pytest
from pyspark.sql import functions as F

from respgrid.jobs.queries import staged
from respgrid.limits import Limits
from respgrid.operators import delimited, large_bodies
from tests.test_files import machine


def detected_of(spark, texts, file_type="CSV"):
    rows = [(i, file_type, f"f{i}.csv" if i % 2 else None, bytearray(t.encode())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "response_id long, file_type string, file_name string, expanded binary").repartition(3)


def listed(rows, sheets):
    found = {}
    for r in rows.collect():
        found.setdefault(r["response_id"], []).append((r["row_idx"], r["cells"]))
    return {k: sorted(v) for k, v in found.items()}, sorted(map(tuple, sheets.select("response_id", "name", "n_rows", "n_cols", "truncated").collect()))


@pytest.mark.parametrize(("chunk", "rows"), [(1, 3), (4, 200_000), (9, 2), (1 << 16, 5)])
def test_chunks_against_whole_bodies(spark, chunk, rows):
    r = random.Random(chunk)
    texts = ["".join(r.choice('aab,"\r\n ') for _ in range(r.randrange(1, 60))) for _ in range(250)]
    texts += ['"' + "a\n" * 30, 'a,"' + '""\n' * 20 + '"x\nlast', "\n\n\n", " , \n" * 5 + "a", '""\n""\nb', "a\r" * 9, "a\r\n" * 9, 'a"b\n"c\n"d"e"\n']
    limits = Limits(rows=rows, columns=3)
    df = staged(detected_of(spark, texts), "detected")
    whole = delimited.parse_delimited(df, limits)
    # A body without text gives no chunk; all of these have some.
    want = listed(delimited.sheet_rows(whole, limits), whole)
    got = listed(*large_bodies.parse_large(df, staged, limits, chunk))
    assert got == want
    if rows == 200_000:
        for i, text in enumerate(texts):
            if "," in text and set(text) <= set('ab,"\r\n ') and (guess := whole.where(F.col("response_id") == i).first()["delimiter"]) == ",":
                assert [cells for _, cells in got[0].get(i, [])] == machine(text, guess)


def test_states_compose(spark):
    """Every sequence of chunk maps: setting to either state, keeping, turning round."""
    r = random.Random(1)
    rows, want = [], {}
    for body in range(60):
        state, last = False, None
        n = r.randrange(1, 12)
        maps = [r.choice([(False, False), (True, True), (False, True), (True, False)]) for _ in range(n)]
        heads = [r.randrange(0, 5) for _ in range(n)]
        begins = []
        for k, (out, inside) in enumerate(maps):
            begins.append(state)
            state = inside if state else out
        for k in range(n):
            head = heads[k] if begins[k] else 0
            want[body, k] = (head, last, k + 1 < n and begins[k + 1] and heads[k + 1] > 0)
            last = k if head < 4 else last
            rows.append((body, k, 4, *maps[k], heads[k]))
    df = spark.createDataFrame(rows, "response_id long, chunk int, chars int, open_out boolean, open_in boolean, head_in int").repartition(3)
    got = {(x["response_id"], x["chunk"]): (x["head"], x["segment"], x["continued"]) for x in large_bodies.composed(df).collect()}
    assert got == want


def test_large_and_small_bodies_together(spark):
    texts = ["a,b\n1,2\n", "x,y\n" + '3,"4\n5"\n' * 300, "", "no\n\n", "k,l\n" + "\n".join(f"{i},{i * i}" for i in range(500))]
    df = staged(detected_of(spark, texts), "detected")
    whole = delimited.parse_delimited(df)
    want = listed(delimited.sheet_rows(whole), whole)
    assert listed(*large_bodies.parse_bodies(df, staged, large=100)) == want
    assert large_bodies.parse_bodies(df.where("false"), staged)[0].count() == 0


def test_one_body_is_many_tasks(spark):
    text = "".join(f'{i},"say ""{i}""\nand more",x\n' for i in range(20_000))
    df = staged(detected_of(spark, [text]), "detected")
    rows, sheets = large_bodies.parse_large(df, staged, chunk=4096)
    found = rows.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n")).collect()
    assert len(found) > 2 and sum(x["n"] for x in found) == 20_000 and sheets.first()["n_rows"] == 20_000
    assert rows.where("row_idx = 777").first()["cells"] == ["777", 'say "777"\nand more', "x"]
