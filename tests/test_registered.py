"""Functions for SQL text, and averages composed over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from loomstone.functions import registered
from loomstone.operators import chunks, windows
from loomstone.plans import more, texts


def test_sql_chunks_equal_the_operator(spark):
    registered.register(spark)
    rows = [(k, f"# H{k}\n" + "Words of a text. " * (k * 9) + "\n# Next\ndef f():\n  pass\nclass A:\n" + "x = 1\n" * k, ("text", "markdown", "code", None)[k % 4]) for k in range(24)] + [(99, None, "code"), (98, "", "text")]
    docs = spark.createDataFrame(rows, "id long, body string, kind string")
    docs.createOrReplaceTempView("bodies")
    got = {tuple(r) for r in spark.sql("SELECT id, c.chunk_index, c.piece, c.piece_kind, c.head FROM bodies, LATERAL chunks(body, kind) c").collect()}
    assert got == {tuple(r) for r in chunks.chunked(docs, "id", "body", "kind").collect()} and len(got) > 60
    with pytest.raises(Exception, match="not string"):
        spark.sql("SELECT * FROM bodies, LATERAL chunks(id, kind)").collect()
    with pytest.raises(Exception, match="positive"):
        spark.sql("SELECT * FROM chunks('a', 'text', 0)").collect()


def test_budget_by_partition(spark):
    registered.register(spark)
    spark.createDataFrame([(k % 3, k, 10 + k % 7 if k % 5 else None) for k in range(60)], "g int, nth int, cost int").createOrReplaceTempView("costs")
    got = sorted(tuple(r) for r in spark.sql("SELECT g, nth, upto FROM within_budget(TABLE(costs) PARTITION BY (g) ORDER BY (nth), 'cost', 90)").collect())
    want = []
    for g in range(3):
        total = 0
        for k in range(g, 60, 3):
            total += (10 + k % 7) if k % 5 else 0
            if total > 90:
                break
            want.append((g, k, total))
    assert got == sorted(want)
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM within_budget(TABLE(costs) PARTITION BY (g) ORDER BY (nth), 'price', 90)").collect()


@pytest.mark.parametrize("n", [1, 40_000])
def test_moving_average_of_a_hot_group_equals_the_fold(spark, n):
    rng = random.Random(n)
    rows = [("hot", k, rng.random() * 100) for k in range(n)] + [(f"g{k}", j, rng.random()) for k in range(20) for j in range(k)] + [("none", 1, None)]
    want: dict = {}
    for g, _, x in rows:
        if x is not None:
            want[g] = 0.7 * want.get(g, 0.0) + 0.3 * x
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, nth long, x double").repartition(8)
    got = {r.g: r.ema for r in windows.ema(df, "g", "x", F.col("nth")).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_queries_are_registered():
    assert "top10_budget_function" in more.QUERIES and "chk02_text_chunks" in texts.QUERIES
