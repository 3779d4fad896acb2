"""Models that take lists."""

import pytest
from pyspark.sql import functions as F

from hexapla.operators.providers import Batch, Providers


def sized(texts):
    return [[float(len(t)), float(len(texts)), float(max(map(len, texts)))] for t in texts]


def test_lists_are_bounded_and_of_like_length(spark):
    rows = spark.range(0, 100, 1, 2).select("id", F.when(F.col("id") != 13, F.repeat(F.lit("x"), (F.col("id") * 37 % 100).cast("int"))).alias("text"))
    got = {r.id: r.v for r in rows.select("id", Providers(embed=Batch(sized, 8)).embedding(F.col("text")).alias("v")).collect()}
    for i in range(100):
        length, n, longest = got[i]
        assert length == (0 if i == 13 else i * 37 % 100) and n <= 8 and longest - length < 20  # 50 rows of a partition in seven lists
    cut = rows.select(Providers(embed=Batch(sized, 8, longest=10)).embedding(F.col("text")).alias("v")).collect()
    assert max(r.v[0] for r in cut) == 10


def test_pairs_keep_their_rows(spark):
    pairs = spark.range(50).select("id", F.concat(F.lit("q"), "id").alias("q"), F.concat(F.repeat(F.lit("t"), (F.col("id") % 7).cast("int")), F.col("id").cast("string")).alias("t"))
    model = Batch(lambda qs, ts: [float(int(q[1:]) * 1000 + int(t.lstrip("t"))) for q, t in zip(qs, ts, strict=True)], 6)
    assert all(r.s == r.id * 1001 for r in pairs.select("id", Providers(rerank=model).reranked(F.col("q"), F.col("t")).alias("s")).collect())


def test_a_model_that_loses_answers_fails():
    import pandas as pd

    with pytest.raises(ValueError, match="1 answers to 2 values"):
        Batch(lambda texts: texts[:1]).over(pd.Series(["a", "b"]))
