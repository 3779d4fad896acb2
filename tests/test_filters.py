"""Filters of each query in one search, against a search for each filter."""

import random

from pyspark.sql import functions as F

from hexapla.config import Settings
from hexapla.operators import retrieve

QUERY = "query_id int, vector array<double>, only string, date_from int, date_to int"


def test_one_search_for_all_filters_equals_separate_ones(spark):
    rng = random.Random(9)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, vector(), rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-400, 1200, 100)])) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>, tradition string, date_approx int").repartition(5)
    asked = [(q, vector(), rng.choice([None, "a", "b", "none"]), rng.choice([None, -200, 500]), rng.choice([None, 0, 900])) for q in range(25)] + [(30, None, "a", None, None)]
    for queries in (asked, [(q, v, "a", -300, 800) for q, v, *_ in asked]):
        df = spark.createDataFrame(queries, QUERY)
        want, want_per = [], []
        for f in {x[2:] for x in queries}:
            mine = spark.createDataFrame([x for x in queries if x[2:] == f], QUERY)
            cond = retrieve.facets(traditions=[f[0]] if f[0] else None, date_from=f[1], date_to=f[2])
            left = chunks if cond is None else chunks.where(cond)
            want += map(tuple, retrieve.dense_topk(left, mine, 7).collect())
            want_per += map(tuple, retrieve.dense_topk(left, mine, 3, per="tradition").collect())
        for block in (1000, 4):
            settings = Settings(query_block=block)
            assert sorted(map(tuple, retrieve.dense_topk(chunks, df, 7, settings=settings, own=True).collect())) == sorted(want)
            assert sorted(map(tuple, retrieve.dense_topk(chunks, df, 3, "tradition", settings, own=True).collect()), key=str) == sorted(want_per, key=str)


def test_filters_that_all_queries_share_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "chunks")
    spark.range(20).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"), F.when(F.col("id") < 5, "a").otherwise("b").alias("tradition"), F.col("id").cast("int").alias("date_approx")).write.partitionBy("tradition").parquet(path)
    queries = spark.createDataFrame([(1, [1.0, 0.0], "a", 1, None), (2, [0.0, 1.0], "a", 2, 4)], QUERY)
    found = retrieve.dense_topk(spark.read.parquet(path), queries, 3, own=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date_approx,1)" in plan and "PartitionFilters: [" in plan and "tradition" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == {(1, 1), (1, 2), (1, 3), (2, 4), (2, 3), (2, 2)}
