"""Stems from a dictionary, and what readers skip by the points' indexes."""

import random

from pyspark.sql import functions as F

from hexapla.operators import index
from hexapla.sources import sinks


def test_stems_from_the_dictionary_are_those_of_every_occurrence(spark):
    rng = random.Random(8)
    words = "running runs ran waters watery the of patient's fevers feverish 42 中文 hopping hopefulness relational".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)] + [(100, None), (101, ""), (102, "the of")]
    docs = spark.createDataFrame(rows, "chunk_id int, text string")
    key = lambda df: sorted(map(tuple, df.select("field", "chunk_id", "term", "tf", "dl").collect()))
    each = index.Field("text", "text", index.english)
    once = index.Field("text", "text", index.english, 1.0, index.english_words)
    plain = index.Field("plain", "text", index.standard)
    assert key(index.field_postings(docs, (once, plain))) == key(index.field_postings(docs, (each, plain)))
    assert sorted(map(tuple, index.fields_statistics(docs, (once,)).collect())) == sorted(map(tuple, index.fields_statistics(docs, (each,)).collect()))
    assert {r.term: r.stem for r in index.stem_dictionary(spark.createDataFrame([("running",), ("running",), ("hopping",)], "term string")).collect()} == {"running": "run", "hopping": "hop"}


def _rows_read(df):
    """Rows that the scan hands on, after row groups were skipped, before the filter is held against each."""
    df._jdf.queryExecution().executedPlan()
    plan = df._jdf.queryExecution()
    plan.toRdd().count()
    leaves = plan.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_every_filter_skips_files_or_row_groups(spark, tmp_path):
    path = str(tmp_path / "points")
    rng = random.Random(10)
    n = 20_000
    order = list(range(n))
    rng.shuffle(order)
    rows = [(f"c{i:05d}", "abcd"[i % 4], f"lang{i // 5000}", f"work {i // 50}", order[i] % 3000 - 400, i // 20, [float(i)]) for i in range(n)]
    chunks = spark.createDataFrame(rows, "chunk_id string, tradition string, language string, source_text string, date_approx int, chapter_num int, vector array<double>")
    sinks.write_points(chunks, path, **{"parquet.block.size": "2048", "parquet.block.size.row.check.min": "10", "parquet.page.size.row.check.min": "10"})
    points = spark.read.parquet(path)
    assert points.count() == n
    for condition in (F.col("tradition") == "b", F.col("date_approx").between(100, 150), F.col("source_text") == "work 77", F.col("chapter_num") == 500, F.col("language") == "no such language"):
        df = points.where(condition).select("chunk_id", "source_text", "chapter_num", "language", "date_approx")
        wanted = df.count()
        read = _rows_read(points.where(condition).select("chunk_id", "source_text", "chapter_num", "language", "date_approx"))
        assert wanted <= read < 0.6 * n, (str(condition), read)
