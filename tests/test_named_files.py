"""One file for each row, under the row's name."""

import json

import pytest
from pyspark.sql import functions as F

from hexapla.sources import sinks
from hexapla.sources.named_files import named_files


def written(folder):
    return {p.name: p.read_text() for p in folder.iterdir()}


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_files_have_the_rows_names(spark, tmp_path, scheme):
    rows = spark.createDataFrame([(f"2024-01-02_q{i}", None if i == 3 else f"# Answer {i}\n\nä中\n") for i in range(20)], "name string, document string").repartition(4)
    named_files(rows.withColumn("other", F.lit(1)), f"{scheme}{tmp_path}/out", ".md")
    assert written(tmp_path / "out") == {f"2024-01-02_q{i}.md": "" if i == 3 else f"# Answer {i}\n\nä中\n" for i in range(20)}
    named_files(spark.createDataFrame([("2024-01-02_q3", "again"), ("new", "n")], "name string, document string"), f"{scheme}{tmp_path}/out", ".md")
    now = written(tmp_path / "out")
    assert len(now) == 21 and now["2024-01-02_q3.md"] == "again"
    back = spark.read.text(f"{tmp_path}/out", wholetext=True).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]*)\.md$", 1))
    assert {(r.name, r.value) for r in back.collect() if r.value} == {(k[:-3], v) for k, v in now.items() if v}


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    named_files(spark.createDataFrame([("a", "old")], "name string, document string"), str(out))
    for bad in (F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.concat(F.lit("n"), "id")), F.when(F.col("id") == 7, "n1").otherwise(F.concat(F.lit("n"), "id")), F.when(F.col("id") == 7, "../x").otherwise(F.concat(F.lit("n"), "id")), F.when(F.col("id") != 7, F.concat(F.lit("n"), "id"))):
        with pytest.raises(Exception):  # noqa: B017
            named_files(spark.range(0, 8, 1, 4).select(bad.alias("name"), F.lit("x").alias("document")), str(out))
        assert written(out) == {"a": "old"}


def test_traces_and_no_rows(spark, tmp_path):
    t = spark.createDataFrame([("abcdef0123456789", "What is Q?", "2024-01-02 03:04:05", [1, 2])], "trace string, question string, s string, cited array<int>").withColumn("started", F.to_timestamp("s")).drop("s")
    sinks.write_trace_files(t, str(tmp_path / "t"))
    (name, text), = written(tmp_path / "t").items()
    assert name == "2024-01-02_030405_what-is-q_abcdef01.jsonl" and json.loads(text)["cited"] == [1, 2]
    assert sinks.read_traces(spark, str(tmp_path / "t"), "trace string, question string").first().question == "What is Q?"
    sinks.write_trace_files(t.limit(0), str(tmp_path / "none"))
    assert written(tmp_path / "none") == {}
