"""The jobs on copies of the tables: growing input, runs again, partial rebuilds; the growing index against a fresh one."""

import json
import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from hexapla.operators import index, retrieve
from hexapla.sources import segments
from jobs import corpus_chunks, entry, keyword_stream

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ROWS = "doc_id long, text string, lang string, source string"
TEXT = (index.Field("text", "text", index.standard),)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.select(*names)) == sorted(cur.fetchall(), key=repr)


# --- corpus_chunks ------------------------------------------------------------------------------------------------
def test_chunks_again_and_after_growth(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    table.where("doc_id < 100").write.parquet(docs)
    first = corpus_chunks.run(spark, docs, out)
    before = rows_of(corpus_chunks.read_chunks(spark, f"{out}/chunks"))
    assert corpus_chunks.run(spark, docs, out) == first and rows_of(corpus_chunks.read_chunks(spark, f"{out}/chunks")) == before
    table.where("doc_id >= 100").write.mode("append").parquet(docs)
    corpus_chunks.run(spark, docs, out)
    after = rows_of(corpus_chunks.read_chunks(spark, f"{out}/chunks"))
    assert set(before) < set(after) and len(after) == len(set(after))
    works = spark.read.schema(corpus_chunks.WORKS).parquet(f"{out}/works")
    assert works.agg(F.sum("n_chunks")).first()[0] == len(after)


def test_awkward_documents_and_chosen_languages(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    han = "天地玄黄宇宙洪荒。" * 120
    rows = [(1, "Short.", "en", "s"), (2, "A sentence of some words. " * 60, "en", "s"), (3, None, "en", "s"), (4, " \n\t", "de", None), (None, "No id. " * 30, "de", "s"), (5, han, "zh", None), (6, "Kein Wort zu viel. " * 40, None, "s"), (7, "x" * 200_000, "de", "s"), (2, "A sentence of some words. " * 60, "en", "s")]
    spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("ord", "chunk", "label", "clean")}).write.parquet(docs)
    counts = corpus_chunks.run(spark, docs, out, {"chunkers": {"zh": "han"}})
    assert counts["documents"] == 9 and counts["rejects"] == 3
    chunks = corpus_chunks.read_chunks(spark, f"{out}/chunks")
    pieces = {(r.doc_id, r.ord): r for r in chunks.collect()}
    assert [len(pieces["5", k].text) for k in range(3)] == [405, 405, 270] and pieces["7", 0].char_count == 200_000 and ("1", 0) not in pieces
    assert pieces["6", 0].language is None and chunks.where("doc_id = '2'").count() == 2 * len([k for k in pieces if k[0] == "2"])
    assert {(r.doc_id, r.reason) for r in spark.read.schema(corpus_chunks.REJECTS).parquet(f"{out}/rejects").collect()} == {("3", "no text"), ("4", "no text"), (None, "no id")}
    others = rows_of(chunks.where("language <> 'de' OR language IS NULL"))
    spark.createDataFrame([(7, "Neu. " * 40, "de", "s"), (2, "Gone. " * 40, "en", "s")], ROWS).write.mode("overwrite").parquet(docs)
    corpus_chunks.run(spark, docs, out, {"languages": ["de"]})
    chunks = corpus_chunks.read_chunks(spark, f"{out}/chunks")
    assert rows_of(chunks.where("language <> 'de' OR language IS NULL")) == others
    assert [r.text for r in chunks.where("language = 'de'").collect()] == [("Neu. " * 40).strip()]


def test_an_empty_table_and_unknown_settings(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(str(tmp_path / "docs"))
    (tmp_path / "out").mkdir()
    assert corpus_chunks.run(spark, str(tmp_path / "docs"), str(tmp_path / "out")) == {"documents": 0, "chunks": 0, "works": 0, "rejects": 0}
    with pytest.raises(ValueError, match="unknown settings: langs"):
        corpus_chunks.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), {"langs": []})


# --- keyword_stream -----------------------------------------------------------------------------------------------
def test_stream_takes_only_what_is_new(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "index", "mark"))
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    table.where("doc_id < 60").coalesce(1).write.parquet(docs)
    assert keyword_stream.run(spark, docs, out, mark) == {"batches": 1, "rows": 60, "documents": table.where("doc_id < 60 AND text <> ''").count()}
    changed = table.where("doc_id BETWEEN 40 AND 120").withColumn("text", F.concat(F.lit("anew "), "text"))
    changed.coalesce(1).write.mode("append").parquet(docs)
    assert keyword_stream.run(spark, docs, out, mark)["rows"] == 81
    held = rows_of(keyword_stream.read_vocabulary(spark, out))
    assert keyword_stream.run(spark, docs, out, mark)["batches"] == 0 and rows_of(keyword_stream.read_vocabulary(spark, out)) == held
    now = table.where("doc_id < 40").unionByName(changed).withColumnRenamed("doc_id", "chunk_id")
    fresh = index.field_postings(now, TEXT).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    assert held == rows_of(fresh)


def test_one_file_at_a_time_gives_the_same_index(spark, tmp_path):
    docs = str(tmp_path / "docs")
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    table.repartition(6).write.parquet(docs)
    whole = keyword_stream.run(spark, docs, str(tmp_path / "a"), str(tmp_path / "ma"))
    single = keyword_stream.run(spark, docs, str(tmp_path / "b"), str(tmp_path / "mb"), {"max_files_per_trigger": 1, "merge_fan": 3})
    assert (whole["batches"], single["batches"], whole["documents"]) == (1, 6, single["documents"])
    assert rows_of(keyword_stream.read_vocabulary(spark, str(tmp_path / "a"))) == rows_of(keyword_stream.read_vocabulary(spark, str(tmp_path / "b")))
    assert len(segments.sizes(spark, str(tmp_path / "b"))) < 6


# --- the growing index --------------------------------------------------------------------------------------------
def scores(postings, statistics, spark):
    terms = spark.createDataFrame([(q, w) for q, ws in enumerate(["a b c", "b", "d e z", "k l"]) for w in ws.split()], "query_id int, term string")
    return rows_of(retrieve.bm25_scores(postings, statistics, terms))


def test_loads_replacements_deletions_and_merges_equal_a_fresh_index(spark, tmp_path):
    rng, path, live = random.Random(3), str(tmp_path / "index"), {}
    fields = (index.Field("text", "text", index.standard), index.Field("title", "title", index.standard))
    kind = "chunk_id string, text string, title string"
    for batch in range(7):
        if batch == 4:
            gone = [f"d{i}" for i in range(0, 30, 3)] + ["never there"]
            segments.delete(spark.createDataFrame([(g,) for g in gone], "chunk_id string"), path, batch)
            live = {k: v for k, v in live.items() if k not in gone}
        else:
            rows = {f"d{rng.randrange(30)}": (" ".join(rng.choices("abcdeklm", k=rng.randint(0, 12))), rng.choice([None, "", "a", "k l"])) for _ in range(12)}
            for _ in range(2 if batch == 5 else 1):  # a batch that is replayed
                segments.load(spark.createDataFrame([(k, *v) for k, v in rows.items()] + [(None, "a", "b")], kind), path, batch, fields)
            live = {k: v for k, v in (live | rows).items() if v[0] or v[1]}  # blank ones hide what was there
        if batch in (2, 5):
            segments.merge_batches(spark, path, [b for b, _ in segments.sizes(spark, path)][:3])
    kept = spark.createDataFrame([(k, *v) for k, v in live.items()], kind)
    fresh = scores(index.field_postings(kept, fields), index.fields_statistics(kept, fields), spark)
    assert fresh and scores(*segments.read(spark, path), spark) == fresh
    for _ in range(2):
        segments.merge(spark, path, 2)
        assert scores(*segments.read(spark, path), spark) == fresh
    batches = [b for b, _ in segments.sizes(spark, path)]
    segments.merge_batches(spark, path, batches)
    assert scores(*segments.read(spark, path), spark) == fresh and segments.sizes(spark, path) == [(max(batches), len(live))]


def test_the_last_of_rows_with_one_id_stays(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.load(spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "a"), ("y", None), ("z", "")], "chunk_id string, text string"), path, 0, TEXT)
    assert [tuple(r) for r in segments.read(spark, path)[0].collect()] == [("text", "x", "b", 1, 1)]


# --- command lines ------------------------------------------------------------------------------------------------
def test_command_lines(tmp_path):
    for name, paths in (("corpus_chunks", ["out"]), ("keyword_stream", ["index", "mark"])):
        config = json.load(open(f"{ROOT}/jobs/{name}.json"))
        assert set(config) == set({"corpus_chunks": corpus_chunks, "keyword_stream": keyword_stream}[name].CONFIG)
        done = subprocess.run([sys.executable, "-m", f"jobs.{name}", f"{SF}/documents.parque[t]", *[str(tmp_path / name / p) for p in paths]], cwd=ROOT, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell", "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert f"{name}: " in done.stderr


def test_postings_are_stored_in_groups_and_single_ones_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(i, "all any") for i in range(500)], "chunk_id long, text string").coalesce(1)
    segments.load(docs, path, 0, TEXT)
    table = spark.read.parquet(path)
    assert table.where("kind = 'posting' AND term IS NOT NULL").count() == 2
    assert segments.read(spark, path)[0].count() == 1000
    segments.load(docs.where("chunk_id < 3").withColumn("text", F.lit("new")), path, 1, TEXT)
    segments.merge_batches(spark, path, [0, 1])  # some were replaced: postings one by one
    found, statistics = segments.read(spark, path)
    assert {(r.term, r["count"]) for r in found.groupBy("term").count().collect()} == {("all", 497), ("any", 497), ("new", 3)}
    assert [tuple(r) for r in statistics.collect()] == [("text", 500, (497 * 2 + 3) / 500)]
