"""Sinks: chunk tables, vector and keyword indexes, traces, answers and suite summaries; count reconciliation."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexapla.functions.ids import uuid5
from hexapla.functions.lineage import ensure_checkpoint_dir
from hexapla.functions.text import filled, slug
from hexapla.operators.index import BUCKETS, FIELDS, Field, field_postings, fields_statistics
from hexapla.sources.named_files import named_files


def hadoop_files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop_files(spark, path)
    return fs.exists(where)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replace_table(rows: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = (), **options: str) -> None:
    """Whole replacement: written aside first, then swapped by renames, so a job that fails leaves the old table. `rows` may read the
    old table. The old one goes last; between the renames a reader finds no table, never a part of one."""
    spark = rows.sparkSession
    mark = uuid.uuid4().hex
    rows.write.format(fmt).options(**options).partitionBy(*partition_by).save(f"{path}.new-{mark}")
    fs, at = hadoop_files(spark, path)
    new, old = (hadoop_files(spark, f"{path}.{k}-{mark}")[1] for k in ("new", "old"))
    had = fs.exists(at)
    if had and not fs.rename(at, old) or not fs.rename(new, at):
        if had and not fs.exists(at):
            fs.rename(old, at)
        raise OSError(f"can't replace {path}")
    if had:
        fs.delete(old, True)


def ensure_table(spark: SparkSession, path: str, schema, recreate: bool = False, fmt: str = "parquet", partition_by: Iterable[str] = ()) -> bool:
    """Makes an empty table where there is none, or anew if asked to; says whether it did."""
    if exists(spark, path) and not recreate:
        return False
    replace_table(spark.createDataFrame([], schema), path, fmt, partition_by)
    return True


def write_chunks(chunks: DataFrame, path: str, fmt: str = "parquet") -> None:
    replace_table(chunks, path, fmt)


def points(chunks: DataFrame) -> DataFrame:
    """Chunks with a vector, under a deterministic id."""
    return chunks.where(F.col("vector").isNotNull()).withColumn("point_id", uuid5(F.col("chunk_id").cast("string")))


#: Fields with an index of their own beside the partitions and the order of dates: Bloom filters, by which readers skip row groups.
INDEXED = ("language", "source_text", "chapter_num")


def point_options(columns: Iterable[str]) -> dict[str, str]:
    return {f"parquet.bloom.filter.{k}#{c}": v for c in INDEXED if c in set(columns) for k, v in (("enabled", "true"), ("expected.ndv", "20000"))}


def write_points(chunks: DataFrame, path: str, **options: str) -> None:
    """Vectors with payload by tradition and sorted by date, so that filters skip files, with Bloom filters on INDEXED; rows that are there already and
    aren't given anew stay, as ids say which they are. `options` are the Parquet writer's."""
    spark, new = chunks.sparkSession, points(chunks)
    if exists(spark, path):
        new = new.unionByName(spark.read.parquet(path).join(new.select("point_id"), "point_id", "left_anti"), allowMissingColumns=True)
    dealt = new.repartition("tradition", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).sortWithinPartitions("tradition", "date_approx")
    replace_table(dealt, path, partition_by=["tradition"], **point_options(dealt.columns) | options)


def loadable(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks a keyword index takes, rejects with their reason)."""
    reason = F.when(filled(F.col("chunk_id").cast("string")).isNull(), "no chunk_id").when(filled(F.col("text")).isNull(), "no text")
    marked = chunks.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def write_index(chunks: DataFrame, path: str, fields: Iterable[Field] = FIELDS) -> DataFrame:
    """A stored keyword index: postings by bucket of their term, field statistics, rejects. Returns (part, n) of chunks, indexed and rejects."""
    spark, fields = chunks.sparkSession, tuple(fields)
    good, bad = loadable(chunks)
    # A chunk_id loaded twice is one document, as in an index keyed by it.
    good = good.dropDuplicates(["chunk_id"])
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
    replace_table(field_postings(good, fields).select("*", bucket).repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("bucket", "term"), f"{path}/postings", partition_by=["bucket"])
    replace_table(fields_statistics(good, fields), f"{path}/statistics")
    replace_table(bad.select("chunk_id", "reason"), f"{path}/rejects")
    counts = [("chunks", chunks), ("indexed", good), ("rejects", spark.read.parquet(f"{path}/rejects"))]
    out = None
    for name, df in counts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics); a join on term that also compares `bucket` reads the wanted buckets only."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/statistics")


def trace_lines(traces: DataFrame) -> DataFrame:
    """Each trace as one JSON object (value)."""
    return traces.select(F.to_json(F.struct(*traces.columns)).alias("value"))


def append_traces(traces: DataFrame, path: str) -> None:
    """One JSON object for each run, under its day."""
    rows = traces.withColumn("day", F.date_format("started", "yyyy-MM-dd"))
    rows.select("day", F.to_json(F.struct(*traces.columns)).alias("value")).write.mode("append").partitionBy("day").text(path)


def parse_traces(lines: DataFrame, schema: str) -> DataFrame:
    """Traces (value) that parse; others are left out."""
    rows = lines.where(F.try_parse_json("value").isNotNull() & F.btrim("value").startswith("{"))
    return rows.select(F.from_json("value", schema).alias("t")).select("t.*")


def read_traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_traces(spark.read.text(path), schema)


def trace_name(started: Column, question: Column, trace: Column) -> Column:
    return F.concat_ws("_", F.date_format(started, "yyyy-MM-dd_HHmmss"), slug(question), F.left(trace, F.lit(8)))


def markdown(question: Column, started: Column, trace: Column, answer: Column) -> Column:
    """An answer as a Markdown document: head, rule, answer; the trace's line goes where there is none."""
    body = F.when(F.coalesce(answer, F.lit("")) == "", F.lit("(no answer produced)")).otherwise(answer)
    line = F.when(F.coalesce(trace, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("- **Trace ID:** "), trace, F.lit("\n")))
    head = F.concat(F.lit("# Answer\n\n- **Date of input:** "), F.date_format(started, "yyyy-MM-dd HH:mm:ss"), F.lit("\n- **Query:** "), F.coalesce(question, F.lit("")), F.lit("\n"))
    return F.concat(head, line, F.lit("\n---\n\n"), body, F.lit("\n"))


def write_documents(rows: DataFrame, path: str) -> None:
    """(name, document): one Markdown file for each row, named so; for the answers of a batch."""
    named_files(rows, path, ".md")


def write_trace_files(traces: DataFrame, path: str) -> None:
    """One file for each run (trace, question, started, and what else it has), named by its time, question and trace, with one JSON object."""
    line = F.concat(F.to_json(F.struct(*traces.columns)), F.lit("\n"))
    named_files(traces.select(trace_name(F.col("started"), F.col("question"), F.col("trace")).alias("name"), line.alias("document")), path, ".jsonl")


#: Columns of a suite's summaries, in order.
SUITE_COLUMNS = "n id status sec n_retrieved traditions cited passed iters trace export probes err".split()
SUITE_TABLE = {"#": "n", "id": "id", "status": "status", "sec": "sec", "traditions retrieved": "traditions", "cited": "cited", "passed": "passed", "iters": "iters"}


def suite_line(columns: Iterable[str]) -> Column:
    """A line of the Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))


def suite_table(rows: DataFrame) -> DataFrame:
    """One row (value): the Markdown table with its head, by n; a suite is some dozen questions."""
    head = "| " + " | ".join(SUITE_TABLE) + " |\n|" + "|".join("-" * (len(c) + 2) for c in SUITE_TABLE) + "|"
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", suite_line(SUITE_TABLE.values()).alias("line")))), lambda x: x["line"])
    return rows.agg(F.concat_ws("\n", F.lit(head), F.array_join(lines, "\n")).alias("value"))


def suite_page(answer: Column) -> Column:
    """A question's page in the suite's folder; columns as in SUITE_COLUMNS and `question`."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(
        F.lit("# ["), text("id"), F.lit("] "), text("probes"), F.lit("\n\n**Q:** "), text("question"), F.lit("\n\n- status: "), text("status"), F.when(text("err") != "", F.concat(F.lit(" — "), text("err"))).otherwise(""),
        F.lit("\n- duration: "), text("sec"), F.lit("s\n- traditions retrieved: "), text("traditions"), F.lit("\n- cited sources: "), text("cited"), F.lit("\n- proofread passed: "), text("passed"), F.lit("  | iterations: "), text("iters"),
        F.lit("\n- trace: "), text("trace"), F.lit("\n- export: "), text("export"), F.lit("\n\n---\n\n"), F.when(F.coalesce(answer, F.lit("")) == "", F.lit("(no answer)")).otherwise(answer), F.lit("\n"),
    )


def suite_totals(rows: DataFrame) -> DataFrame:
    """One row: questions, how many went well, seconds in all, on average and at most."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.round(F.sum("sec"), 1).alias("sec"), F.round(F.avg("sec"), 3).alias("mean_sec"), F.max("sec").alias("max_sec"))


def write_suite(rows: DataFrame, path: str) -> None:
    """A suite's folder: tab-separated and Markdown summaries, and a page for each question (columns answer, question besides)."""
    rows.select(*SUITE_COLUMNS).coalesce(1).sortWithinPartitions("n").write.mode("overwrite").csv(f"{path}/summary.tsv", sep="\t", header=True)  # one row per question
    write_documents(suite_table(rows).select(F.lit("summary").alias("name"), F.concat("value", F.lit("\n")).alias("document")), path)
    name = F.concat(F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("_"), slug(F.col("id"), 40))
    write_documents(rows.select(name.alias("name"), suite_page(F.col("answer")).alias("document")), f"{path}/pages")


def reconcile(**tables: DataFrame) -> DataFrame:
    """(part, n, agrees): counts of tables that must hold the same rows, in one job."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        counts = one if counts is None else counts.unionByName(one)
    ends = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return counts.crossJoin(F.broadcast(ends)).select("part", "n", (F.col("lo") == F.col("hi")).alias("agrees"))  # one row against a few
