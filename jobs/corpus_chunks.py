"""Builds the searchable corpus from a table of texts: cleaned, cut into numbered passages, each with the text that is embedded and its point id.

    python -m jobs.corpus_chunks DOCUMENTS OUT [--config FILE]

Reads a Parquet table; writes OUT/chunks by language, OUT/works (documents, passages and characters of each source) by language, and OUT/rejects
(the texts that this run didn't take, with the reason) by reason. Only the partitions of languages that occur are replaced, so running again gives the same
result, and `languages` in the configuration rebuilds some and leaves the others as they are. Texts are cut by the language's chunker; texts are
never shuffled before they are cut, and files are balanced by size however unequal the languages are.

Defined results: rows without an id or with a blank text are rejects; a null language is a partition of its own; rows that share an id share
their passages' ids too; an empty table writes nothing and leaves what is there.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexapla.config import DEFAULTS
from hexapla.functions import text as tx
from hexapla.functions.ids import uuid5
from hexapla.operators import chunk
from jobs.common import log, main, settings

#: As in corpus_chunks.json. `languages`: those to build, all if empty; `chunkers`: han or greek by language, latin for others.
CONFIG: dict[str, Any] = {"id": "doc_id", "text": "text", "language": "lang", "source": "source", "prefix": "doc", "languages": [], "chunkers": {}, "least_chunk": DEFAULTS.least_chunk, "max_records_per_file": 2_000_000}
_CHUNKERS = {"han": chunk.han_chunks, "greek": chunk.greek_chunks}
CHUNKS = "chunk_id string, point_id string, doc_id string, source string, label string, ord int, char_count int, text string, embedding_text string, language string"
WORKS = "source string, n_documents long, n_chunks long, n_chars long, language string"
REJECTS = "doc_id string, source string, language string, reason string"


def _pieces(text: Column, chunkers: dict[str, str]) -> Column:
    """The pieces of a text by the chunker of its language."""
    out = chunk.latin_chunks(text)
    for language, kind in chunkers.items():
        out = F.when(F.col("language") == language, _CHUNKERS[kind](text)).otherwise(out)
    return out


def _write(rows: DataFrame, path: str, by: str, most: int, how: str = "dynamic") -> None:
    balanced = rows.hint("rebalance", by)  # splits large partitions and joins small ones as they turn out
    balanced.write.mode("overwrite").option("partitionOverwriteMode", how).option("maxRecordsPerFile", most).partitionBy(by).parquet(path)


def run(spark: SparkSession, documents: str, out: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Numbers of documents read and of passages, works and rejects written."""
    c = settings(CONFIG, config)
    most = c["max_records_per_file"]
    within = lambda df: df.where(F.col("language").isin(c["languages"])) if c["languages"] else df
    rows = within(spark.read.parquet(documents).select(F.col(c["id"]).cast("string").alias("doc_id"), F.col(c["text"]).alias("raw"), F.col(c["language"]).alias("language"), F.col(c["source"]).alias("source")))
    reason = F.when(F.col("doc_id").isNull(), "no id").when(~F.coalesce(F.col("raw").rlike(r"(?U)\S"), F.lit(False)), "no text")
    good = rows.where(reason.isNull()).withColumn("clean", tx.normalize(F.col("raw")))
    pieces = chunk.numbered(good, _pieces(F.col("clean"), c["chunkers"]), F.concat(F.lit(c["prefix"]), "doc_id"), 4, c["least_chunk"])
    chunks = pieces.select(
        "chunk_id", uuid5(F.col("chunk_id")).alias("point_id"), "doc_id", "source", "label", "ord", F.char_length("chunk").alias("char_count"), F.col("chunk").alias("text"), tx.embedding_text(F.lit(None).cast("string"), F.col("chunk")).alias("embedding_text"), "language"
    )
    _write(chunks, f"{out}/chunks", "language", most)
    made = within(read_chunks(spark, f"{out}/chunks"))
    works = made.groupBy("language", "source").agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"), F.sum("char_count").alias("n_chars"))
    _write(works, f"{out}/works", "language", most)
    rejects = rows.withColumn("reason", reason).where("reason IS NOT NULL").select("doc_id", "source", "language", "reason")
    _write(rejects, f"{out}/rejects", "reason", most, "static")
    written = {"chunks": made, "works": within(spark.read.schema(WORKS).parquet(f"{out}/works")), "rejects": spark.read.schema(REJECTS).parquet(f"{out}/rejects")}
    counts = {"documents": rows.count()} | {name: df.count() for name, df in written.items()}
    log.info("corpus_chunks: read %d documents of %s; wrote %d passages, %d works and %d rejects to %s", counts["documents"], documents, counts["chunks"], counts["works"], counts["rejects"], out)
    return counts


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


if __name__ == "__main__":
    main(run, "corpus_chunks", ["documents", "out"], "Cleans and cuts a table of texts into a corpus of passages.")
