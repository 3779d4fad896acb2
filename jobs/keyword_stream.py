"""Keeps the keyword index of a growing folder of texts: a stream that takes the files it hasn't seen, and ends.

    python -m jobs.keyword_stream DOCUMENTS INDEX CHECKPOINT [--config FILE]

DOCUMENTS is a folder of Parquet files, or a pattern of files, to which files are added; CHECKPOINT belongs to INDEX and says what was taken. Every micro-batch is a batch of
the index, written under its number, so one that is replayed after a failure replaces itself. A text whose id comes again in a later batch replaces
the older one. At the end batches of like size are merged. Running again without new files changes nothing.

Defined results: rows without an id are left out, and so are blank texts, which hide an older one of their id; of rows with the same id in one batch, the one whose text
sorts last stays; an empty folder gives an empty index.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexapla.operators import index
from hexapla.sources import segments
from jobs.common import log, main, settings

#: As in keyword_stream.json. `fields`: names of the index's fields and their columns; `analyzer`: standard or english.
CONFIG: dict[str, Any] = {"id": "doc_id", "fields": {"text": "text"}, "analyzer": "standard", "max_files_per_trigger": 64, "merge_fan": 4}


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Numbers of micro-batches and rows taken in this run, and of documents that the index now holds."""
    c = settings(CONFIG, config)
    analyzer = {"standard": index.standard, "english": index.english}[c["analyzer"]]
    fields = tuple(index.Field(name, column, analyzer) for name, column in c["fields"].items())
    taken = {"batches": 0, "rows": 0}

    def take(rows: DataFrame, batch: int) -> None:
        n = rows.count()
        segments.load(rows.withColumn("chunk_id", F.col(c["id"])), out, batch, fields)
        taken["batches"], taken["rows"] = taken["batches"] + 1, taken["rows"] + n
        log.info("keyword_stream: batch %d, read %d rows of %s", batch, n, documents)

    columns = list(dict.fromkeys([c["id"], *c["fields"].values()]))
    schema = spark.read.parquet(documents).select(*columns).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["max_files_per_trigger"]).parquet(documents)
    source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    merged = segments.merge(spark, out, c["merge_fan"]) if taken["batches"] else []
    statistics = segments.read(spark, out)[1]
    held = statistics.agg(F.max("n")).first()[0] or 0
    log.info("keyword_stream: %d batches, %d rows taken; merged %s; %s holds %d documents", taken["batches"], taken["rows"], merged, out, held)
    return taken | {"documents": held}


def read_vocabulary(spark: SparkSession, out: str) -> DataFrame:
    """(field, term, df, cf) of the documents that the index holds."""
    return segments.read(spark, out)[0].groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


if __name__ == "__main__":
    main(run, "keyword_stream", ["documents", "index", "checkpoint"], "Takes new files of a folder of texts into its keyword index.")
