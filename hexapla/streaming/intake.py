"""Streaming question intake: each micro-batch of questions is answered as one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def answer_stream(spark: SparkSession, questions: str, answers: str, checkpoint: str, run: Callable[[DataFrame], DataFrame]):
    """Starts the query: JSON files of (query_id, text) in `questions`, Parquet in `answers`. A batch that is replayed
    after a failure overwrites its own folder, so each question is answered once."""
    source = spark.readStream.schema("query_id string, text string").json(questions).where(F.btrim("text") != "")

    def one(batch: DataFrame, epoch: int) -> None:
        batch = batch.dropDuplicates(["query_id"])
        run(batch).write.mode("overwrite").parquet(f"{answers}/batch={epoch}")

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
