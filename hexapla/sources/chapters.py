"""A data source of chapters that a server hands out one by one.

    read_remote_chapters(spark, ["first", "second"], "https://example.org/gettext?urn={slug}")

Each input partition fetches a range of slugs, in order, with a pause between requests, so `partitions` over `delay` bounds the requests a second that the
server sees. A request that fails is tried again after growing pauses; a chapter that can't be had is a row with its error, and never fails the
others. Nothing else imports this module, so an engine without a network needs none.

Defined results: ord counts slugs from 1, blank and repeated ones too; a list of paragraphs is joined by blank lines; an answer without text is an empty
chapter; one that is no JSON object is an error; no slugs give no rows.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ord int, slug string, text string, error string"


@dataclass
class SlugRange(InputPartition):
    first: int
    slugs: tuple[str, ...]


class ChapterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.slugs = options["url"], json.loads(options["slugs"])
        self.ranges, self.attempts = int(options.get("partitions", "1")), int(options.get("attempts", "3"))
        self.delay, self.timeout = float(options.get("delay", "1.0")), float(options.get("timeout", "60"))

    def partitions(self) -> Sequence[InputPartition]:
        size = max(1, -(-len(self.slugs) // self.ranges))
        return [SlugRange(a + 1, tuple(self.slugs[a : a + size])) for a in range(0, len(self.slugs), size)] or [SlugRange(1, ())]

    def fetch(self, slug: str) -> str:
        with urllib.request.urlopen(self.url.replace("{slug}", urllib.parse.quote(slug, safe="/:")), timeout=self.timeout) as answer:
            found = json.loads(answer.read().decode("utf-8"))
        if not isinstance(found, dict):
            raise ValueError("the answer isn't a JSON object")
        text = found.get("fulltext") or ""
        return "\n\n".join(str(x) for x in text) if isinstance(text, list) else str(text)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k, slug in enumerate(partition.slugs):
            error = text = None
            for attempt in range(self.attempts):
                if k or attempt:
                    time.sleep(self.delay * (1 + attempt))
                try:
                    text, error = self.fetch(slug), None
                    break
                except Exception as e:  # noqa: BLE001  whatever a server does wrong is a row's error
                    error = f"{type(e).__name__}: {e}"
            yield partition.first + k, slug, text, error


class ChapterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chapters"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChapterReader(self.options)


def read_remote_chapters(spark: SparkSession, slugs: Sequence[str], url: str, partitions: int = 1, delay: float = 1.0, attempts: int = 3, timeout: float = 60.0) -> DataFrame:
    """(ord, slug, text, error) of every slug of a work's list, which the plan holds; `url` has {slug} in it. Fetch once: keep what was read before using it twice."""
    spark.dataSource.register(ChapterSource)
    return spark.read.format("chapters").options(url=url, slugs=json.dumps(list(slugs)), partitions=partitions, delay=delay, attempts=attempts, timeout=timeout).load()


def chapter_files(chapters: DataFrame, work: str) -> DataFrame:
    """(name, document) of the chapters that were had, for named_files with the suffix .txt; readers.read_chapters takes them back."""
    number = F.lpad(F.col("ord").cast("string"), F.greatest(F.lit(2), F.char_length(F.col("ord").cast("string"))), F.lit("0"))
    return chapters.where("error IS NULL").select(F.concat(F.lit(f"{work}_ch"), number).alias("name"), F.col("text").alias("document"))
