"""Readers: chunk files, raw texts, slugs, questions, TEI pairs and wrapped OCR pages."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from hexapla.config import CHUNK, DEFAULTS
from hexapla.functions.text import filled, parse_int_ref, unescape


def parse_chunks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejects) from JSON lines (value). Blank lines are skipped; malformed ones and those without chunk_id are rejects."""
    schema = T.StructType([*CHUNK.fields, T.StructField("_corrupt_record", T.StringType())])
    # Malformed lines and missing keys are told apart before columns are pruned.
    rows = lines.where(F.btrim("value") != "").select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    reason = F.when(F.col("r._corrupt_record").isNotNull(), "malformed").when(filled(F.col("r.chunk_id")).isNull(), "no chunk_id")
    marked = rows.withColumn("reason", reason)
    good = marked.where("reason IS NULL").select("r.*").drop("_corrupt_record").where(filled(F.col("text")).isNotNull())
    return with_refs(good), marked.where("reason IS NOT NULL").select(F.col("value").alias("_corrupt_record"), "reason")


def read_chunks(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejects) of JSON lines files. Strict: a malformed line fails the job."""
    if strict:
        return with_refs(spark.read.schema(CHUNK).json(path, mode="FAILFAST").where(filled(F.col("text")).isNotNull())), spark.createDataFrame([], "_corrupt_record string, reason string")
    return parse_chunks(spark.read.text(path))


def with_refs(chunks: DataFrame) -> DataFrame:
    """chapter_ref where it is missing, from the chapter number; blanks are nulls."""
    number = F.when(F.col("chapter_num").isNotNull(), F.concat(F.lit("Chapter "), F.col("chapter_num")))
    return chunks.withColumns({"chapter_ref": F.coalesce(filled(F.col("chapter_ref")), number), "text_translation": filled(F.col("text_translation"))})


def with_dates(chunks: DataFrame, raw: str) -> DataFrame:
    """date_approx and date_ref from a free-form date column."""
    parts = parse_int_ref(F.col(raw))
    return chunks.withColumns({"date_approx": parts["number"], "date_ref": parts["ref"]})


def union_chunks(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def chapter_number(path: Column) -> Column:
    """The number after "ch" in a file's name."""
    return F.regexp_extract(path, r"ch(\d+)[^/]*$", 1).try_cast("int")


def read_chapters(spark: SparkSession, glob: str) -> DataFrame:
    """(path, chapter_num, text): one row for each whole file, in the order of names."""
    files = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.withColumn("chapter_num", chapter_number(F.col("path"))).orderBy("path")


def newest_new(before: DataFrame, after: DataFrame) -> DataFrame:
    """The newest of the files that came between two listings (path, modificationTime); one row, or none."""
    new = after.join(before.select("path"), "path", "left_anti")
    return new.agg(F.max(F.struct("modificationTime", "path")).alias("f")).where("f IS NOT NULL").select("f.path", "f.modificationTime")


def slugs(whole: Column) -> Column:
    """array<struct<n, slug>>: first column of a headerless CSV text with its line number from 1; blank lines count but go."""
    cell = lambda line: F.btrim(F.btrim(F.split(line, ",")[0]), F.lit('"'))
    lines = F.transform(F.split(whole, r"\r?\n", -1), lambda line, i: F.struct((i + 1).alias("n"), cell(line).alias("slug"), line.alias("line")))
    return F.transform(F.filter(lines, lambda x: F.btrim(x["line"]) != ""), lambda x: F.struct(x["n"].alias("n"), x["slug"].alias("slug")))


def read_slugs(spark: SparkSession, path: str) -> DataFrame:
    """(n, slug) of a file of some lines, read whole."""
    return spark.read.text(path, wholetext=True).select(F.inline(slugs(F.col("value"))))


def asked_questions(rows: DataFrame) -> DataFrame:
    """Rows whose text isn't blank, trimmed."""
    return rows.withColumn("text", F.btrim("text")).where("text <> ''")


def numbered_questions(rows: DataFrame, order: str, numbers: list[int] | None = None) -> DataFrame:
    """Non-blank questions with n, their number from 1 by `order`, optionally only some of the numbers.

    Numbers are dealt without one task for all rows: ranges of `order` are counted, then numbered on their own."""
    rows = asked_questions(rows)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id())
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_m"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    shift = F.broadcast(sizes.select("_p", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_shift")))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    out = ranged.withColumn("_i", within).join(shift, "_p").withColumn("n", (F.col("_shift") + F.col("_i")).cast("long")).drop("_p", "_i", "_shift")
    return out.where(F.col("n").isin(numbers)) if numbers else out


def pre_text(page: Column) -> Column:
    """The first <pre> element's text with character references decoded; an error if there is none."""
    inner = F.regexp_extract(page, r"(?s)<pre>(.*?)</pre>", 1)
    return F.when(page.rlike(r"(?s)<pre>.*?</pre>"), unescape(inner)).otherwise(F.raise_error(F.lit("no <pre> element")))


def between(text: Column, start: str, end: str) -> Column:
    """What follows the first `start`, through the next `end`; an error if either is missing."""
    at = F.instr(text, start)
    rest = F.substring(text, at + F.lit(len(start)), F.char_length(text))
    stop = F.instr(rest, end)
    return F.when((at > 0) & (stop > 0), F.substring(rest, F.lit(1), stop + F.lit(len(end) - 1))).otherwise(F.raise_error(F.lit("marker missing")))


#: Element kinds whose content is no running text; what follows them stays.
TEI_SKIPPED = frozenset("note bibl ref head gap milestone figure label teiHeader".split())
TEI_SECTIONS = ("div[@subtype='section']", "div[@type='textpart']", "div1[@type='section']", "div1", "div[@n]")


def _kinds(tag: str, attributes: dict[str, str]) -> list[bool]:
    """Which of TEI_SECTIONS an element is."""
    return [tag == "div" and attributes.get("subtype") == "section", tag == "div" and attributes.get("type") == "textpart", tag == "div1" and attributes.get("type") == "section", tag == "div1", tag == "div" and "n" in attributes]


class _Walk:
    """One pass over a document's events, whatever its size; nothing but the text of open sections is held."""

    def __init__(self, xml: str | bytes):
        self.depth, self.body = 0, 0  # depth of the first body element below the root, once it is open
        self.had_body = False
        # Names without their namespaces; declared encodings count for bytes only.
        self.parser = expat.ParserCreate("utf-8" if isinstance(xml, str) else None, "}")
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._end
        self.parser.SkippedEntityHandler = self._entity
        self.xml = xml

    def _entity(self, name: str, is_parameter: bool) -> None:
        if not is_parameter:
            raise ValueError(f"undefined entity &{name};")

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        tag, self.depth = name.rpartition("}")[2], self.depth + 1
        self.start(tag, attributes)
        if tag == "body" and self.depth > 1 and not self.had_body:
            self.body, self.had_body = self.depth, True

    def _end(self, name: str) -> None:
        if self.body == self.depth:
            self.body = 0
        self.end(name.rpartition("}")[2])
        self.depth -= 1

    def steps(self, size: int = 1 << 20) -> Iterator[None]:
        for a in range(0, len(self.xml), size):
            part = self.xml[a : a + size]
            self.parser.Parse(part.encode() if isinstance(part, str) else part, False)
            yield
        self.parser.Parse(b"", True)
        yield


class _Count(_Walk):
    """Numbers of elements of each kind in the body and in all."""

    def __init__(self, xml: str | bytes):
        self.inside, self.all = [0] * len(TEI_SECTIONS), [0] * len(TEI_SECTIONS)
        super().__init__(xml)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if self.depth > 1:
            for i, hit in enumerate(_kinds(tag, attributes)):
                self.all[i] += hit
                self.inside[i] += hit and self.body > 0

    def end(self, tag: str) -> None:
        pass


class _Sections(_Walk):
    """Sections of one kind as their elements end: (ord, n, text). A skipped child's content goes, and what follows it continues the text before."""

    def __init__(self, xml: str | bytes, kind: int, in_body: bool):
        self.kind, self.in_body = kind, in_body
        self.open: list[dict] = []
        self.done: list[tuple[int, str, str]] = []
        self.n = 0
        super().__init__(xml)
        self.parser.CharacterDataHandler = self._text

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        for s in self.open:
            if s["skip"] or tag in TEI_SKIPPED:
                s["skip"] += 1
            else:
                s["text"].append(" ")
        if self.depth > 1 and (self.body or not self.in_body) and _kinds(tag, attributes)[self.kind] and (n := (attributes.get("n") or "").strip()):
            self.open.append({"depth": self.depth, "ord": self.n, "n": n, "skip": 0, "text": []})
            self.n += 1

    def _text(self, data: str) -> None:
        for s in self.open:
            if not s["skip"]:
                s["text"].append(data)

    def end(self, tag: str) -> None:
        if self.open and self.open[-1]["depth"] == self.depth:
            s = self.open.pop()
            text = unicodedata.normalize("NFC", "".join(s["text"])).translate({0xFEFF: None, 0x200B: None})
            self.done.append((s["ord"], s["n"], re.sub(r"\s+", " ", text).strip()))
        for s in self.open:
            if s["skip"]:
                s["skip"] -= 1
            else:
                s["text"].append(" ")


def tei_sections(xml: str | bytes) -> Iterator[tuple[int, str, str]]:
    """(ord, n, text) of the numbered sections, of the first of TEI_SECTIONS that the body (the whole, if there is none) has, as
    they end. The first pass finds which that is, and whether the document is well-formed at all."""
    count = _Count(xml)
    for _ in count.steps():
        pass
    found = count.inside if count.had_body else count.all
    kind = next((i for i, n in enumerate(found) if n), None)
    if kind is None:
        return
    walk = _Sections(xml, kind, count.had_body)
    for _ in walk.steps():
        yield from walk.done
        walk.done.clear()


def parse_tei(files: DataFrame) -> DataFrame:
    """(work, side, section_ref, ord, text, error) from (work, side, xml: string or binary): every numbered section with text, or a row with the error of a
    file that isn't well-formed or is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["work", "side", "section_ref", "ord", "text", "error"]
        for b in batches:
            rows: list[tuple] = []
            for work, side, xml in zip(b["work"], b["side"], b["xml"], strict=True):
                try:
                    if xml is None:
                        raise ValueError("no content")
                    for i, n, text in tei_sections(xml):
                        if text:
                            rows.append((work, side, n, i, text, None))
                        if len(rows) >= 1000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except (expat.ExpatError, ValueError) as e:
                    rows.append((work, side, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("work", "side", "xml").mapInPandas(run, "work string, side string, section_ref string, ord int, text string, error string")


def read_tei(files: DataFrame) -> DataFrame:
    """(work, side, section_ref, ord, text): sections with text, the first of each number; files that don't parse give none (see tei_rejects)."""
    w = Window.partitionBy("work", "side", "section_ref").orderBy("ord")
    rows = parse_tei(files).where("error IS NULL").drop("error")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tei_rejects(files: DataFrame) -> DataFrame:
    """(work, side, error) of the files that don't parse."""
    return parse_tei(files).where("error IS NOT NULL").select("work", "side", "error")


def tei_files(spark: SparkSession, path: str, side: str) -> DataFrame:
    """(work, side, xml) of a folder of files, their bytes as they are; the work is the file's name without its end."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\.xml$", 1).alias("work"), F.lit(side).alias("side"), F.col("content").alias("xml"))


def align(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows with the right side's text as text_translation, '' where it has none."""
    other = right.select(*on, F.col("text").alias("text_translation"), F.lit(True).alias("_hit"))
    return left.join(other, on, "left").withColumns({"aligned": F.coalesce("_hit", F.lit(False)), "text_translation": F.coalesce("text_translation", F.lit(""))}).drop("_hit")


def alignment_rate(aligned: DataFrame, by: str, floor: float = DEFAULTS.alignment_floor) -> DataFrame:
    rate = F.avg(F.col("aligned").cast("double"))
    return aligned.groupBy(by).agg(F.count("*").alias("n"), F.round(rate, 6).alias("rate"), (rate < floor).alias("warn"))

