"""Citation algebra: markers, provenance, claim verdicts, references, and the final answer, as expressions on
one row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hexapla.config import DEFAULTS, Settings
from hexapla.functions.text import clip, collapse, unfence

#: Fixed format of a source marker: [SOURCE 1], [SOURCES 1, 2], [SOURCE 4, SOURCE 6].
MARKER = r"(?i)\[\s*SOURCES?\s+([^\]]+?)\s*\]"
RANGE = r"(\d+)\s*[-–—]\s*(\d+)"


def upto(n: Column) -> Column:
    """1 to n; empty for 0, where sequence() would count down."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def cited(draft: Column, settings: Settings = DEFAULTS) -> Column:
    """Sorted distinct numbers in all markers."""
    bodies = F.regexp_extract_all(draft, F.lit(MARKER), 1)
    numbers = F.flatten(F.transform(bodies, lambda b: F.transform(F.regexp_extract_all(b, F.lit(r"\d+"), 0), lambda d: d.try_cast("int"))))
    if settings.expand_ranges:
        spans = F.flatten(F.transform(bodies, lambda b: F.transform(F.regexp_extract_all(b, F.lit(RANGE), 0), lambda r: F.sequence(F.regexp_extract(r, RANGE, 1).cast("int"), F.regexp_extract(r, RANGE, 2).cast("int")))))
        numbers = F.concat(numbers, F.flatten(spans))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))


def resolve(df: DataFrame, draft: str = "draft", n: str = "n_chunks", settings: Settings = DEFAULTS) -> DataFrame:
    """Adds cited, in_range, dangling, uncited."""
    count = F.col(n).cast("int")
    df = df.withColumn("cited", cited(F.coalesce(F.col(draft), F.lit("")), settings))
    inside = lambda x: (x >= 1) & (x <= count)
    return df.withColumns({"in_range": F.filter("cited", inside), "dangling": F.filter("cited", lambda x: ~inside(x)), "uncited": F.array_except(upto(count), F.col("cited"))})


def provenance(source_n: Column) -> Column:
    """Where a retrieved chunk comes from; a score of zero counts as none."""
    score = F.coalesce(F.nullif("score", F.lit(0.0)), F.nullif("rrf", F.lit(0.0)))
    names = ["chunk_id", "source_text", "source_urn", "language", "tradition", "date_approx", "date_label", "chapter_ref", "section", "section_ref"]
    return F.struct(source_n.alias("source_n"), *[F.col(c) for c in names], score.alias("score"))


def _no(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _true(value: Column) -> Column:
    """Whether a variant counts as true: not missing, null, false, zero or empty."""
    json = F.to_json(value)
    return F.coalesce(~json.isin("null", "false", '""', "[]", "{}") & ~json.rlike(r"^-?0+(\.0*)?([eE].*)?$"), F.lit(False))


def _json_object(answer: Column) -> Column:
    """A model's JSON answer as a variant; null for what isn't an object."""
    v = F.try_parse_json(unfence(answer))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def claims(answer: Column, n: Column) -> Column:
    """Verdicts of a verifier's JSON answer, typed. Each entry stands alone: what isn't an object goes, sources may be
    numbers or strings of digits, missing fields get defaults, and `supported` counts as true as in a condition."""
    checks = F.coalesce(F.try_variant_get(_json_object(answer), "$.claim_checks", "array<variant>"), _no("variant"))
    field = lambda c, name: F.coalesce(F.try_variant_get(c, f"$.{name}", "string"), F.lit(""))

    def verdict(c: Column) -> Column:
        listed = F.filter(F.coalesce(F.try_variant_get(c, "$.cited_sources", "array<string>"), _no("string")), lambda x: x.rlike("^[0-9]+$"))
        sources = F.filter(F.transform(listed, lambda x: x.try_cast("int")), lambda x: x.isNotNull())
        return F.struct(
            field(c, "claim").alias("claim"), sources.alias("cited_sources"), F.filter(sources, lambda x: (x < 1) | (x > n)).alias("out_of_range"),
            _true(F.try_variant_get(c, "$.supported", "variant")).alias("supported"), field(c, "issue").alias("issue"),
        )

    return F.transform(F.filter(checks, lambda c: F.schema_of_variant(c).startswith("OBJECT")), verdict)


#: Fixed text of a verifier's unreadable answer.
UNREADABLE = "Proofreading parse failed; treated as inconclusive."


def verdict(answer: Column) -> Column:
    """struct(readable, report, needs_more) of a verifier's answer."""
    v = _json_object(answer)
    report = F.when(v.isNull(), F.lit(UNREADABLE)).otherwise(F.coalesce(F.try_variant_get(v, "$.report", "string"), F.lit("")))
    return F.struct(v.isNotNull().alias("readable"), report.alias("report"), _true(F.try_variant_get(v, "$.needs_more_retrieval", "variant")).alias("needs_more"))


def passed(verdicts: Column, structural: Column) -> Column:
    """All claims supported and nothing wrong with the structure; no claims count as supported."""
    return F.forall(verdicts, lambda c: c["supported"]) & (F.size(structural) == 0)


def _listed(numbers: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), ", "), F.lit("]"))


def structural_flags(cited: Column, dangling: Column, n: Column) -> Column:
    """What is wrong with a draft's markers. Fixed texts."""
    return F.array_compact(F.array(
        F.when(F.size(dangling) > 0, F.concat(F.lit("Draft cites nonexistent sources "), _listed(dangling), F.lit("; only [SOURCE 1]–[SOURCE "), n.cast("string"), F.lit("] were retrieved."))),
        F.when((F.size(cited) == 0) & (n > 0), F.lit("Draft contains no [SOURCE N] citations.")),
    ))


def claim_flags(verdicts: Column) -> Column:
    """A line for each unsupported claim. Fixed format."""
    sources = lambda c: F.coalesce(F.nullif(F.array_join(c["cited_sources"].cast("array<string>"), ","), F.lit("")), F.lit("—"))
    line = lambda c: F.concat(F.lit("[SOURCE "), sources(c), F.lit("] "), F.coalesce(F.nullif(c["issue"], F.lit("")), F.lit("unsupported")), F.lit(": "), c["claim"])
    return F.transform(F.filter(verdicts, lambda c: ~c["supported"]), line)


def whole_report(structural: Column, report: Column) -> Column:
    """What is wrong with the structure, then the verifier's report."""
    return F.array_join(F.filter(F.concat(structural, F.array(report)), lambda x: x != ""), " ")


def integrity(structural: Column, dangling: Column) -> Column:
    return F.concat(structural, F.array_compact(F.array(F.when(F.size(dangling) > 0, F.concat(F.lit("Citations to nonexistent sources: "), _listed(dangling), F.lit("."))))))


def citation_status(citations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """citations (query_id, source_n) with status: disputed before verified before cited.

    `verdicts`: query_id, claims (array of verdicts)."""
    each = verdicts.select("query_id", F.explode("claims").alias("c")).select("query_id", F.explode("c.cited_sources").alias("source_n"), "c.supported")
    agreed = each.groupBy("query_id", "source_n").agg(F.bool_or(~F.col("supported")).alias("disputed"), F.bool_or("supported").alias("verified"))
    status = F.when(F.col("disputed"), "disputed").when(F.col("verified"), "verified").otherwise("cited")
    return citations.join(agreed, ["query_id", "source_n"], "left").withColumn("status", status).drop("disputed", "verified")


#: How works of each kind are cited, and what is said of their translations. The first kind that fits holds.
#: (marks in the tradition, beginning of the language, author, note)
KINDS = [
    (("chinese",), "zh", "", "English translation: LLM-assisted (unreviewed)."),
    (("greek",), "grc", "Hippocrates, ", "Greek text and English translation: Perseus Digital Library."),
    (("medieval", "european"), "la", "Hildegard of Bingen, ", "Latin from OCR; English translation: LLM-assisted (unreviewed)."),
]
NOTE_ORDER = (1, 0, 2)
HAN_TITLE = " (黄帝内经素問)"


def _kind(no: int) -> Column:
    marks, language, _, _ = KINDS[no]
    tradition = F.lower(F.coalesce(F.col("tradition"), F.lit("")))
    fits = F.coalesce(F.col("language"), F.lit("")).startswith(language)
    for mark in marks:
        fits = fits | tradition.contains(mark)
    return fits


def _first_kind(order, value) -> Column:
    out = F
    for no in order:
        out = out.when(_kind(no), value(no))
    return out


def reference(settings: Settings = DEFAULTS) -> Column:
    """One formatted reference from chunk columns (tradition, language, source_text, chapter_ref, section, section_ref, date_label, source_urn)."""
    filled = lambda c: F.nullif(F.btrim(F.col(c)), F.lit(""))
    title = F.coalesce(filled("source_text"), F.lit("Untitled passage"))
    han = F.when(_kind(0) & ~title.rlike("[\\u4e00-\\u9fff]"), HAN_TITLE).otherwise("")
    author = _first_kind((0, 1, 2), lambda no: F.lit(KINDS[no][2])).otherwise("")
    locator = F.coalesce(filled("chapter_ref"), filled("section"), filled("section_ref"))
    note = _first_kind(NOTE_ORDER, lambda no: F.lit(KINDS[no][3]))
    whole = F.concat_ws(
        "", author, F.lit("*"), title, han, F.lit("*"), F.concat(F.lit(", "), locator), F.concat(F.lit(" ("), filled("date_label"), F.lit(")")),
        F.concat(F.lit(". "), filled("source_urn")), F.concat(F.lit(". "), note),
    )
    return F.concat(F.regexp_replace(whole, r"[. ]+$", ""), F.lit("."))


def context_block(source_n: Column, settings: Settings = DEFAULTS) -> Column:
    head = F.concat(F.lit("[SOURCE "), source_n.cast("string"), F.lit("] "), F.concat_ws(" | ", "source_text", "section", "tradition", "date_label", F.concat(F.lit("id="), F.col("chunk_id").cast("string"))))
    translation, language = F.nullif(F.btrim("text_translation"), F.lit("")), F.coalesce("language", F.lit(""))
    original = F.concat(F.lit("Original ("), language, F.when(translation.isNull(), ", no translation available").otherwise(""), F.lit("): "), F.btrim(F.coalesce("text", F.lit(""))))
    return F.concat_ws("\n", head, F.concat(F.lit("English: "), translation), original)


def context(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, context): the blocks of a query's selected sources in order; at most top_k of them."""
    blocks = rows.select("query_id", F.struct("source_n", context_block(F.col("source_n")).alias("b")).alias("s"))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["b"]), "\n\n").alias("context"))


def reference_line(settings: Settings = DEFAULTS) -> Column:
    """A reference with its mark, if disputed, and its clipped passages; fixed format."""
    translation, original = (F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in ("text_translation", "text"))
    head = F.concat(F.lit("[SOURCE "), F.col("source_n").cast("string"), F.lit("] "), reference(settings), F.when(F.col("status") == "disputed", "  ⚠ unverified — see proofreading flags").otherwise(""))
    return F.concat_ws(
        "\n", head, F.concat(F.lit("    - *Translation:* "), clip(translation, settings.clip)),
        F.concat(F.lit("    - *Original ("), F.coalesce("language", F.lit("")), F.lit("):* "), clip(original, settings.clip)),
    )


def citation_record(settings: Settings = DEFAULTS) -> Column:
    """A cited source as a trace keeps it: with its status and its whole passages."""
    score = F.coalesce(F.nullif("score", F.lit(0.0)), F.nullif("rrf", F.lit(0.0)))
    whole = lambda c: collapse(F.coalesce(F.col(c), F.lit("")))
    return F.struct("source_n", "chunk_id", "source_urn", reference(settings).alias("formatted"), F.col("status").alias("verification"), score.alias("score"), "language", whole("text").alias("original"), whole("text_translation").alias("translation"))


def final_answer(draft: Column, references: Column, n_uncited: Column, report: Column, flagged: Column, broken: Column) -> Column:
    """Draft, rule, references, uncited count, report, flags of claims, integrity; empty parts go. Fixed format."""
    bullets = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"⚠ **{title}:**\n• "), F.array_join(lines, "\n• ")))
    parts = F.array(
        draft, F.lit("\n---"), F.lit("**References**"),
        F.when(F.size(references) > 0, F.array_join(references, "\n\n")).otherwise(F.lit("_No sources were cited in the synthesis._")),
        F.when(n_uncited > 0, F.concat(F.lit("_"), n_uncited.cast("string"), F.lit(" additional passage(s) retrieved but not cited._"))),
        F.when(report != "", F.concat(F.lit("**Proofreading**: "), report)), bullets("Proofreading flags", flagged), bullets("Citation integrity", broken),
    )
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n\n")
