"""Queries of the citation, verification and answer stages over the driver's tables, with the same in SQL.

Twelve documents in a row are the sources of a question; their labels, as a verifier's JSON, are the claims of its draft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hexapla.config import DEFAULTS as S
from hexapla.functions import text as tx
from hexapla.functions.ids import uuid5
from hexapla.operators import cite, select
from hexapla.operators.providers import Providers
from hexapla.plans import answer, prompts
from hexapla.sources import sinks


def _t(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(number: Column, *values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def found(spark, sf_dir) -> DataFrame:
    """Sources of questions: query_id, source_n and a chunk's columns."""
    n, none = F.col("doc_id"), F.lit(None).cast("string")
    return _t(spark, sf_dir, "documents").select(
        F.floor(n / 12).alias("query_id"), (n % 12 + 1).cast("int").alias("source_n"), F.concat(F.lit("doc"), n).alias("chunk_id"), F.coalesce(_of(n, "chinese-medicine", "greek-medicine", "medieval-european", None), "lang").alias("tradition"),
        F.coalesce(_of(n, "zh-classical", "grc", "la-medieval", None), "lang").alias("language"), F.col("source").alias("source_text"), F.when(n % 2 == 0, F.concat(F.lit("Chapter "), n)).alias("chapter_ref"), F.col("lang").alias("section"), none.alias("section_ref"),
        F.when(n % 5 == 0, F.lit("c. 400 BCE")).alias("date_label"), F.col("n_chars").cast("int").alias("date_approx"), F.when(n % 7 == 0, F.concat(F.lit("urn:x:"), n)).alias("source_urn"), "text",
        F.when(n % 3 == 0, F.concat(F.lit("English of "), n)).alias("text_translation"), ((n % 10) / 10.0).cast("double").alias("score"), F.round(F.lit(1.0) / (60 + n % 12 + 1), 9).cast("double").alias("rrf"),
    )


_FOUND = """found AS (SELECT doc_id // 12 AS query_id, (doc_id % 12 + 1)::INT AS source_n, 'doc' || doc_id AS chunk_id, coalesce(['chinese-medicine', 'greek-medicine', 'medieval-european', NULL][doc_id % 4 + 1], lang) AS tradition,
  coalesce(['zh-classical', 'grc', 'la-medieval', NULL][doc_id % 4 + 1], lang) AS language, source AS source_text, CASE WHEN doc_id % 2 = 0 THEN 'Chapter ' || doc_id END AS chapter_ref, lang AS section, NULL::VARCHAR AS section_ref,
  CASE WHEN doc_id % 5 = 0 THEN 'c. 400 BCE' END AS date_label, n_chars::INT AS date_approx, CASE WHEN doc_id % 7 = 0 THEN 'urn:x:' || doc_id END AS source_urn, text, CASE WHEN doc_id % 3 = 0 THEN 'English of ' || doc_id END AS text_translation,
  CASE WHEN doc_id % 10 = 0 THEN round(1.0::DOUBLE / (60 + doc_id % 12 + 1), 9) ELSE (doc_id % 10)::DOUBLE / 10 END AS score FROM documents)"""


def drafts(spark, sf_dir) -> DataFrame:
    """A draft of each question: (query_id, n_chunks, draft)."""
    q = F.col("query_id")
    markers = _of(q, "as one says [SOURCE 2, 40] and [sources 1, 3].", "with nothing cited.", "see [SOURCE 5–7] and [SOURCE 11].", "so [SOURCE 1].")
    return found(spark, sf_dir).groupBy("query_id").agg(F.count("*").cast("int").alias("n_chunks")).select("query_id", "n_chunks", F.concat(F.lit("Draft "), q, F.lit(", "), markers).alias("draft"))


_DRAFTS = """drafts AS (SELECT query_id, count(*)::INT AS n_chunks, 'Draft ' || query_id || ', ' || ['as one says [SOURCE 2, 40] and [sources 1, 3].', 'with nothing cited.', 'see [SOURCE 5–7] and [SOURCE 11].', 'so [SOURCE 1].'][query_id % 4 + 1] AS draft FROM found GROUP BY query_id)"""


def raw_verdicts(spark, sf_dir) -> DataFrame:
    """(query_id, raw): plain and fenced JSON, with entries of many kinds; each seventh isn't readable, each eleventh isn't an object."""
    n = F.col("doc_id")
    entry = _of(
        n, '{"claim": "c@", "cited_sources": [#, "9"], "supported": $, "issue": ""}', '{"claim": "c@", "cited_sources": ["#", -1, "x", null, 2.5], "supported": $, "issue": "i@"}', '"no object @"', '{"cited_sources": null, "issue": "only @"}',
        '{"claim": "c@", "cited_sources": [#, 77], "supported": "yes"}', '{"claim": null, "cited_sources": 3, "supported": 0, "issue": null}', "[#]",
    )
    for mark, value in (("@", n.cast("string")), ("#", (n % 12 + 1).cast("string")), ("$", F.when(F.col("quality") == 1, "true").otherwise("false"))):
        entry = F.replace(entry, F.lit(mark), value)
    rows = _t(spark, sf_dir, "labels").groupBy(F.floor(n / 12).alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]), ", ").alias("checks"))
    q = F.col("query_id")
    whole = F.concat(F.lit('{"claim_checks": ['), "checks", F.lit('], "report": "report '), q, F.lit('", "needs_more_retrieval": '), _of(q, "true", "false", "null", '"later"', "0"), F.lit("}"))
    raw = F.when(q % 7 == 6, "no JSON").when(q % 11 == 10, "[1, 2]").when(q % 2 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    return rows.select("query_id", raw.alias("raw"))


_VERDICTS = """marks AS (SELECT doc_id // 12 AS query_id, string_agg(replace(replace(replace(['{"claim": "c@", "cited_sources": [#, "9"], "supported": $, "issue": ""}', '{"claim": "c@", "cited_sources": ["#", -1, "x", null, 2.5], "supported": $, "issue": "i@"}', '"no object @"',
    '{"cited_sources": null, "issue": "only @"}', '{"claim": "c@", "cited_sources": [#, 77], "supported": "yes"}', '{"claim": null, "cited_sources": 3, "supported": 0, "issue": null}', '[#]'][doc_id % 7 + 1], '@', doc_id::VARCHAR), '#', (doc_id % 12 + 1)::VARCHAR), '$', (quality = 1)::VARCHAR), ', ' ORDER BY doc_id) AS checks FROM labels GROUP BY 1),
body AS (SELECT d.query_id, n_chunks, draft, CASE WHEN checks IS NOT NULL AND d.query_id % 7 <> 6 AND d.query_id % 11 <> 10 THEN '{"claim_checks": [' || checks || ']}' END AS j FROM drafts d LEFT JOIN marks m ON m.query_id = d.query_id),
entries AS (SELECT query_id, n_chunks, i, e[i] AS c FROM (SELECT query_id, n_chunks, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT query_id, n_chunks, json_extract(j, '$.claim_checks[*]') AS e FROM body WHERE j IS NOT NULL))),
listed AS (SELECT *, CASE WHEN json_type(c, '$.cited_sources') = 'ARRAY' THEN list_transform(list_filter(json_extract_string(c, '$.cited_sources[*]'), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::INT) ELSE [] END AS s FROM entries WHERE json_type(c) = 'OBJECT'),
claims AS (SELECT query_id, n_chunks, row_number() OVER (PARTITION BY query_id ORDER BY i) AS pos, coalesce(json_extract_string(c, '$.claim'), '') AS claim, s, coalesce(json_extract_string(c, '$.supported') IN ('true', 'yes'), false) AS supported, coalesce(json_extract_string(c, '$.issue'), '') AS issue FROM listed),
resolved AS (SELECT *, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(draft, '(?i)\\[\\s*SOURCES?\\s+([^\\]]+?)\\s*\\]', 1), lambda b: list_transform(regexp_extract_all(b, '\\d+'), lambda x: x::INT))))) AS cited FROM body),
parts AS (SELECT *, coalesce(list_filter(cited, lambda x: x BETWEEN 1 AND n_chunks), []) AS inside, coalesce(list_filter(cited, lambda x: NOT x BETWEEN 1 AND n_chunks), []) AS dangling FROM resolved),
flags AS (SELECT *, '[' || array_to_string(dangling, ', ') || ']' AS gone FROM parts),
issues AS (SELECT *, list_filter([CASE WHEN len(dangling) > 0 THEN 'Draft cites nonexistent sources ' || gone || '; only [SOURCE 1]–[SOURCE ' || n_chunks || '] were retrieved.' END, CASE WHEN len(coalesce(cited, [])) = 0 THEN 'Draft contains no [SOURCE N] citations.' END], lambda x: x IS NOT NULL) AS structural FROM flags),
unsupported AS (SELECT query_id, list('[SOURCE ' || coalesce(nullif(array_to_string(s, ','), ''), '—') || '] ' || coalesce(nullif(issue, ''), 'unsupported') || ': ' || claim ORDER BY pos) AS lines FROM claims WHERE NOT supported GROUP BY 1),
checked AS (SELECT i.*, list_concat(structural, coalesce(lines, [])) AS flagged, list_concat(structural, CASE WHEN len(dangling) > 0 THEN ['Citations to nonexistent sources: ' || gone || '.'] ELSE [] END) AS broken, len(structural) = 0 AND lines IS NULL AS passed,
  array_to_string(list_concat(structural, [CASE WHEN j IS NULL THEN 'Proofreading parse failed; treated as inconclusive.' ELSE 'report ' || i.query_id END]), ' ') AS report, j IS NOT NULL AND i.query_id % 5 IN (0, 3) AS needs_more FROM issues i LEFT JOIN unsupported u ON u.query_id = i.query_id)"""
_BASE = f"WITH {_FOUND}, {_DRAFTS}, {_VERDICTS}"


def _checked(spark, sf_dir) -> DataFrame:
    rows = drafts(spark, sf_dir).join(raw_verdicts(spark, sf_dir), "query_id", "left")
    return answer.checked(rows.select("query_id", "n_chunks", "draft", F.coalesce("raw", F.lit("")).alias("raw")), F.col("raw")).drop("raw")


def claim_verdicts(spark, sf_dir):
    rows = _checked(spark, sf_dir).select("query_id", F.posexplode("claims").alias("pos", "c"))
    join = lambda c: F.array_join(F.col(f"c.{c}").cast("array<string>"), ",").alias(c)
    return rows.select("query_id", (F.col("pos") + 1).cast("long").alias("pos"), "c.claim", join("cited_sources"), join("out_of_range"), "c.supported", "c.issue")


def claim_report(spark, sf_dir):
    join = lambda c: F.array_join(c, "\n").alias(c)
    return _checked(spark, sf_dir).select("query_id", "passed", "needs_more", "report", join("structural"), join("flagged"), join("broken"))


def provenance(spark, sf_dir):
    """What the sources of each question are, by their number; those cited are marked."""
    rows = found(spark, sf_dir).join(_checked(spark, sf_dir).select("query_id", "in_range"), "query_id")
    return rows.select("query_id", cite.provenance(F.col("source_n")).alias("p"), F.array_contains("in_range", F.col("source_n")).alias("cited")).select("query_id", "p.*", "cited")


def context_blocks(spark, sf_dir):
    return cite.context(found(spark, sf_dir))


_HEAD = "'[SOURCE ' || source_n || '] ' || concat_ws(' | ', source_text, section, tradition, date_label, 'id=' || chunk_id)"
_BODY = "CASE WHEN text_translation IS NULL THEN 'Original (' || language || ', no translation available): ' ELSE 'English: ' || text_translation || chr(10) || 'Original (' || language || '): ' END || trim(text)"
_CONTEXT = f"SELECT query_id, string_agg({_HEAD} || chr(10) || {_BODY}, chr(10) || chr(10) ORDER BY source_n) AS context FROM found GROUP BY query_id"


def extractive_drafts(spark, sf_dir):
    """The stand-in for a writing model over each question's context, its prompt included."""
    p = Providers()
    c = cite.context(found(spark, sf_dir)).withColumn("prompt", prompts.filled(prompts.SYNTHESIS, question=F.col("query_id"), context=F.col("context")))
    draft = c.select("query_id", tx.strip_think(p.chat(p.write, F.col("prompt"))).alias("draft"))
    return draft.select("query_id", F.array_join(F.regexp_extract_all("draft", F.lit(r"\[SOURCE (\d+)\](?:\n|$)"), 1), ",").alias("markers"), F.substring_index("draft", " [SOURCE 1]", 1).alias("first"))


_REFERENCE = """regexp_replace(CASE WHEN tradition LIKE '%greek%' THEN 'Hippocrates, ' WHEN tradition LIKE '%medieval%' THEN 'Hildegard of Bingen, ' ELSE '' END || '*' || source_text || CASE WHEN tradition LIKE '%chinese%' THEN ' (黄帝内经素問)' ELSE '' END || '*, ' || coalesce(chapter_ref, section)
  || coalesce(' (' || date_label || ')', '') || coalesce('. ' || source_urn, '') || CASE WHEN tradition LIKE '%greek%' THEN '. Greek text and English translation: Perseus Digital Library.' WHEN tradition LIKE '%chinese%' THEN '. English translation: LLM-assisted (unreviewed).'
  WHEN tradition LIKE '%medieval%' THEN '. Latin from OCR; English translation: LLM-assisted (unreviewed).' ELSE '' END, '[. ]+$', '') || '.'"""
_FLAT = "trim(regexp_replace(%s, '\\s+', ' ', 'g'))"
_CLIP = f"CASE WHEN length({_FLAT}) > {S.clip} THEN rtrim(left({_FLAT}, {S.clip})) || ' […]' ELSE {_FLAT} END"
_CITED = f"""said AS (SELECT query_id, n, bool_or(NOT supported) AS bad, bool_or(supported) AS good FROM (SELECT query_id, supported, unnest(s) AS n FROM claims) GROUP BY ALL),
picked AS (SELECT query_id, unnest(inside) AS source_n FROM checked),
records AS (SELECT f.query_id, f.source_n, chunk_id, source_urn, {_REFERENCE} AS formatted, CASE WHEN bad THEN 'disputed' WHEN good THEN 'verified' ELSE 'cited' END AS verification, score, language, {_FLAT % 'text'} AS original, coalesce({_FLAT % 'text_translation'}, '') AS translation,
  text, text_translation FROM picked p JOIN found f ON f.query_id = p.query_id AND f.source_n = p.source_n LEFT JOIN said s ON s.query_id = f.query_id AND s.n = f.source_n)"""


def citation_records(spark, sf_dir):
    rows = answer.assembled(_checked(spark, sf_dir), found(spark, sf_dir))
    return rows.select("query_id", F.inline("citation_records"))


def cited_answers(spark, sf_dir):
    """Drafts through markers, verdicts, references and assembly, to the final answer."""
    return answer.assembled(_checked(spark, sf_dir), found(spark, sf_dir)).select("query_id", "passed", "status", "answer")


_ANSWERS = f"""{_BASE}, {_CITED}, refs AS (SELECT query_id, string_agg('[SOURCE ' || source_n || '] ' || formatted || CASE WHEN verification = 'disputed' THEN '  ⚠ unverified — see proofreading flags' ELSE '' END || coalesce(chr(10) || '    - *Translation:* ' || {_CLIP.replace('%s', 'text_translation')}, '')
  || CASE WHEN text <> '' THEN chr(10) || '    - *Original (' || language || '):* ' || {_CLIP.replace('%s', 'text')} ELSE '' END, chr(10) || chr(10) ORDER BY source_n) AS r FROM records GROUP BY 1), counted AS (SELECT query_id, count(*) AS n FROM claims GROUP BY 1)
SELECT c.query_id, passed, CASE WHEN j IS NULL OR n IS NULL THEN 'inconclusive' ELSE 'checked' END AS status, draft || chr(10) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**References**' || chr(10) || chr(10) || coalesce(r, '_No sources were cited in the synthesis._')
  || CASE WHEN n_chunks > len(inside) THEN chr(10) || chr(10) || '_' || (n_chunks - len(inside)) || ' additional passage(s) retrieved but not cited._' ELSE '' END || chr(10) || chr(10) || '**Proofreading**: ' || report
  || CASE WHEN len(flagged) > 0 THEN chr(10) || chr(10) || '⚠ **Proofreading flags:**' || chr(10) || '• ' || array_to_string(flagged, chr(10) || '• ') ELSE '' END || CASE WHEN len(broken) > 0 THEN chr(10) || chr(10) || '⚠ **Citation integrity:**' || chr(10) || '• ' || array_to_string(broken, chr(10) || '• ') ELSE '' END AS answer
FROM checked c LEFT JOIN refs USING (query_id) LEFT JOIN counted USING (query_id)"""


def _traces(spark, sf_dir) -> DataFrame:
    done = answer.assembled(_checked(spark, sf_dir), found(spark, sf_dir))
    none, no = F.lit(None).cast("int"), F.array().cast("array<string>")
    whole = done.withColumns({"text": F.lit("q"), "expanded_query": F.lit("q"), "medical_concepts": no, "traditions": no, "relevant_languages": no, "date_from": none, "date_to": none, "iteration": (F.col("query_id") % 3).cast("int")})
    return answer.traces(whole, found(spark, sf_dir), F.timestamp_seconds(F.col("query_id")))


def trace_signals(spark, sf_dir):
    """Traces as JSON lines, between lines that are none, read back for a suite."""
    lines = sinks.trace_lines(_traces(spark, sf_dir)).unionByName(_t(spark, sf_dir, "benchmark").select(F.concat(F.lit("{cut "), "text").alias("value")))
    return answer.signals(sinks.parse_traces(lines, answer.SIGNALS))


def trace_retrieved(spark, sf_dir):
    """Sources in traces, in order, and those that the answers cite."""
    rows = _traces(spark, sf_dir)
    return rows.select("query_id", F.inline("retrieved"), F.transform("resolved_citations", lambda r: r["source_n"]).alias("n")).withColumn("cited", F.array_contains("n", F.col("source_n"))).drop("n")


def trace_names(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", sinks.trace_name(F.col("ts"), F.concat("event_type", F.lit(" of user "), "user_id"), F.concat(F.lit("id"), F.format_string("%08d", "event_id"))).alias("name"))


def answer_documents(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    trace = F.when(F.col("event_id") % 3 > 0, F.col("event_id").cast("string"))
    return e.select("event_id", sinks.markdown(F.col("event_type"), F.col("ts"), trace, F.when(F.col("event_id") % 4 > 0, F.col("props"))).alias("document"))


def _suite(spark, sf_dir) -> DataFrame:
    """A user's events are a question's run: it begins and ends with them, and an error among them fails it."""
    e = _t(spark, sf_dir, "events")
    asked = e.groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 50), "failed")).alias("err"))
    q = asked.select(F.col("user_id").alias("n"), F.col("user_id").alias("query_id"), F.concat(F.lit("q"), "user_id").alias("id"), F.lit("probe").alias("probes"), F.lit("Why?").alias("question"), "started", "ended", F.coalesce("err", F.lit("")).alias("err"), F.lit("t").alias("trace"), F.lit("e").alias("export"))
    return answer.suite(q, _traces(spark, sf_dir))


def suite_rows(spark, sf_dir):
    return _suite(spark, sf_dir).select(*sinks.SUITE_COLUMNS)


def suite_totals(spark, sf_dir):
    return sinks.suite_totals(_suite(spark, sf_dir))


def suite_lines(spark, sf_dir):
    return _suite(spark, sf_dir).select("n", sinks.suite_line(sinks.SUITE_TABLE.values()).alias("line"))


def suite_pages(spark, sf_dir):
    return _suite(spark, sf_dir).select("n", sinks.suite_page(F.when(F.col("n") % 2 > 0, F.lit("An answer."))).alias("page"))


def select_several_traditions(spark, sf_dir):
    """Diversified selection where a source has several traditions: its floors take two of each in turn, a source gives three at most."""
    rows = _t(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 30).alias("query_id"), F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 4).cast("string").alias("source"), (F.col("doc_id") % 3).cast("string").alias("tradition"), (F.col("doc_id") % 3).cast("int").alias("floor_no"), (F.col("doc_id") % 30 + 1).cast("int").alias("rank"), (-F.col("doc_id")).cast("double").alias("score"))
    return select.diversify(rows).select("query_id", "chunk_id", "sel_pos", "source_n")


_GREEDY = f"""WITH RECURSIVE rows AS (SELECT doc_id // 30 AS q, doc_id AS c, (doc_id % 4)::INT AS s, (doc_id % 3)::INT AS t, doc_id % 30 AS r FROM documents), steps AS (SELECT q, c, s, t, row_number() OVER (PARTITION BY q ORDER BY phase, r) AS i, phase FROM (SELECT q, c, s, t, r, t AS phase FROM rows UNION ALL SELECT q, c, s, t, r, 3 FROM rows UNION ALL SELECT q, c, s, t, r, 4 FROM rows)),
walk AS (SELECT q, 0::BIGINT AS i, []::BIGINT[] AS taken, [0, 0, 0, 0] AS used, [0, 0, 0] AS floors FROM (SELECT DISTINCT q FROM rows)
  UNION ALL SELECT w.q, w.i + 1, CASE WHEN ok THEN list_append(taken, c) ELSE taken END, CASE WHEN ok THEN list_transform(used, lambda x, k: x + (k = s + 1)::INT) ELSE used END, CASE WHEN ok AND phase < 3 THEN list_transform(floors, lambda x, k: x + (k = t + 1)::INT) ELSE floors END
  FROM (SELECT w.*, x.c, x.s, x.t, x.phase, len(taken) < {S.top_k} AND NOT list_contains(taken, x.c) AND (x.phase = 4 OR used[x.s + 1] < {S.per_source}) AND (x.phase > 2 OR floors[x.t + 1] < {S.min_per_group}) AS ok FROM walk w JOIN steps x ON x.q = w.q AND x.i = w.i + 1) w),
last AS (SELECT q, arg_max(taken, i) AS taken FROM walk GROUP BY q), picked AS (SELECT q, taken[k] AS c, k FROM (SELECT q, taken, unnest(range(1, len(taken) + 1)) AS k FROM last))
SELECT q AS query_id, c AS chunk_id, k::INT AS sel_pos, row_number() OVER (PARTITION BY q ORDER BY c, k)::INT AS source_n FROM picked"""

_NAMES = """claim_verdicts claim_report provenance context_blocks extractive_drafts citation_records cited_answers trace_signals trace_retrieved trace_names answer_documents
suite_rows suite_totals suite_lines suite_pages select_several_traditions"""


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


_SIGNALS = "signals AS (SELECT f.query_id, any_value(n_chunks) AS n_retrieved, string_agg(DISTINCT tradition, ',' ORDER BY tradition) AS traditions, any_value(array_to_string(coalesce(cited, []), ',')) AS cited, any_value(passed) AS passed, (f.query_id % 3)::INT AS iters FROM found f JOIN checked c ON c.query_id = f.query_id GROUP BY f.query_id)"
_SUITE = f"""{_BASE}, {_SIGNALS}, suite AS (SELECT user_id AS n, 'q' || user_id AS id, CASE WHEN failed THEN 'error' ELSE 'ok' END AS status, round(epoch_us(ended) / 1e6 - epoch_us(started) / 1e6, 1) AS sec, n_retrieved, traditions, cited, passed, iters, 't' AS trace, 'e' AS export, 'probe' AS probes,
  CASE WHEN failed THEN 'failed' ELSE '' END AS err FROM (SELECT user_id, min(ts) AS started, max(ts) AS ended, bool_or(event_type = 'error' AND value > 50) AS failed FROM events GROUP BY 1) e LEFT JOIN signals s ON s.query_id = e.user_id)"""
#: Numbers as Spark writes them.
_SEC = "CASE WHEN sec >= 1e7 THEN printf('%.15g', sec / pow(10, floor(log10(sec)))) || CASE WHEN sec / pow(10, floor(log10(sec))) = floor(sec / pow(10, floor(log10(sec)))) THEN '.0' ELSE '' END || 'E' || floor(log10(sec))::INT ELSE printf('%.1f', sec) END"


def oracle_sql() -> dict[str, str]:
    join = lambda c: f"array_to_string({c}, chr(10)) AS {c}"
    return {
        "claim_verdicts": f"{_BASE} SELECT query_id, pos, claim, array_to_string(s, ',') AS cited_sources, array_to_string(list_filter(s, lambda x: NOT x BETWEEN 1 AND n_chunks), ',') AS out_of_range, supported, issue FROM claims",
        "claim_report": f"{_BASE} SELECT query_id, passed, needs_more, report, {join('structural')}, {join('flagged')}, {join('broken')} FROM checked",
        "provenance": f"{_BASE} SELECT f.query_id, source_n, chunk_id, source_text, source_urn, language, tradition, date_approx, date_label, chapter_ref, section, section_ref, score, list_contains(inside, source_n) AS cited FROM found f JOIN checked c ON c.query_id = f.query_id",
        "context_blocks": f"WITH {_FOUND} {_CONTEXT}",
        "extractive_drafts": f"""WITH {_FOUND} SELECT query_id, string_agg(source_n::VARCHAR, ',' ORDER BY source_n) AS markers, max(CASE WHEN source_n = 1 THEN left(trim(regexp_extract(text_translation || chr(10) || 'Original (' || language || '): ' || trim(text), '(?s)^[^.?!。]*[.?!。]?')), 200) END) AS first FROM found GROUP BY query_id""",
        "citation_records": f"{_BASE}, {_CITED} SELECT * EXCLUDE (text, text_translation) FROM records",
        "cited_answers": _ANSWERS,
        "trace_signals": f"{_BASE}, {_SIGNALS} SELECT * FROM signals",
        "trace_retrieved": f"{_BASE} SELECT f.query_id, source_n, chunk_id, source_urn, source_text, section, chapter_ref, tradition, (regexp_extract(chunk_id, '\\d+')::INT % 10)::DOUBLE / 10 AS score, list_contains(inside, source_n) AS cited FROM found f JOIN checked c ON c.query_id = f.query_id",
        "trace_names": "SELECT event_id, strftime(ts, '%Y-%m-%d_%H%M%S') || '_' || event_type || '-of-user-' || user_id || '_' || left('id' || lpad(event_id::VARCHAR, 8, '0'), 8) AS name FROM events",
        "answer_documents": "SELECT event_id, '# Answer' || chr(10) || chr(10) || '- **Date of input:** ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || '- **Query:** ' || event_type || chr(10) || CASE WHEN event_id % 3 > 0 THEN '- **Trace ID:** ' || event_id || chr(10) ELSE '' END || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN event_id % 4 > 0 THEN props ELSE '(no answer produced)' END || chr(10) AS document FROM events",
        "suite_rows": f"{_SUITE} SELECT * FROM suite",
        "suite_totals": f"{_SUITE} SELECT count(*) AS n, count(*) FILTER (status = 'ok') AS ok, round(sum(sec), 1) AS sec, round(avg(sec), 3) AS mean_sec, max(sec) AS max_sec FROM suite",
        "suite_lines": f"{_SUITE} SELECT n, '| ' || concat_ws(' | ', n, id, status, {_SEC}, coalesce(traditions, ''), coalesce(cited, ''), coalesce(passed::VARCHAR, ''), coalesce(iters::VARCHAR, '')) || ' |' AS line FROM suite",
        "suite_pages": f"""{_SUITE} SELECT n, '# [' || id || '] probe' || chr(10) || chr(10) || '**Q:** Why?' || chr(10) || chr(10) || '- status: ' || status || CASE WHEN err <> '' THEN ' — ' || err ELSE '' END || chr(10) || '- duration: ' || {_SEC} || 's' || chr(10) || '- traditions retrieved: ' || coalesce(traditions, '') || chr(10)
  || '- cited sources: ' || coalesce(cited, '') || chr(10) || '- proofread passed: ' || coalesce(passed::VARCHAR, '') || '  | iterations: ' || coalesce(iters::VARCHAR, '') || chr(10) || '- trace: t' || chr(10) || '- export: e' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN n % 2 > 0 THEN 'An answer.' ELSE '(no answer)' END || chr(10) AS page FROM suite""",
        "select_several_traditions": _GREEDY,
    }
