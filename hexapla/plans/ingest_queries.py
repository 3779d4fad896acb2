"""Queries of the readers, cleaners, chunkers and enrichment over the driver's tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hexapla.config import DEFAULTS as S
from hexapla.functions import text as tx
from hexapla.operators import chunk, index
from hexapla.operators.providers import Batch, Providers, enrich_missing, overlap
from hexapla.plans import prompts
from hexapla.sources import readers, sinks


def _t(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id() -> Column:
    return F.col("doc_id").cast("string")


def _case(of: Column, *values: Column) -> Column:
    """The value whose place the number `of`, modulo their count, has."""
    out = F
    for k, v in enumerate(values[:-1]):
        out = out.when(of % len(values) == k, v)
    return out.otherwise(values[-1])


# --- models -------------------------------------------------------------------------------------------------------
def letter_counts(texts: list[str]) -> list[list[float]]:
    """A model of lists that SQL can follow: how often each letter of a to z occurs."""
    return [[float(t.count(chr(c))) for c in range(97, 123)] for t in texts]


def embed_documents(spark, sf_dir):
    """Every document embedded by a model that takes lists of 32 texts; its vector as text."""
    vector = Providers(embed=Batch(letter_counts)).embedding(tx.embedding_text(F.lit(None).cast("string"), F.col("text")))
    rows = _t(spark, sf_dir, "documents").select("doc_id", vector.alias("vector"))
    return rows.select("doc_id", F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), " ").alias("vector"))


def embed_questions(spark, sf_dir):
    """Every question embedded by a model of single texts."""
    vector = Providers(embed=lambda t: letter_counts([t])[0]).embedding(F.col("text"))
    rows = _t(spark, sf_dir, "benchmark").select("item_id", vector.alias("vector"))
    return rows.select("item_id", F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), " ").alias("vector"))


# --- model answers ------------------------------------------------------------------------------------------------
def strip_think(spark, sf_dir):
    """Conversation turns with reasoning around them: closed, left open at the start, twice, none."""
    c = _t(spark, sf_dir, "conversations")
    raw = _case(F.col("turn"), F.concat(F.lit("<think>"), "role", F.lit("\n?</think>\n"), "text"), F.concat("role", F.lit("</think> "), "text", F.lit("\n")), F.concat(F.lit("<think>a</think>"), "text", F.lit("<think>b\nc</think>")), F.col("text"))
    return c.select("conv_id", "turn", tx.strip_think(raw).alias("answer"))


def read_analysis(spark, sf_dir):
    """Analyses as a model may give them (plain, fenced, with keys missing or null, no JSON), each field with its default."""
    head = F.concat(F.lit('{"expanded_query": "q'), _id(), F.lit('"'))
    raw = _case(
        F.col("doc_id"), F.concat(head, F.lit(', "medical_concepts": ["a", "'), "lang", F.lit('"], "relevant_traditions": ["'), "lang", F.lit('"], "date_from": -'), _id(), F.lit(', "date_to": null}')),
        F.concat(F.lit("```json\n"), head, F.lit(', "relevant_languages": ["'), "lang", F.lit('"], "date_to": '), F.col("n_chars").cast("string"), F.lit("}\n```")), F.concat(F.lit("  "), head, F.lit("}")), F.lit('{"expanded_query": null}'), F.lit("no JSON at all"),
    )
    from hexapla.plans.answer import analyse

    questions = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("question "), _id()).alias("text"), raw.alias("raw"))

    class Given(Providers):
        def chat(self, f, prompt):
            return F.col("raw")

    out = analyse(questions, Given(), ["en", "de"], ["zh"])
    join = lambda c: F.array_join(c, ",").alias(c)
    return out.select("query_id", "expanded_query", join("medical_concepts"), join("traditions"), join("relevant_languages"), "date_from", "date_to")


_READ_ANALYSIS = """SELECT doc_id AS query_id, CASE WHEN doc_id % 5 < 3 THEN 'q' || doc_id ELSE 'question ' || doc_id END AS expanded_query, CASE WHEN doc_id % 5 = 0 THEN 'a,' || lang ELSE '' END AS medical_concepts,
  CASE WHEN doc_id % 5 = 0 THEN lang ELSE 'en,de' END AS traditions, CASE WHEN doc_id % 5 = 1 THEN lang ELSE 'zh' END AS relevant_languages, CASE WHEN doc_id % 5 = 0 THEN -doc_id::INT END AS date_from, CASE WHEN doc_id % 5 = 1 THEN n_chars::INT END AS date_to FROM documents"""


def analyse_questions(spark, sf_dir):
    """The benchmark through the stand-in for a model, prompt and answer included."""
    from hexapla.plans.answer import analyse

    out = analyse(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), Providers(), ["en", "de"])
    return out.select("query_id", "expanded_query", F.array_join("traditions", ",").alias("traditions"))


def translation_prompts(spark, sf_dir):
    language = _case(F.col("doc_id"), F.lit("zh-classical"), F.lit("grc"), F.lit("la-medieval"), F.col("lang"))
    return _t(spark, sf_dir, "documents").select("doc_id", prompts.translation(F.col("text"), language).alias("prompt"))


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _translation_sql() -> str:
    before, _, rest = prompts.TRANSLATION.partition("{guidance}")
    middle, _, after = rest.partition("{text}")
    g = list(prompts.GUIDANCE.values())
    return f"SELECT doc_id, {_quote(before)} || CASE doc_id % 4 WHEN 0 THEN {_quote(g[0])} WHEN 1 THEN {_quote(g[1])} WHEN 2 THEN {_quote(g[2])} ELSE '' END || {_quote(middle)} || text || {_quote(after)} AS prompt FROM documents"


def rerank_overlap(spark, sf_dir):
    """Each benchmark item and the document of its number, through the stand-in for a cross-encoder."""
    b, d = _t(spark, sf_dir, "benchmark").withColumnRenamed("text", "question"), _t(spark, sf_dir, "documents")
    pairs = b.join(d, F.col("item_id") == F.col("doc_id"))
    return pairs.select("item_id", F.round(Providers(rerank=overlap).reranked(F.col("question"), tx.rerank_text(F.lit(""), F.col("text"))), 6).alias("score"))


def enrich_translations(spark, sf_dir):
    """Documents whose labels miss, through a translator that fails on some; the failures stay null."""
    d, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    rows = d.join(labels, "doc_id", "left").select("doc_id", F.concat("doc_id", F.lit(":"), "text").alias("text"), F.col("quality").cast("string").alias("text_translation"))

    def translate(x: str) -> str:
        number, _, text = x.partition(":")
        if int(number) % 7 == 3:
            raise ValueError(number)
        return f"<think>hm</think> {len(text)} characters "

    return enrich_missing(rows, translate, wait=0.0).select("doc_id", "text_translation")


# --- readers ------------------------------------------------------------------------------------------------------
def _chunk_lines(spark, sf_dir) -> DataFrame:
    """Documents as JSON lines, some of them blank, malformed, or without id or text."""
    d = _t(spark, sf_dir, "documents")
    good = F.to_json(F.struct(F.concat(F.lit("doc"), "doc_id").alias("chunk_id"), "text", F.col("lang").alias("language"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("int")).alias("chapter_num"), F.when(F.col("doc_id") % 4 == 0, F.lit("Book")).alias("chapter_ref")))
    no_id, no_text = F.to_json(F.struct("text")), F.to_json(F.struct(F.concat(F.lit("doc"), "doc_id").alias("chunk_id"), F.lit("  ").alias("text")))
    return d.select(F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("{bad "), "doc_id")).when(F.col("doc_id") % 11 == 1, no_id).when(F.col("doc_id") % 11 == 2, no_text).when(F.col("doc_id") % 11 == 3, F.lit("  ")).otherwise(good).alias("value"))


def jsonl_chunks(spark, sf_dir):
    return readers.parse_chunks(_chunk_lines(spark, sf_dir))[0].select("chunk_id", "text", "language", "chapter_num", "chapter_ref")


def jsonl_rejects(spark, sf_dir):
    return readers.parse_chunks(_chunk_lines(spark, sf_dir))[1].groupBy("reason").agg(F.count("*").alias("n"))


def slug_lists(spark, sf_dir):
    """Whole texts as headerless CSV files."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.inline(readers.slugs(F.col("text"))))


def chapter_numbers(spark, sf_dir):
    path = F.concat(F.lit("file:/x/ch9/work_ch"), F.format_string("%03d", "doc_id"), F.lit("_a.txt"))
    return _t(spark, sf_dir, "documents").select("doc_id", readers.chapter_number(path).alias("chapter_num"))


def marker_slice(spark, sf_dir):
    page = F.concat("source", F.lit("<BEGIN>"), "text", F.lit("<END>"), "lang", F.lit("<END>"))
    return _t(spark, sf_dir, "documents").select("doc_id", readers.between(page, "<BEGIN>", "<END>").alias("text"))


def newest_file(spark, sf_dir):
    """Pages as files: those of odd number came later, by the length of their address."""
    p = _t(spark, sf_dir, "pages").select(F.format_string("p%06d", "page_id").alias("path"), F.timestamp_seconds(F.char_length("url")).alias("modificationTime"), "page_id")
    return readers.newest_new(p.where("page_id % 2 = 0"), p).select("path", F.unix_seconds("modificationTime").alias("at"))


def numbered_questions(spark, sf_dir):
    """Users' turns as a suite's questions, and of these some by number."""
    c = _t(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("at"), "text")
    return readers.numbered_questions(c, "at", [1, 2, 7, 40]).select("n", "at.conv_id", "at.turn", "text")


def _tei(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as TEI pairs: sections with notes inside, repeated numbers, blank ones; every third has no translation of section 1."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    open_ = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><p>head</p></teiHeader><text><body>'
    grc = F.concat(
        F.lit(open_ + '<div type="textpart" n="1"><head>no</head>'), plain("text"), F.lit("<note>not <p>this</p></note> tail</div>"), F.lit('<div type="textpart" n=" 2 "><p>'), plain("source"), F.lit("</p><p>"), F.col("lang"),
        F.lit('</p></div><div type="textpart" n="1">again</div><div type="textpart" n="3"> <note>x</note></div><div type="textpart">none</div></body></text></TEI>'),
    )
    eng = F.concat(F.lit("<TEI><text><body>"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit('<div1 type="section" n="1">English '), _id(), F.lit("</div1>"))).otherwise(""), F.lit('<div1 type="section" n="2">second</div1></body></text></TEI>'))
    d = _t(spark, sf_dir, "documents")
    files = d.select(_id().alias("work"), F.explode(F.array(F.struct(F.lit("grc").alias("side"), grc.alias("xml")), F.struct(F.lit("eng").alias("side"), eng.alias("xml")))).alias("f")).select("work", "f.side", "f.xml")
    read = readers.read_tei(files)
    return read.where("side = 'grc'"), read.where("side = 'eng'")


def tei_sections(spark, sf_dir):
    grc, eng = _tei(spark, sf_dir)
    return readers.align(grc, eng, ["work", "section_ref"]).select("work", "section_ref", "text", "text_translation", "aligned")


def tei_alignment(spark, sf_dir):
    grc, eng = _tei(spark, sf_dir)
    return readers.alignment_rate(readers.align(grc, eng, ["work", "section_ref"]), "work")


# --- cleaning and chunking ----------------------------------------------------------------------------------------
def ocr_clean(spark, sf_dir):
    """Documents with the furniture of a scanned page put around and into them."""
    page = F.concat(F.lit("CAUSAE ET CURAE LIB. II. 45 "), F.regexp_replace("text", " the ", " th-\n e "), F.lit(" [sic] abs5 que 10 20 30 terra nam^) et 1) HILDEGABDIS <b>* fin† Hildegardis causae et curae ed. Eaiser. 12 "), "source")
    return _t(spark, sf_dir, "documents").select("doc_id", tx.ocr_clean(page).alias("clean"))


_W, _SP = "\\p{L}\\p{N}_\\p{M}", "[\\s\\p{Z}]"
_NUMBER = f"regexp_replace(%s, '({_SP})\\d{{1,3}}({_SP})', '\\1 \\2', 'g')"
_CAPITALS = f"regexp_replace(%s, '(^|[^{_W}])[A-Z]{{4,}}([^{_W}]|$)', '\\1 \\2', 'g')"


def _ocr_sql() -> str:
    x = f"regexp_replace(page, '([{_W}])-{_SP}*\\n{_SP}*([{_W}])', '\\1\\2', 'g')"
    x = f"regexp_replace({x}, '(^|[^{_W}])[A-Z]{{4,}}{_SP}+ET{_SP}+[A-Z]{{4,}}{_SP}+[^\\s\\p{{Z}}]{{1,4}}\\.?{_SP}+[^\\s\\p{{Z}}]{{1,4}}\\.?', '\\1 ', 'g')"
    x = _CAPITALS % (_CAPITALS % x)
    x = f"regexp_replace({x}, 'Hildegardis causae et curae ed\\.{_SP}*(Kaiser|Eaiser)\\.{_SP}*\\d+', ' ', 'g')"
    x = _NUMBER % (_NUMBER % x)
    x = f"regexp_replace({x}, '([a-zA-Z])\\d{{1,3}}({_SP})', '\\1\\2', 'g')"
    x = f"regexp_replace({x}, '\\^?\\){_SP}*', ' ', 'g')"
    x = f"regexp_replace({x}, '[\\[\\]<>*†]', '', 'g')"
    return f"""SELECT doc_id, trim(regexp_replace(nfc_normalize({x}), '{_SP}+', ' ', 'g')) AS clean FROM (SELECT doc_id, 'CAUSAE ET CURAE LIB. II. 45 ' || replace(text, ' the ', ' th-' || chr(10) || ' e ')
  || ' [sic] abs5 que 10 20 30 terra nam^) et 1) HILDEGABDIS <b>* fin† Hildegardis causae et curae ed. Eaiser. 12 ' || source AS page FROM documents)"""


def han_chunks(spark, sf_dir):
    """Documents with Han punctuation in place of Latin."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.han_chunks(F.translate("text", ".;?!", "。；？！"))).alias("ord", "chunk"))
    return rows.select("doc_id", "ord", "chunk")


def greek_chunks(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.greek_chunks(F.regexp_replace("text", ",", "·"))).alias("ord", "chunk"))
    return rows.select("doc_id", "ord", "chunk")


_GREEK = f"""WITH RECURSIVE d AS (SELECT doc_id, replace(text, ',', '·') AS t FROM documents),
pieces AS (SELECT doc_id, list_transform(regexp_extract_all(t, '[^.;·]*[.;·]|[^.;·]+$'), lambda x, i: CASE WHEN i = 1 THEN x ELSE ltrim(x, ' ' || chr(9) || chr(10) || chr(13)) END) AS p FROM d WHERE length(t) > {S.greek_chunk}),
fold AS (SELECT doc_id, p, 0 AS i, '' AS now, NULL::VARCHAR AS done, 0 AS ord FROM pieces
  UNION ALL SELECT doc_id, p, i + 1, CASE WHEN length(now || p[i + 1]) + 1 >= {S.greek_chunk} THEN '' ELSE now || p[i + 1] || ' ' END, CASE WHEN length(now || p[i + 1]) + 1 >= {S.greek_chunk} THEN now || p[i + 1] || ' ' END, ord + (length(now || p[i + 1]) + 1 >= {S.greek_chunk})::INT FROM fold WHERE i < len(p)),
parts AS (SELECT doc_id, ord, trim(done, ' ') AS chunk FROM fold WHERE done IS NOT NULL UNION ALL SELECT doc_id, ord + 1, trim(now, ' ') FROM fold WHERE i = len(p) AND trim(now, ' ') <> '' UNION ALL SELECT doc_id, 1, t FROM d WHERE length(t) <= {S.greek_chunk})
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INT AS ord, chunk FROM parts WHERE chunk <> '' OR ord = 1"""


def union_of_works(spark, sf_dir):
    """Two kinds of works with different columns as one table of chunks."""
    d = _t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text", F.col("lang").alias("language"))
    c = _t(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("chunk_id"), "text", F.col("role").alias("section"))
    return readers.union_chunks(d, c).select("chunk_id", "language", "section", F.char_length("text").alias("char_count"))


def date_fields(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", _case(F.col("doc_id"), F.concat(F.lit("c. "), _id(), F.lit(" BCE")), F.concat(F.lit("-"), _id()), F.lit(None).cast("string")).alias("raw"))
    return readers.with_dates(d, "raw").select("doc_id", "date_approx", "date_ref")


# --- indexes ------------------------------------------------------------------------------------------------------
def vector_points(spark, sf_dir):
    from hexapla.plans.queries import corpus

    return sinks.points(corpus(spark, sf_dir)).select("point_id", "chunk_id", "tradition", F.size("vector").alias("dim"))


def keyword_load(spark, sf_dir):
    """What a keyword index takes of documents of which some have no id or text, and what it rejects."""
    d = _t(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 > 0, _id()).alias("chunk_id"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).otherwise("  ").alias("text"))
    good, bad = sinks.loadable(d)
    return good.select(F.lit("indexed").alias("part")).unionByName(bad.select(F.col("reason").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


def field_statistics(spark, sf_dir):
    """Texts and mean length of two searchable fields."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("section"))
    fields = [f for f in index.FIELDS if f.name != "translation"]
    return index.fields_statistics(d, fields).select("field", "n", F.round("avgdl", 6).alias("avgdl"))


_WORDS = "regexp_extract_all(lower(%s), '\\p{Han}|[\\p{L}\\p{N}]+')"
_FLAT = "trim(regexp_replace(%s, '\\s+', ' ', 'g'))"
_TEI_SQL = f"""s AS (SELECT doc_id::VARCHAR AS work, '1' AS section_ref, {_FLAT % "nfc_normalize(text || ' tail')"} AS text, CASE WHEN doc_id % 3 > 0 THEN 'English ' || doc_id ELSE '' END AS text_translation, doc_id % 3 > 0 AS aligned FROM documents
  UNION ALL SELECT doc_id::VARCHAR, '2', source || ' ' || lang, 'second', true FROM documents)"""
_NAMES = """embed_documents embed_questions jsonl_strict strip_think read_analysis analyse_questions translation_prompts rerank_overlap enrich_translations jsonl_chunks jsonl_rejects slug_lists chapter_numbers marker_slice newest_file
numbered_questions tei_sections tei_alignment ocr_clean han_chunks greek_chunks union_of_works date_fields vector_points keyword_load field_statistics"""


def jsonl_strict(spark, sf_dir):
    """Documents written as JSON lines, with blank lines among them, and read back strictly."""
    d = _t(spark, sf_dir, "documents")
    line = F.to_json(F.struct(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.col("lang").alias("language"), F.col("n_chars").cast("int").alias("char_count"), "text"))
    path = sinks.shared_folder(spark, "jsonl")
    d.select(F.explode(F.array(line, F.lit(" "))).alias("value")).write.text(path)
    rows, _ = readers.read_chunks(spark, path, strict=True)
    return rows.select("chunk_id", "language", "char_count", F.char_length("text").alias("n"))


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    from hexapla.plans.queries import _UUID

    uuid = _UUID.replace("'doc' || doc_id", "vec_id::VARCHAR")
    han = f"list_filter(list_transform(regexp_extract_all(translate(text, '.;?!', '。；？！'), '(?s)(.{{{S.han_chunk - 1},}}?[。；？！]|.+$)', 1), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10) || chr(12288))), lambda x: x <> '')"
    return {
        "embed_documents": "SELECT doc_id, array_to_string(list_transform(range(97, 123), lambda c: length(t) - length(replace(t, chr(c::INT), ''))), ' ') AS vector FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        "embed_questions": "SELECT item_id, array_to_string(list_transform(range(97, 123), lambda c: length(text) - length(replace(text, chr(c::INT), ''))), ' ') AS vector FROM benchmark",
        "jsonl_strict": "SELECT 'd' || doc_id AS chunk_id, lang AS language, n_chars::INT AS char_count, length(text)::INT AS n FROM documents WHERE trim(text) <> ''",
        "strip_think": "SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS answer FROM conversations",
        "read_analysis": _READ_ANALYSIS,
        "analyse_questions": "SELECT item_id AS query_id, coalesce(nullif(trim(text), ''), text) AS expanded_query, 'en,de' AS traditions FROM benchmark",
        "translation_prompts": _translation_sql(),
        "rerank_overlap": f"SELECT item_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS score FROM (SELECT item_id, list_distinct({_WORDS % 'q.text'}) AS a, list_distinct({_WORDS % 'd.text'}) AS b FROM benchmark q JOIN documents d ON item_id = doc_id)",
        "enrich_translations": "SELECT d.doc_id, coalesce(quality::VARCHAR, CASE WHEN d.doc_id % 7 <> 3 THEN length(text) || ' characters' END) AS text_translation FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "jsonl_chunks": "SELECT 'doc' || doc_id AS chunk_id, text, lang AS language, CASE WHEN doc_id % 2 = 0 THEN doc_id::INT END AS chapter_num, CASE WHEN doc_id % 4 = 0 THEN 'Book' WHEN doc_id % 2 = 0 THEN 'Chapter ' || doc_id END AS chapter_ref FROM documents WHERE doc_id % 11 > 3 AND trim(text) <> ''",
        "jsonl_rejects": "SELECT CASE WHEN doc_id % 11 = 0 THEN 'malformed' ELSE 'no chunk_id' END AS reason, count(*) AS n FROM documents WHERE doc_id % 11 < 2 GROUP BY 1",
        "slug_lists": """SELECT doc_id, i::INT AS n, trim(trim(string_split(line, ',')[1]), '"') AS slug FROM (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents))) WHERE trim(line) <> ''""",
        "chapter_numbers": "SELECT doc_id, doc_id::INT AS chapter_num FROM documents",
        "marker_slice": "SELECT doc_id, text || '<END>' AS text FROM documents",
        "newest_file": "SELECT 'p' || lpad(page_id::VARCHAR, 6, '0') AS path, length(url)::BIGINT AS at FROM pages WHERE page_id % 2 = 1 ORDER BY length(url) DESC, path DESC LIMIT 1",
        "numbered_questions": "SELECT n, conv_id, turn, text FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) AS n, conv_id, turn, trim(text) AS text FROM conversations WHERE role = 'user' AND trim(text) <> '') WHERE n IN (1, 2, 7, 40)",
        "tei_sections": f"WITH {_TEI_SQL} SELECT * FROM s WHERE text <> ''",
        "tei_alignment": f"WITH {_TEI_SQL} SELECT work, count(*) AS n, round(avg(aligned::DOUBLE), 6) AS rate, avg(aligned::DOUBLE) < {S.alignment_floor} AS warn FROM s WHERE text <> '' GROUP BY work",
        "ocr_clean": _ocr_sql(),
        "han_chunks": f"SELECT doc_id, (i - 1)::INT AS ord, p[i] AS chunk FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {han} AS p FROM documents))",
        "greek_chunks": _GREEK,
        "union_of_works": "SELECT 'd' || doc_id AS chunk_id, lang AS language, NULL AS section, length(text)::INT AS char_count FROM documents UNION ALL SELECT 'c' || conv_id || '_' || turn, NULL, role, length(text)::INT FROM conversations",
        "date_fields": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id::INT WHEN 1 THEN -doc_id::INT END AS date_approx, CASE doc_id % 3 WHEN 0 THEN 'c. ' || doc_id || ' BCE' WHEN 1 THEN '-' || doc_id END AS date_ref FROM documents",
        "vector_points": f"SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(position(h[17] IN '0123456789abcdef') - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id, vec_id AS chunk_id, lang AS tradition, len(embedding)::INT AS dim FROM (SELECT *, {uuid} AS h FROM embeddings) JOIN documents ON vec_id = doc_id",
        "keyword_load": "SELECT CASE WHEN doc_id % 9 = 0 THEN 'no chunk_id' WHEN doc_id % 5 = 0 OR trim(text) = '' THEN 'no text' ELSE 'indexed' END AS part, count(*) AS n FROM documents GROUP BY 1",
        "field_statistics": f"SELECT f AS field, count(*) AS n, round(avg(n), 6) AS avgdl FROM (SELECT 'text' AS f, len({_WORDS % 'text'}) AS n FROM documents UNION ALL SELECT 'section', len({_WORDS % 'source'}) FROM documents) WHERE n > 0 GROUP BY f",
    }
