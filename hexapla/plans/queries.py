"""One query for each operator over the driver's tables, with the same in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexapla.config import DEFAULTS as S
from hexapla.functions import text as tx
from hexapla.functions.ids import NAMESPACE, uuid5
from hexapla.functions.lineage import cut
from hexapla.operators import blocks, cells, chunk, cite, index, keyword, retrieve, select
from hexapla.operators.providers import Providers
from hexapla.plans import answer, answer_queries, ingest_queries
from hexapla.sources import readers, sinks

def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Documents as chunks: language as tradition, lang/source as source, vectors where there are any; without `vectors` texts needn't meet them."""
    rows, e = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings")
    if vectors:
        rows = rows.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("doc_id").alias("chunk_id"), F.col("lang").alias("tradition"), F.col("lang").alias("language"), F.concat_ws("/", "lang", "source").alias("source_text"), F.col("n_chars").cast("int").alias("date_approx"),
        F.col("source").alias("section"), none.alias("section_ref"), none.alias("chapter_ref"), none.alias("source_urn"), none.alias("date_label"), "text", none.alias("text_translation"), *(["vector"] if vectors else []),
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question, with the vector of the same number."""
    b, e = _t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "embeddings")
    return b.join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id").select(F.col("item_id").alias("query_id"), "text", "vector")


# --- text -------------------------------------------------------------------------------------------------------
def normalize_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.normalize(F.col("text")).alias("clean"))


def chunk_sentences(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.latin_chunks(F.col("text"))).alias("ord", "chunk"))
    return rows.select("doc_id", "ord", "chunk", F.char_length("chunk").alias("char_count"))


def chunk_with_ids(spark, sf_dir):
    rows = chunk.numbered(_t(spark, sf_dir, "documents"), chunk.latin_chunks(F.col("text")), F.concat(F.lit("doc"), F.col("doc_id")), 4, S.least_chunk)
    return rows.select("chunk_id", "label", F.char_length("chunk").alias("char_count"))


def slugify(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", tx.slug(F.col("text")).alias("slug"), tx.slug(F.col("text"), 40).alias("short_slug"))


def clip_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.clip(F.col("text"), S.clip).alias("clipped"))


def point_id_uuid5(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", uuid5(F.concat(F.lit("doc"), F.col("doc_id"))).alias("point_id"))


#: Free-form dates and chapters, as formats of a document's number.
_REFS = ["", "%d", "-%d", "-%d BCE", "urn:cts:greekLit:tlg0627.tlg002:%d.3", "urn:cts:x%d", "Chapter %d", "none", "ca. %d CE", " %d "]


def parse_int_ref(spark, sf_dir):
    form = F.element_at(F.array(*map(F.lit, _REFS)), (F.col("doc_id") % len(_REFS) + 1).cast("int"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.replace(form, F.lit("%d"), F.col("doc_id").cast("string")).alias("raw"))
    return rows.select("doc_id", tx.parse_int_ref(F.col("raw")).alias("p")).select("doc_id", "p.number", "p.ref")


def embedding_text(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.embedding_text(F.when(F.col("role") == "user", F.col("role")), F.col("text")).alias("whole"), tx.rerank_text(F.when(F.col("role") == "user", F.col("role")), F.col("text")).alias("short"))


# --- joins and enrichment -----------------------------------------------------------------------------------------
def _aligned(spark, sf_dir):
    left = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    right = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("text"))
    return readers.align(left, right, ["doc_id"])


def align_left_join(spark, sf_dir):
    return _aligned(spark, sf_dir).select("doc_id", "lang", "text_translation", "aligned")


def alignment_rate(spark, sf_dir):
    return readers.alignment_rate(_aligned(spark, sf_dir), "lang")


def missing_enrichment(spark, sf_dir):
    d, e = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings")
    return d.join(e, d["doc_id"] == e["vec_id"], "left_anti").groupBy("lang").agg(F.count("*").alias("todo"))


def reconcile_counts(spark, sf_dir):
    d, e = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings")
    return sinks.reconcile(chunks=d, vectors=e, keyword=d.where(F.btrim("text") != ""))


def question_source(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return c.where((F.col("role") == "user") & (F.btrim("text") != "")).select("conv_id", "turn", F.char_length("text").alias("n"))


# --- keyword ------------------------------------------------------------------------------------------------------
def postings_stats(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return index.postings(d, "text", index.standard(F.col("text"))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _sparse(spark, sf_dir, columns=(("text", "text", 1.0),)):
    fields = [index.Field(name, column, index.standard, boost) for name, column, boost in columns]
    return keyword.search(keyword.texts(corpus(spark, sf_dir, vectors=False).select("chunk_id", "text", "source_text"), fields), _terms(spark, sf_dir, fields), S.sparse_k, fields)


def _terms(spark, sf_dir, fields) -> DataFrame:
    names = F.explode(F.array(*[F.lit(f.name) for f in fields])).alias("field")
    terms = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(index.standard(F.col("text")))).alias("term"))
    return terms.select("query_id", "term", names)


def bm25_topk(spark, sf_dir):
    return _sparse(spark, sf_dir)


def bm25_best_fields(spark, sf_dir):
    """Two whole columns, the second one boosted as a translation is."""
    return _sparse(spark, sf_dir, (("text", "text", 1.0), ("translation", "source_text", 2.0)))


def bm25_blocks_topk(spark, sf_dir):
    """The rows of bm25_topk, from a stored index in blocks of documents of like language and source."""
    path = sinks.shared_folder(spark, "blocks")
    blocks.write(corpus(spark, sf_dir, vectors=False).select("chunk_id", "text", "tradition", "section"), path, (index.Field("text", "text", index.standard),), ("tradition", "section"))
    terms = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(index.standard(F.col("text")))).alias("term"))
    return blocks.search(spark, path, terms)[0]


def bm25_filtered_topk(spark, sf_dir):
    """Keyword search under each question's own filters: one language for every other question, and a least length for all."""
    fields = (index.Field("text", "text", index.standard),)
    built = answer.build(corpus(spark, sf_dir, vectors=False).select("chunk_id", "text", "tradition", "date_approx"), fields)
    only = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("en"))).otherwise(F.array(F.lit("de"), F.lit("fr")))
    asked_for = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("expanded_query"), only.alias("traditions"), F.lit(500).alias("date_from"), F.lit(None).cast("int").alias("date_to"))
    return answer.keyword_top(built, asked_for, replace(S, filter_sparse=True))


# --- dense --------------------------------------------------------------------------------------------------------
def dense_topk(spark, sf_dir):
    return retrieve.dense_topk(corpus(spark, sf_dir), asked(spark, sf_dir))


def dense_topk_filtered(spark, sf_dir):
    rows = corpus(spark, sf_dir).where(retrieve.facets(languages=["en", "de"], traditions=["en"], date_from=500, date_to=5000))
    return retrieve.dense_topk(rows, asked(spark, sf_dir))


def dense_topk_per_lang(spark, sf_dir):
    return retrieve.dense_topk(corpus(spark, sf_dir), asked(spark, sf_dir), S.floor_pool, per="tradition")


def vector_cells_topk(spark, sf_dir):
    """Vectors whose number 100 divides, against all: an index of cells is written and searched exactly."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    path = sinks.shared_folder(spark, "cells")
    cells.write(e, path, n_cells=32, k=S.top_k)
    return cells.search(spark, path, e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), S.top_k)[0]


# --- fusion, rerank, selection ------------------------------------------------------------------------------------
LANGS = ["en", "de", "fr", "es"]


def _floor_no() -> Column:
    place = F.array_position(F.array(*map(F.lit, LANGS)), F.col("tradition")) - 1
    return F.when(place >= 0, place.cast("int"))


def rrf_fusion(spark, sf_dir):
    return retrieve.fuse(dense_topk(spark, sf_dir), bm25_topk(spark, sf_dir))


def rerank_pool(spark, sf_dir):
    found, per = retrieve.dense_and_floors(corpus(spark, sf_dir), asked(spark, sf_dir), "tradition")
    floors = per.select("query_id", "chunk_id", _floor_no().alias("floor_no"), "rank").where("floor_no IS NOT NULL")
    pooled = retrieve.pool(cut(retrieve.fuse(found, bm25_topk(spark, sf_dir))), floors)
    known = per.select("query_id", "chunk_id", "score").unionByName(found.select("query_id", "chunk_id", "score")).distinct().withColumnRenamed("score", "cosine")
    return retrieve.rerank(pooled.join(known, ["query_id", "chunk_id"], "left"), F.coalesce("cosine", F.lit(0.0))).select("query_id", "chunk_id", "pool_pos", "score", "rank")


def _scored(spark, sf_dir):
    return retrieve.with_chunks(rerank_pool(spark, sf_dir), corpus(spark, sf_dir, vectors=False))


def dedup_collapse(spark, sf_dir):
    return select.collapse_duplicates(_scored(spark, sf_dir), select.duplicate_key()).select("query_id", "chunk_id", "rank")


def diversified_select(spark, sf_dir):
    rows = select.collapse_duplicates(_scored(spark, sf_dir), select.duplicate_key())
    rows = rows.select("query_id", "chunk_id", F.col("source_text").alias("source"), "tradition", _floor_no().alias("floor_no"), "rank", "score")
    return select.select_windows(rows).select("query_id", "chunk_id", "source", "tradition", "sel_pos", "source_n", "score")


# --- citations ----------------------------------------------------------------------------------------------------
#: Ends of drafts in the forms that markers take, as formats of a document's number.
_MARKERS = ["[SOURCE %d].", "[SOURCE 7, %d, 9] and [SOURCES 1, 2]", "[SOURCE 4, SOURCE %d]", "[SOURCE 6–%d]", "Source %d says", "[SOURCE%d]", "[ source 99 ] and [SOURCE %d]", ""]
_N_CHUNKS = 12


def resolve_markers(spark, sf_dir):
    form = F.element_at(F.array(*map(F.lit, _MARKERS)), (F.col("doc_id") % len(_MARKERS) + 1).cast("int"))
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.concat("text", F.lit(" "), F.replace(form, F.lit("%d"), (F.col("doc_id") % 17).cast("string"))).alias("draft"), F.when(F.col("doc_id") % 10 < 9, _N_CHUNKS).otherwise(0).alias("n_chunks"))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return cite.resolve(d).select("query_id", *[join(c) for c in ("cited", "in_range", "dangling", "uncited")])


def citation_status(spark, sf_dir):
    """Twelve labelled documents are a draft's claims, each on one source; its quality says whether it holds."""
    v = _t(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 12).alias("query_id"), F.array((F.col("doc_id") % 5 + 1).cast("int")).alias("cited_sources"), (F.col("quality") == 1).alias("supported"))
    v = v.groupBy("query_id").agg(F.collect_list(F.struct("cited_sources", "supported")).alias("claims"))
    c = _t(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 12).alias("query_id"), (F.col("doc_id") % 12 + 1).cast("int").alias("source_n"))
    return cite.citation_status(c, v)


def format_citation(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.element_at(F.array(*map(F.lit, ["chinese-medicine", "greek-medicine", "medieval-european"])), (F.col("doc_id") % 3 + 1).cast("int")).alias("tradition"), F.col("source").alias("source_text"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Chapter "), F.col("doc_id"))).alias("chapter_ref"), F.col("lang").alias("section"), F.lit(None).cast("string").alias("section_ref"), F.when(F.col("doc_id") % 5 == 0, F.lit("c. 400 BCE")).alias("date_label"), F.when(F.col("doc_id") % 7 == 0, F.lit("urn:x. ")).alias("source_urn"),
        F.lit(None).cast("string").alias("language"))
    return rows.select("doc_id", cite.reference().alias("reference"))


def suite_summary(spark, sf_dir):
    rows = diversified_select(spark, sf_dir)
    return rows.groupBy("query_id").agg(F.count("*").alias("n_retrieved"), F.array_join(F.array_sort(F.collect_set("tradition")), ",").alias("traditions"), F.count_if(F.col("score") > 0).alias("n_scored"))


def html_pre_extract(spark, sf_dir):
    wrapped = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<html><pre>"), F.regexp_replace("html", "(?i)</?pre>", " "), F.lit("</pre></html>")).alias("page"))
    return wrapped.select("page_id", readers.pre_text(F.col("page")).alias("text"))


def hybrid_answer(spark, sf_dir):
    """The whole way from questions to cited answers."""
    built = answer.build(corpus(spark, sf_dir, vectors=False), vectors=corpus(spark, sf_dir))
    out = answer.answer(built, asked(spark, sf_dir), Providers(), LANGS)
    return out.select("query_id", "n_chunks", F.size("in_range").alias("n_cited"), "passed", "status", "iteration", "answer")


def flagship(spark, sf_dir):
    """Selected sources of each question: vector and keyword search, fusion, pool, rerank, collapse, selection."""
    return diversified_select(spark, sf_dir)


_NAMES = """normalize_text chunk_sentences chunk_with_ids slugify clip_text point_id_uuid5 parse_int_ref embedding_text align_left_join alignment_rate
missing_enrichment reconcile_counts question_source postings_stats bm25_topk bm25_best_fields bm25_blocks_topk bm25_filtered_topk dense_topk dense_topk_filtered dense_topk_per_lang vector_cells_topk
rrf_fusion rerank_pool dedup_collapse diversified_select resolve_markers citation_status format_citation suite_summary html_pre_extract hybrid_answer"""


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()} | ingest_queries.queries() | answer_queries.queries()


# --- the same in SQL ----------------------------------------------------------------------------------------------
_C = "corpus AS (SELECT d.doc_id AS chunk_id, lang AS tradition, lang || '/' || source AS source_text, n_chars AS date_approx, source AS section, text, e.embedding AS vector FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"
_Q = "asked AS (SELECT item_id AS query_id, text, embedding AS vector FROM benchmark JOIN embeddings ON item_id = vec_id)"


def _dense_sql(where: str = "true", per: str = "", k: int = S.dense_k) -> str:
    return f"""SELECT query_id, chunk_id, {per} score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id{', tradition' if per else ''} ORDER BY score DESC, chunk_id)::INT AS rank FROM (
  SELECT q.query_id, c.chunk_id, c.tradition, round(list_cosine_similarity(c.vector::DOUBLE[], q.vector::DOUBLE[]), 6) AS score FROM corpus c, asked q WHERE c.vector IS NOT NULL AND {where})) WHERE rank <= {k}"""


def _bm25_sql(fields: dict[str, tuple[str, float]]) -> str:
    """CTEs up to scores(query_id, chunk_id, score)."""
    out = ["terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\\p{Han}|[\\p{L}\\p{N}]+')) AS term FROM benchmark)"]
    for f, (expr, _) in fields.items():
        out += [
            f"{f}_tok AS (SELECT chunk_id, regexp_extract_all(lower({expr}), '\\p{{Han}}|[\\p{{L}}\\p{{N}}]+') AS w FROM corpus)",
            f"{f}_dl AS (SELECT chunk_id, len(w) AS dl FROM {f}_tok WHERE len(w) > 0)",
            f"{f}_tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM {f}_tok) WHERE term IN (SELECT term FROM terms) GROUP BY ALL)",
            f"{f}_df AS (SELECT term, count(*) AS df FROM {f}_tf GROUP BY term)",
            f"{f}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {f}_dl)",
            f"""{f}_score AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + {S.bm25_k1} * (1 - {S.bm25_b} + {S.bm25_b} * dl / avgdl)))), 6) AS score
  FROM {f}_tf JOIN {f}_df USING (term) JOIN {f}_dl USING (chunk_id) CROSS JOIN {f}_st JOIN terms USING (term) GROUP BY ALL)""",
        ]
    parts = " UNION ALL ".join(f"SELECT query_id, chunk_id, round({b} * score, 6) AS score FROM {f}_score" for f, (_, b) in fields.items())
    return ", ".join([*out, f"scores AS (SELECT query_id, chunk_id, max(score) AS score FROM ({parts}) GROUP BY ALL)"])


_TOP = f"SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scores) WHERE rank <= {S.sparse_k}"
_TEXT = {"text": ("text", 1.0)}
_FUSED = f"""dense AS ({_dense_sql()}), sparse AS ({_TOP}), fused AS (
  SELECT query_id, chunk_id, d_rank, s_rank, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, coalesce(d_rank, s_rank + 100000))::INT AS pos FROM (
    SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS d_rank, s.rank AS s_rank,
      round(coalesce(1.0::DOUBLE / ({S.rrf_k} + d.rank), 0) + coalesce(1.0::DOUBLE / ({S.rrf_k} + s.rank), 0), 9) AS rrf
    FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id))"""
_POOLED = f"""per AS ({_dense_sql(per='tradition,', k=S.floor_pool)}), head AS (SELECT query_id, chunk_id, pos AS pool_pos FROM fused WHERE pos <= {S.pool}),
more AS (SELECT p.query_id, p.chunk_id, min(list_position(['en', 'de', 'fr', 'es'], tradition) * 1000 + rank) AS seat FROM per p WHERE tradition IN ('en', 'de', 'fr', 'es')
  AND NOT EXISTS (FROM head h WHERE h.query_id = p.query_id AND h.chunk_id = p.chunk_id) GROUP BY ALL),
pooled AS (SELECT * FROM head UNION ALL SELECT m.query_id, m.chunk_id, ((SELECT count(*) FROM head h WHERE h.query_id = m.query_id) + row_number() OVER (PARTITION BY m.query_id ORDER BY seat))::INT FROM more m),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_pos)::INT AS rank FROM (SELECT p.query_id, p.chunk_id, p.pool_pos, coalesce(c.score, 0) AS score FROM pooled p
  LEFT JOIN (SELECT query_id, chunk_id, score FROM per UNION SELECT query_id, chunk_id, score FROM dense) c ON c.query_id = p.query_id AND c.chunk_id = p.chunk_id))"""
_DEDUPED = f"""once AS (SELECT query_id, chunk_id, source_text, tradition, rank, score FROM (SELECT r.*, c.source_text, c.tradition, row_number() OVER (PARTITION BY r.query_id, c.tradition, c.section, left(c.text, {S.dedup_prefix}) ORDER BY r.rank) AS n
  FROM reranked r JOIN corpus c ON c.chunk_id = r.chunk_id) WHERE n = 1)"""
_SELECTED = f"""s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_text ORDER BY rank) <= {S.per_source} AS ok, list_position(['en', 'de', 'fr', 'es'], tradition) - 1 AS floor_no FROM once),
s2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, tradition, ok ORDER BY rank) AS t FROM s1),
s3 AS (SELECT *, CASE WHEN ok AND floor_no IS NOT NULL AND t <= {S.min_per_group} THEN 0 WHEN ok THEN 1 ELSE 2 END AS phase FROM s2),
s4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase, CASE WHEN phase = 0 THEN floor_no END NULLS FIRST, rank)::INT AS sel_pos FROM s3),
chosen AS (SELECT query_id, chunk_id, source_text AS source, tradition, sel_pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sel_pos)::INT AS source_n, score FROM s4 WHERE sel_pos <= {S.top_k})"""
_ALL = f"WITH {_C}, {_Q}, {_bm25_sql(_TEXT)}, {_FUSED}, {_POOLED}, {_DEDUPED}, {_SELECTED} "
_LATIN = f"regexp_extract_all(text, '(?s)(.{{{S.latin_chunk - 1},}}?[.?!]|.+$)', 1)"
_CHUNKS = f"""pieces AS (SELECT doc_id, list_filter(list_transform({_LATIN}, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10) || chr(12288))), lambda x: x <> '') AS p FROM documents),
chunks AS (SELECT doc_id, unnest(range(len(p)))::INT AS ord, unnest(p) AS chunk FROM pieces)"""
_UUID = f"sha1(from_hex('{NAMESPACE.hex}') || encode('doc' || doc_id))"
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _pick(forms: list[str], number: str) -> str:
    """The form of a document's number, with `number` in it."""
    quoted = ", ".join("'" + f + "'" for f in forms)
    return f"replace([{quoted}][doc_id % {len(forms)} + 1], '%d', ({number})::VARCHAR)"


def _slug_sql(n: int) -> str:
    return f"coalesce(nullif(rtrim(left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), {n}), '-'), ''), 'query')"


def oracle_sql() -> dict[str, str]:
    sql = {
        "html_pre_extract": "SELECT page_id, regexp_replace(replace(replace(replace(regexp_replace(html, '(?i)</?pre>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g') AS text FROM pages",
        "normalize_text": "SELECT doc_id, trim(regexp_replace(translate(nfc_normalize(text), chr(65279) || chr(8203), ''), '\\s+', ' ', 'g')) AS clean FROM documents",
        "chunk_sentences": f"WITH {_CHUNKS} SELECT doc_id, ord, chunk, length(chunk)::INT AS char_count FROM chunks",
        "chunk_with_ids": f"WITH {_CHUNKS} SELECT 'doc' || doc_id || '_chunk_' || lpad(ord::VARCHAR, 4, '0') AS chunk_id, 'Passage ' || (ord + 1) AS label, length(chunk)::INT AS char_count FROM chunks WHERE length(chunk) >= {S.least_chunk}",
        "slugify": f"SELECT item_id, {_slug_sql(50)} AS slug, {_slug_sql(40)} AS short_slug FROM benchmark",
        "clip_text": f"SELECT doc_id, CASE WHEN length(f) > {S.clip} THEN rtrim(left(f, {S.clip})) || ' […]' ELSE f END AS clipped FROM (SELECT doc_id, {_FLAT} AS f FROM documents)",
        "point_id_uuid5": f"SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(position(h[17] IN '0123456789abcdef') - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM (SELECT doc_id, {_UUID} AS h FROM documents)",
        "parse_int_ref": f"""SELECT doc_id, CASE WHEN raw = '' THEN NULL WHEN raw LIKE 'urn:cts:%' THEN try_cast(nullif(regexp_extract(string_split(raw, ':')[5], '^(\\d+)', 1), '') AS INT)
  ELSE try_cast(nullif(coalesce(nullif(regexp_extract(raw, '^\\s*(-?\\d+)\\s*$', 1), ''), regexp_extract(raw, '\\b(\\d+)\\b', 1)), '') AS INT) END AS number,
  CASE WHEN raw <> '' THEN trim(raw) END AS ref FROM (SELECT doc_id, {_pick(_REFS, 'doc_id')} AS raw FROM documents)""",
        "embedding_text": "SELECT conv_id, turn, CASE WHEN role = 'user' THEN role || chr(10) || chr(10) || trim(text) ELSE trim(text) END AS whole, trim(CASE WHEN role = 'user' THEN role ELSE text END) AS short FROM conversations",
        "align_left_join": "SELECT d.doc_id, lang, coalesce(quality::VARCHAR, '') AS text_translation, l.doc_id IS NOT NULL AS aligned FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "alignment_rate": f"SELECT lang, count(*) AS n, round(avg((l.doc_id IS NOT NULL)::DOUBLE), 6) AS rate, avg((l.doc_id IS NOT NULL)::DOUBLE) < {S.alignment_floor} AS warn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang",
        "missing_enrichment": "SELECT lang, count(*) AS todo FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY lang",
        "reconcile_counts": "WITH c AS (SELECT 'chunks' AS part, count(*) AS n FROM documents UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'keyword', count(*) FROM documents WHERE trim(text) <> '') SELECT part, n, (SELECT min(n) = max(n) FROM c) AS agrees FROM c",
        "question_source": "SELECT conv_id, turn, length(text)::INT AS n FROM conversations WHERE role = 'user' AND trim(text) <> ''",
        "postings_stats": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{Han}|[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term",
        "bm25_topk": f"WITH {_C}, {_bm25_sql(_TEXT)} {_TOP}",
        "bm25_best_fields": f"WITH {_C}, {_bm25_sql({**_TEXT, 'translation': ('source_text', 2.0)})} {_TOP}",
        "bm25_blocks_topk": f"WITH {_C}, {_bm25_sql(_TEXT)} {_TOP}",
        "bm25_filtered_topk": f"WITH {_C}, {_bm25_sql(_TEXT)}, allowed AS (SELECT s.* FROM scores s JOIN corpus c ON s.chunk_id = c.chunk_id WHERE (query_id % 2 = 1 OR c.tradition = 'en') AND c.date_approx >= 500) {_TOP.replace('FROM scores', 'FROM allowed')}",
        "dense_topk": f"WITH {_C}, {_Q} {_dense_sql()}",
        "dense_topk_filtered": f"WITH {_C}, {_Q} {_dense_sql(where="c.tradition = 'en' AND c.date_approx BETWEEN 500 AND 5000")}",
        "dense_topk_per_lang": f"WITH {_C}, {_Q} {_dense_sql(per='tradition,', k=S.floor_pool)}",
        "vector_cells_topk": f"""SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= {S.top_k}""",
        "rrf_fusion": f"WITH {_C}, {_Q}, {_bm25_sql(_TEXT)}, {_FUSED} SELECT query_id, chunk_id, d_rank, s_rank, rrf, pos FROM fused",
        "rerank_pool": _ALL + "SELECT query_id, chunk_id, pool_pos, score, rank FROM reranked",
        "dedup_collapse": _ALL + "SELECT query_id, chunk_id, rank FROM once",
        "diversified_select": _ALL + "SELECT * FROM chosen",
        "resolve_markers": f"""WITH d AS (SELECT *, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(draft, '(?i)\\[\\s*SOURCES?\\s+([^\\]]+?)\\s*\\]', 1), lambda b: list_transform(regexp_extract_all(b, '\\d+'), lambda x: x::INT))))) AS c FROM (SELECT doc_id AS query_id, text || ' ' || {_pick(_MARKERS, 'doc_id % 17')} AS draft, CASE WHEN doc_id % 10 < 9 THEN {_N_CHUNKS} ELSE 0 END AS n_chunks FROM documents))
SELECT query_id, coalesce(array_to_string(c, ','), '') AS cited, coalesce(array_to_string(list_filter(c, lambda x: x BETWEEN 1 AND n_chunks), ','), '') AS in_range, coalesce(array_to_string(list_filter(c, lambda x: NOT x BETWEEN 1 AND n_chunks), ','), '') AS dangling,
  coalesce(array_to_string(list_filter(range(1, n_chunks + 1), lambda x: NOT list_contains(c, x::INT)), ','), '') AS uncited FROM d""",
        "citation_status": """WITH v AS (SELECT doc_id // 12 AS query_id, (doc_id % 5 + 1)::INT AS n, bool_or(quality <> 1) AS bad, bool_or(quality = 1) AS good FROM labels GROUP BY ALL), c AS (SELECT doc_id // 12 AS query_id, (doc_id % 12 + 1)::INT AS source_n FROM documents)
SELECT c.query_id, source_n, CASE WHEN bad THEN 'disputed' WHEN good THEN 'verified' ELSE 'cited' END AS status FROM c LEFT JOIN v ON v.query_id = c.query_id AND v.n = c.source_n""",
        "format_citation": """SELECT doc_id, regexp_replace(CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Hippocrates, ' ELSE 'Hildegard of Bingen, ' END || '*' || source || CASE WHEN doc_id % 3 = 0 THEN ' (黄帝内经素問)' ELSE '' END || '*, ' || loc
  || CASE WHEN doc_id % 5 = 0 THEN ' (c. 400 BCE)' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN '. urn:x.' ELSE '' END
  || CASE doc_id % 3 WHEN 0 THEN '. English translation: LLM-assisted (unreviewed).' WHEN 1 THEN '. Greek text and English translation: Perseus Digital Library.' ELSE '. Latin from OCR; English translation: LLM-assisted (unreviewed).' END, '[. ]+$', '') || '.' AS reference
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'Chapter ' || doc_id ELSE lang END AS loc FROM documents)""",
        "suite_summary": _ALL + "SELECT query_id, count(*) AS n_retrieved, string_agg(DISTINCT tradition, ',' ORDER BY tradition) AS traditions, count(*) FILTER (score > 0) AS n_scored FROM chosen GROUP BY query_id",
    }
    return sql | ingest_queries.oracle_sql() | answer_queries.oracle_sql()
