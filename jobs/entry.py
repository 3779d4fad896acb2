"""The jobs as queries over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexapla.functions.ids import NAMESPACE
from hexapla.sources.sinks import shared_folder
from jobs import corpus_chunks, keyword_stream


def job1_corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "corpus_chunks")
    for _ in range(2):
        corpus_chunks.run(spark, f"{sf_dir}/documents.parquet", out)
    return corpus_chunks.read_chunks(spark, f"{out}/chunks")


def job2_keyword_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table may be one file, which a stream takes by a pattern only."""
    out = shared_folder(spark, "keyword_stream")
    for _ in range(2):
        keyword_stream.run(spark, f"{sf_dir}/documents.parque[t]", f"{out}/index", f"{out}/checkpoint")
    return keyword_stream.read_vocabulary(spark, f"{out}/index")


def queries() -> dict:
    return {"job1_corpus_chunks": job1_corpus_chunks, "job2_keyword_stream": job2_keyword_stream}


_CLEAN = "trim(regexp_replace(translate(nfc_normalize(text), chr(65279) || chr(8203), ''), '\\s+', ' ', 'g'))"
_PIECES = "list_filter(list_transform(regexp_extract_all(t, '(?s)(.{449,}?[.?!]|.+$)', 1), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10) || chr(12288))), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    return {
        "job1_corpus_chunks": f"""WITH c AS (SELECT doc_id, lang, source, {_CLEAN} AS t FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '\\S')), p AS (SELECT *, {_PIECES} AS p FROM c),
k AS (SELECT doc_id, lang, source, unnest(range(len(p)))::INT AS ord, unnest(p) AS chunk FROM p), n AS (SELECT *, 'doc' || doc_id || '_chunk_' || lpad(ord::VARCHAR, 4, '0') AS chunk_id FROM k WHERE length(chunk) >= 60)
SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(position(h[17] IN '0123456789abcdef') - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id, doc_id::VARCHAR AS doc_id, source, 'Passage ' || (ord + 1) AS label, ord, length(chunk)::INT AS char_count, chunk AS text, chunk AS embedding_text, lang AS language
FROM (SELECT *, sha1(from_hex('{NAMESPACE.hex}') || encode(chunk_id)) AS h FROM n)""",
        "job2_keyword_stream": "SELECT 'text' AS field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{Han}|[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    }
