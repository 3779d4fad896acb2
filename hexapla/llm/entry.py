"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from hexapla.llm import byte_bpe, decontaminate, html_text, licences, line_dedup, merkle, order_minhash, packing, projection_dedup, quality, token_counts, toxicity
from hexapla.llm.common import table


def op1_quality_cotraining(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op3_order_minhash(spark, sf_dir):
    return order_minhash.digest(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark, sf_dir):
    return byte_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_embedding_near_dup(spark, sf_dir):
    return projection_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark, sf_dir):
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_html_extraction(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op10_license_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.without_newlines())


def op12_bounded_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE_SQL, "op7_embedding_near_dup": projection_dedup.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL}
