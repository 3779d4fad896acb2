"""Schemas and constants of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Settings:
    dense_k: int = 60
    sparse_k: int = 60
    rrf_k: int = 60
    pool: int = 50
    top_k: int = 12
    min_per_group: int = 2
    per_source: int = 3
    dedup_prefix: int = 120
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    han_chunk: int = 400
    latin_chunk: int = 450
    greek_chunk: int = 1000
    least_chunk: int = 60
    alignment_floor: float = 0.6
    clip: int = 600
    max_reretrievals: int = 2
    attempts: int = 3
    filter_sparse: bool = False  # the keyword path takes no filters unless asked to
    expand_ranges: bool = False  # "6-8" cites 6 and 8 unless asked for 7 too
    query_block: int = 1000  # queries compared with the corpus at a time

    @property
    def floor_pool(self) -> int:
        return max(4 * self.min_per_group, 8)


DEFAULTS = Settings()

_STRINGS = "chunk_id source_text source_urn language script date_ref date_label tradition chapter_ref section section_ref text text_translation translation_source"
_INTS = ("date_approx", "chapter_num", "char_count")
CHUNK = T.StructType([T.StructField(c, T.StringType(), c != "chunk_id") for c in _STRINGS.split()] + [T.StructField(c, T.IntegerType()) for c in _INTS])
ANALYSIS = "struct<expanded_query: string, medical_concepts: array<string>, relevant_traditions: array<string>, relevant_languages: array<string>, date_from: int, date_to: int>"
