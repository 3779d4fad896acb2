"""From raw documents to token ids: five of the training-data operators, one after another.

Every stage works on all rows that the one before kept, and all but the last return the columns of `documents`.

Defined results, beside those of the operators' modules: a null or empty text is a document like others (accepted without
usable labels, one empty line, a class of its own, not contaminated, no tokens); rows with a null doc_id are kept by every stage that
doesn't reject their text; repeated rows share their fate, as decisions are by text or doc_id; ties are settled by the
smallest doc_id (near copies), the largest (repeated lines) or a hash; empty tables give empty ones, and without
labels or benchmark items the stages that need them keep everything; further columns reach the last stage
unchanged, whatever their names. Lineage is cut after every stage, so a lost executor costs a reread.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hexapla.llm import byte_bpe, decontaminate, line_dedup, order_minhash, quality
from hexapla.llm.common import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers accept."""
    return quality.stage(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars is counted anew."""
    return line_dedup.stage(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every near-duplicate class."""
    return order_minhash.stage(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or paraphrased."""
    return decontaminate.stage(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of every document's token ids; one row each."""
    return byte_bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]
#: SQL has no word for trained classifiers, sketches and merges; tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:  # later stages read their input several times
            docs = cut(docs)
    return docs
