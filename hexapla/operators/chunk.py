"""Chunkers: text to ordered pieces, as expressions, and their numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hexapla.config import DEFAULTS


def _cut(text: Column, least: int, ends: str) -> Column:
    """Pieces that end with the first of `ends` once `least` characters are there; the tail stays."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(.{{{least - 1},}}?[{ends}]|.+$)"), 1)
    return F.filter(F.transform(pieces, lambda p: F.btrim(p, F.lit(" \t\r\n　"))), lambda p: p != "")


def han_chunks(text: Column, least: int = DEFAULTS.han_chunk) -> Column:
    return _cut(text, least, "。；？！")


def latin_chunks(text: Column, least: int = DEFAULTS.latin_chunk) -> Column:
    """Like the others, but an empty text is one empty chunk."""
    return F.when(F.btrim(text) == "", F.array(text)).otherwise(_cut(text, least, ".?!"))


def greek_chunks(text: Column, most: int = DEFAULTS.greek_chunk) -> Column:
    """Whole up to `most` characters; else sentences joined by a space, cut once they reach it."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        now = F.concat(acc["now"], piece, F.lit(" "))
        full = F.char_length(now) >= most
        return F.struct(F.when(full, "").otherwise(now).alias("now"), F.when(full, F.array_append(acc["done"], F.btrim(now))).otherwise(acc["done"]).alias("done"))

    folded = F.aggregate(F.split(text, r"(?<=[.;·])\s*", -1), start, step, lambda acc: F.filter(F.array_append(acc["done"], F.btrim(acc["now"])), lambda p: p != ""))
    return F.when(F.char_length(text) <= most, F.array(text)).otherwise(folded)


def numbered(df: DataFrame, chunks: Column, prefix: Column, width: int = 3, least: int = 0) -> DataFrame:
    """One row for each chunk, with chunk_id, ord (from 0) and label; short ones go after numbering, so ids have gaps."""
    out = df.select("*", F.posexplode(chunks).alias("ord", "chunk")).where(F.char_length("chunk") >= least)
    return out.withColumn("chunk_id", F.concat(prefix, F.lit("_chunk_"), F.lpad(F.col("ord").cast("string"), width, "0"))).withColumn("label", F.concat(F.lit("Passage "), F.col("ord") + 1))
