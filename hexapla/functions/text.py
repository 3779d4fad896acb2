"""Scalar text functions as Column expressions; Arrow functions only for NFC and character references."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T


@F.arrow_udf(T.StringType())
def nfc(s: pa.Array) -> pa.Array:
    """Only texts that NFC changes are copied, one at a time."""
    there = pc.fill_null(pc.invert(pc.string_is_ascii(s)), False).to_numpy(zero_copy_only=False)
    new = {i: unicodedata.normalize("NFC", x) for i in there.nonzero()[0].tolist() if not unicodedata.is_normalized("NFC", x := s[i].as_py())}
    return pc.replace_with_mask(s, pa.array([i in new for i in range(len(s))]), pa.array(new.values(), s.type)) if new else s


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def collapse(x: Column) -> Column:
    """Each run of Unicode white space to one space, none at the ends."""
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize(x: Column) -> Column:
    """NFC, no byte order marks or zero-width spaces, collapsed."""
    return collapse(F.translate(nfc(x), "﻿​", ""))


#: Fixed values. Order matters: the header rule needs its capitals and page number, the footer rule its digits, the hyphen rule line ends.
OCR_RULES = [
    (r"(?U)(\w)-\s*\n\s*(\w)", "$1$2"),
    (r"(?U)\b[A-Z]{4,}\s+ET\s+[A-Z]{4,}\s+\S{1,4}\.?\s+\S{1,4}\.?", " "),
    (r"(?U)\b[A-Z]{4,}\b", " "),
    (r"(?U)Hildegardis causae et curae ed\.\s*(Kaiser|Eaiser)\.\s*\d+", " "),
    (r"(?U)(?<=\s)\d{1,3}(?=\s)", " "),
    (r"(?U)(?<=[a-zA-Z])\d{1,3}(?=\s)", ""),
    (r"(?U)\^?\)\s*", " "),
    (r"[\[\]<>*†]", ""),
]


def ocr_clean(x: Column) -> Column:
    for pattern, new in OCR_RULES:
        x = F.regexp_replace(x, pattern, new)
    return collapse(nfc(x))


def clip(x: Column, n: int) -> Column:
    """Collapsed, and cut with a mark beyond n characters."""
    flat = collapse(x)
    return F.when(F.char_length(flat) > n, F.concat(F.rtrim(F.left(flat, F.lit(n))), F.lit(" […]"))).otherwise(flat)


def slug(x: Column, n: int = 50) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.rtrim(F.left(s, F.lit(n)), F.lit("-")), F.lit("")), F.lit("query"))


def filled(x: Column) -> Column:
    """Null for blank."""
    return F.when(F.btrim(x) != "", x)


def embedding_text(translation: Column, text: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(F.btrim(translation), F.lit("")), F.btrim(text))


def rerank_text(translation: Column, text: Column) -> Column:
    return F.btrim(F.coalesce(F.nullif(translation, F.lit("")), text))


def parse_int_ref(x: Column) -> Column:
    """struct(number: int, ref: string): the number of a date or chapter field, and the whole field; both null for ''."""
    raw, parts = F.btrim(x), F.split(F.btrim(x), ":")
    passage = F.regexp_extract(F.try_element_at(parts, F.lit(5)), r"^(\d+)", 1)
    whole = F.regexp_extract(raw, r"^(-?\d+)$", 1)
    first = F.regexp_extract(raw, r"(?<![\p{L}\p{N}_])(\d+)(?![\p{L}\p{N}_])", 1)
    digits = F.when(raw.startswith("urn:cts:"), F.coalesce(passage, F.lit(""))).when(whole != "", whole).otherwise(first)
    value = F.nullif(digits, F.lit("")).try_cast("int")
    return F.struct(F.when(x != "", value).alias("number"), F.when(x != "", raw).alias("ref"))


def strip_think(x: Column) -> Column:
    """Without reasoning blocks; an unopened closing tag ends one too."""
    return F.btrim(F.substring_index(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""), "</think>", -1), F.lit(" \t\r\n"))


def unfence(x: Column) -> Column:
    """The inside of a fenced answer, without the language's name."""
    s = F.btrim(x, F.lit(" \t\r\n"))
    inner = F.when(s.startswith("```"), F.element_at(F.split(s, "```"), 2)).otherwise(s)
    return F.btrim(F.regexp_replace(inner, r"^\s*json", ""), F.lit(" \t\r\n"))


def parsed(x: Column, schema: str) -> Column:
    """from_json, but null for what isn't an object."""
    s = unfence(x)
    return F.when(F.try_parse_json(s).isNotNull() & s.startswith("{"), F.from_json(s, schema))
