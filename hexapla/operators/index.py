"""Keyword index: analyzers, postings and their statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 64  # of a stored index's terms
#: Ideographs are terms of their own; other letters and digits form words.
WORD = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def standard(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def _measure(stem: str) -> int:
    forms = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return sum(a == "v" and b == "c" for a, b in zip(forms, forms[1:], strict=False))


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or w[i] == "y" and i > 0 and not _vowel(w, i - 1)


def _has_vowel(s: str) -> bool:
    return any(_vowel(s, i) for i in range(len(s)))


def _short(s: str) -> bool:
    return len(s) > 2 and not _vowel(s, len(s) - 1) and _vowel(s, len(s) - 2) and not _vowel(s, len(s) - 3) and s[-1] not in "wxy"


#: Suffix rules of the published algorithm's steps 2 to 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def stem(w: str) -> str:
    """Porter's stemmer (1980)."""
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        pairs = sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0]))
        for end, new in pairs:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short(base):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def english_words(text: Column) -> Column:
    """Standard words without possessives and stop words, not yet stemmed."""
    stops = StopWordsRemover.loadDefaultStopWords("english")
    bare = F.regexp_replace(F.lower(text), r"['’]s\b", "")
    return F.filter(F.regexp_extract_all(bare, F.lit(WORD), 0), lambda w: ~w.isin(stops))


def english(text: Column) -> Column:
    """Standard words without possessives and stop words, stemmed."""

    @F.pandas_udf("array<string>")
    def stems(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return stems(english_words(text))


def stem_dictionary(words: DataFrame) -> DataFrame:
    """(term, stem) of the distinct values of `term`: each word is stemmed once, however often it occurs."""

    @F.pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        return s.map(stem)

    return words.select("term").distinct().withColumn("stem", stems("term"))


@dataclass(frozen=True)
class Field:
    """How a field is searched: its column, its analyzer and its boost. `words`: what the analyzer stems, for analyzers that do;
    postings then take the stems from a dictionary of the distinct words."""

    name: str
    column: str
    analyzer: Callable[[Column], Column]
    boost: float = 1.0
    words: Callable[[Column], Column] | None = None


#: The searchable fields of a chunk; other columns are kept whole and filtered on.
FIELDS = (Field("translation", "text_translation", english, 2.0, english_words), Field("text", "text", standard), Field("section", "section", standard))


def _analyzed(docs: DataFrame, fields: Iterable[Field]) -> DataFrame:
    """Terms of each field, of those with `words` before they are stemmed: their number is the same."""
    each = [F.struct(F.lit(f.name).alias("field"), (f.words or f.analyzer)(F.col(f.column)).alias("terms")) for f in fields]
    return docs.select("chunk_id", F.explode(F.array(*each)).alias("f")).select("chunk_id", "f.field", "f.terms").where(F.size("terms") > 0)


def field_postings(docs: DataFrame, fields: Iterable[Field] = FIELDS) -> DataFrame:
    """(field, chunk_id, term, tf, dl) of all fields, from one pass over the texts."""
    fields = tuple(fields)
    one = _analyzed(docs, fields).select("field", "chunk_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    found = one.groupBy("field", "chunk_id", "dl", "term").agg(F.count("*").alias("tf")).select("field", "chunk_id", "term", "tf", "dl")
    stemmed = [f.name for f in fields if f.words]
    if not stemmed:
        return found
    # Words of a text are counted before they meet the dictionary, which is joined as its size allows.
    words = found.where(F.col("field").isin(stemmed))
    met = words.join(stem_dictionary(words), "term").groupBy("field", "chunk_id", "dl", "stem").agg(F.sum("tf").alias("tf"))
    return found.where(~F.col("field").isin(stemmed)).unionByName(met.select("field", "chunk_id", F.col("stem").alias("term"), "tf", "dl"))


def fields_statistics(docs: DataFrame, fields: Iterable[Field] = FIELDS) -> DataFrame:
    """(field, n, avgdl): texts that have the field, and their mean length; a row for each field that occurs."""
    return _analyzed(docs, fields).groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"))


def postings(docs: DataFrame, field: str, analyzed: Column) -> DataFrame:
    """(field, chunk_id, term, tf, dl) of one field; duplicates within a text are counted before any shuffle."""
    return field_postings(docs, (Field(field, "chunk_id", lambda _: analyzed),))
