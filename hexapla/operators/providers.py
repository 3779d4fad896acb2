"""Model-backed stages behind small interfaces, with deterministic stand-ins that need no model.

A provider is a function of one value (or two), run over Arrow batches, or, as `Batch`, of lists of them; `Loaded` makes one of a model that
each Python worker loads when it first needs it. The stand-ins match the operators' shape, not any model's quality."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StringType

_WORD = re.compile(r"[^\W_]+")


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """Signed feature hashing of words, at unit length."""
    v = np.zeros(dim)
    for w in _WORD.findall((text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def overlap(query: str, text: str) -> float:
    a, b = set(_WORD.findall((query or "").lower())), set(_WORD.findall((text or "").lower()))
    return len(a & b) / len(a) if a else 0.0


def extractive_draft(prompt: str) -> str:
    """The first sentence of each source block, with its marker."""
    out = []
    before, mark, passages = (prompt or "").partition("PASSAGES\n")
    for n, body in re.findall(r"\[SOURCE (\d+)\][^\n]*\n(.*?)(?=\n\n\[SOURCE |\Z)", passages if mark else before, re.S):
        text = re.sub(r"^(?:English|Original): ", "", body.strip())
        out.append(f"{re.split(r'(?<=[.?!。])', text)[0].strip()[:200]} [SOURCE {n}]")
    return "\n".join(out)


def overlap_judge(prompt: str) -> str:
    """Every drafted line against the sources it cites: supported if most of its words are there."""
    context = (prompt or "").partition("SOURCES\n")[2] or prompt or ""
    sources = dict(re.findall(r"\[SOURCE (\d+)\][^\n]*\n(.*?)(?=\n\n\[SOURCE |\n\nDRAFT|\Z)", context, re.S))
    draft = (prompt or "").rpartition("DRAFT\n")[2]
    checks = []
    for line in filter(None, draft.split("\n")):
        ids = [int(x) for x in re.findall(r"\d+", " ".join(re.findall(r"\[SOURCES?\s+([^\]]+)\]", line)))]
        claim = re.sub(r"\s*\[SOURCE[^\]]*\]", "", line)
        ok = bool(ids) and any(overlap(claim, sources.get(str(i), "")) >= 0.5 for i in ids)
        checks.append({"claim": claim, "cited_sources": ids, "supported": ok, "issue": "" if ok else "not found in the cited sources"})
    return json.dumps({"claim_checks": checks, "report": f"{sum(c['supported'] for c in checks)} of {len(checks)} claims supported", "needs_more_retrieval": False}, ensure_ascii=False)


def echo_analysis(prompt: str) -> str:
    question = (prompt or "").rpartition("QUESTION\n")[2].strip()
    return json.dumps({"expanded_query": question, "medical_concepts": []}, ensure_ascii=False)


@dataclass(frozen=True)
class Batch:
    """A provider of lists: `f` takes as many values as `size`, at most, and gives as many answers. The values of an Arrow batch are
    taken in order of their length, so those of a call are about as long as each other and little is padded; the answers go back to their
    rows. Nulls are empty texts; with `longest`, texts are cut at so many characters."""

    f: Callable[..., list]
    size: int = 32
    longest: int | None = None

    def over(self, *columns: pd.Series) -> list:
        texts = [["" if pd.isna(x) else x[: self.longest] for x in c] for c in columns]
        order = sorted(range(len(texts[0])), key=lambda i: sum(len(t[i]) for t in texts))
        out: list = [None] * len(order)
        for a in range(0, len(order), self.size):
            own = order[a : a + self.size]
            answers = self.f(*[[t[i] for i in own] for t in texts])
            if len(answers) != len(own):
                raise ValueError(f"{len(answers)} answers to {len(own)} values")
            for i, answer in zip(own, answers, strict=True):
                out[i] = answer
        return out


def _column(f: Callable | Batch, kind: str) -> Callable[..., Column]:
    """Calls cost, and their answers differ: the optimizer may neither repeat nor move them."""

    arrow = to_arrow_type({"string": StringType(), "array<double>": ArrayType(DoubleType())}[kind])

    @F.arrow_udf(kind)
    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:  # values leave their batch one at a time, as prompts may be long
            yield pa.array(f.over(s.to_pandas()) if isinstance(f, Batch) else (f(x.as_py()) for x in s), arrow)

    return one.asNondeterministic()


_models: dict[str, Callable] = {}


@dataclass(frozen=True)
class Loaded:
    """A provider whose model is built by `factory` once in each worker; `name` tells models apart."""

    name: str
    factory: Callable[[], Callable]

    def __call__(self, *values):
        if self.name not in _models:
            _models[self.name] = self.factory()
        return _models[self.name](*values)


@dataclass(frozen=True)
class Providers:
    embed: Callable[[str], list[float]] | Batch = hashed_embedding
    rerank: Callable[[str, str], float] | Batch = overlap
    analyse: Callable[[str], str] = echo_analysis
    write: Callable[[str], str] = extractive_draft
    judge: Callable[[str], str] = overlap_judge

    def embedding(self, text: Column) -> Column:
        return _column(self.embed, "array<double>")(text)

    def reranked(self, query: Column, text: Column) -> Column:
        f = self.rerank

        @F.pandas_udf("double")
        def pairs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, t in batches:
                yield pd.Series(f.over(q, t) if isinstance(f, Batch) else [f(a, b) for a, b in zip(q, t, strict=True)], dtype="float64")

        return pairs.asNondeterministic()(query, text)

    def chat(self, f: Callable[[str], str], prompt: Column) -> Column:
        return _column(f, "string")(prompt)


def is_missing(text: str = "text_translation") -> Column:
    return F.coalesce(F.btrim(text), F.lit("")) == ""


def enrich_missing(rows: DataFrame, translate: Callable[[str], str], attempts: int = 3, wait: float = 2.0, prompt: Column | None = None) -> DataFrame:
    """Fills text_translation where it is blank from `prompt` (the text, if none is given). A call that fails or answers nothing is
    repeated after `wait` times the number of the attempt seconds; a text that fails every attempt stays null for the next run."""

    def patient(text: str) -> str | None:
        for k in range(1, attempts + 1):
            try:
                if answer := (translate(text) or "").rpartition("</think>")[2].strip():
                    return answer
            except Exception:  # noqa: BLE001  the provider's failures are data here
                pass
            if k < attempts:
                time.sleep(wait * k)
        return None

    blank = is_missing()
    todo, done = rows.where(blank), rows.where(~blank)
    return done.unionByName(todo.withColumn("text_translation", _column(patient, "string")(F.col("text") if prompt is None else prompt)))


def enrich_in_slices(rows: DataFrame, path: str, translate: Callable[[str], str], slices: int = 10, **how) -> DataFrame:
    """Translations of the rows without one, kept at `path` (chunk_id, text_translation): each slice of the rest is written before the
    next begins, so a run that fails loses a slice and the next one goes on with what isn't there. Returns the rows, filled."""
    spark = rows.sparkSession
    schema = f"chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, text_translation string"
    for k in range(slices):
        spark.createDataFrame([], schema).write.mode("append").parquet(path)  # there is something to read
        known = spark.read.schema(schema).parquet(path).select("chunk_id")
        todo = rows.where(is_missing() & (F.pmod(F.xxhash64("chunk_id"), F.lit(slices)) == k)).join(known, "chunk_id", "left_anti")
        enrich_missing(todo, translate, **how).where(~is_missing()).select("chunk_id", "text_translation").write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path).dropDuplicates(["chunk_id"]).select("chunk_id", F.col("text_translation").alias("_new"))
    return rows.join(found, "chunk_id", "left").withColumn("text_translation", F.when(is_missing(), F.col("_new")).otherwise(F.col("text_translation"))).drop("_new").select(*rows.columns)
