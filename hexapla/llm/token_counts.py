"""Token counts of sections, from one encoding of the whole document.

A document is encoded once; the byte lengths of its tokens give every token's span. Sections are character spans
of the document. Both are sorted, so an interval join of each document's tokens with its sections is a binary
search. A token that crosses a boundary goes whole to one section, by `rule`: "start", the section that holds its
first character (a token may begin inside a character; then it is that character); or "most", the one that holds
most of its bytes, the earlier one among equals. Tokens outside all sections are counted as such.

Defined results: a null text is empty and has one empty section; sections may leave gaps but mustn't overlap;
repeated rows are treated alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from hexapla.llm.byte_bpe import parse_ranks
from hexapla.llm.common import map_arrow

Spans = np.ndarray  # (n, 2): first character and end of each section, in order


def lines(text: str) -> Spans:
    """Each line with the line feed that ends it is a section."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    starts = np.concatenate([[0], ends])
    return np.column_stack([starts, np.append(ends, len(text))]).astype(np.int64)


class Encoder:
    def __init__(self, raw: bytes, pattern: str):
        ranks = parse_ranks(raw)
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.bytes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end byte of every token."""
        ends = np.cumsum(self.bytes[np.array(self.encode(text), np.int64)]) if text else np.zeros(0, np.int64)
        return np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], ends


def attribute(starts: np.ndarray, ends: np.ndarray, text: str, sections: Spans, rule: str = "start") -> tuple[np.ndarray, int, int]:
    """Tokens of each section, tokens outside all, tokens that cross a boundary."""
    raw = np.frombuffer(text.encode(), np.uint8)
    at_char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    first, last = at_char[sections[:, 0]], at_char[sections[:, 1]]
    if rule == "start":
        begin = np.searchsorted(at_char, starts, side="right") - 1  # the character that a token begins in
        k = np.searchsorted(first, at_char[begin], side="right") - 1
        inside = (k >= 0) & (at_char[begin] < last[np.maximum(k, 0)])
        # Empty sections share a first byte with the next one; the search took the last of them, which is the full one.
    elif rule == "most":
        k = np.searchsorted(last, starts, side="right")
        stop = np.searchsorted(first, ends, side="left")
        share = lambda x: np.maximum(np.minimum(ends, last[np.minimum(x, len(last) - 1)]) - np.maximum(starts, first[np.minimum(x, len(last) - 1)]), 0) * (x < len(last))
        best, most = k.copy(), share(k)
        for step in range(1, int((stop - k).max(initial=0))):
            now = share(k + step)
            better = now > most
            best[better], most[better] = k[better] + step, now[better]
        k, inside = np.minimum(best, len(last) - 1), most > 0
    else:
        raise ValueError(f"no such rule: {rule}")
    bounds = np.unique(np.concatenate([first, last]))
    crossing = np.searchsorted(bounds, starts, side="right") < np.searchsorted(bounds, ends, side="left")
    return np.bincount(k[inside], minlength=len(sections)), int((~inside).sum()), int(crossing.sum())


_encoders: dict[tuple[str, str], Encoder] = {}


def count(docs: DataFrame, ranks_path: str, pattern: str, sections: Callable[[str], Spans] = lines, rule: str = "start") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, n_sections, section_tokens, n_outside, n_crossing."""
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = hashlib.sha256(shared.value).hexdigest(), pattern
        if key not in _encoders:
            _encoders[key] = Encoder(shared.value, pattern)
        n, counts, outside, crossing = [], [], [], []
        for scalar in batch.column("text"):
            text = scalar.as_py() or ""
            starts, ends = _encoders[key].spans(text)
            own, out, cross = attribute(starts, ends, text, sections(text), rule)
            n.append(len(ends))
            counts.append(own)
            outside.append(out)
            crossing.append(cross)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(x) for x in counts], pa.int64()), pa.array(counts, pa.list_(pa.int64())), pa.array(outside, pa.int64()), pa.array(crossing, pa.int64()),
        ], ["doc_id", "n_tokens", "n_sections", "section_tokens", "n_outside", "n_crossing"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, n_sections long, section_tokens array<long>, n_outside long, n_crossing long")
