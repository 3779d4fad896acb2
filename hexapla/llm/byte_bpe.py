"""Byte-level BPE encoding and decoding of whole texts.

Each match of the split pattern is merged on its own with a rank queue made of a two-level bitmap: a bucket
per merge rank holds positions of the piece's linked list, find-first-set on the levels picks the lowest rank
present, and entries whose pair has changed meanwhile are skipped as stale. Merging n bytes takes O(n log n) whatever
their length. Pieces met before come from a bounded two-generation cache.

Defined results: a null text is empty; an empty text has no tokens and decodes to no bytes; special-token
strings are ordinary text; each row is treated alone, so repeated rows and null ids change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from hexapla.llm.common import map_arrow

CACHE_ENTRIES, CACHED_LENGTH = 350_000, 48
#: Two bitmap levels of 256 bits hold 65,536 ranks; a larger vocabulary only widens the upper one.
WIDTH = 8
MASK = (1 << WIDTH) - 1
BITS = [1 << i for i in range(MASK + 1)]
SINGLE = [bytes([i]) for i in range(256)]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: lowest rank first, leftmost first among equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    get = ranks.get
    n = len(piece)
    parts = [SINGLE[b] for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # Rank of the pair that begins here; -1: none.
    live = [get(piece[i : i + 2], -1) for i in range(n - 1)]
    live.append(-1)
    pending = 0  # pairs with a rank; what is queued when there are none left is stale
    top = 0  # a bit for each word that isn't zero
    words: dict[int, int] = {}  # a bit for each rank that has a bucket
    buckets: dict[int, list[int]] = {}  # heaps of positions, some of them stale
    for i, r in enumerate(live):
        if r >= 0:
            pending += 1
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                w = r >> WIDTH
                if w in words:
                    words[w] |= BITS[r & MASK]
                else:
                    words[w] = BITS[r & MASK]
                    top |= 1 << w
    while pending:
        w = (top & -top).bit_length() - 1
        m = words[w]
        low = m & -m
        rank = w << WIDTH | low.bit_length() - 1
        bucket = buckets[rank]
        lower = False
        while bucket and not lower:
            at = heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if live[at] != rank:
                continue
            gone = after[at]
            joined = parts[at] = parts[at] + parts[gone]
            pending -= 1
            live[at] = -1
            if live[gone] >= 0:
                live[gone] = -1
                pending -= 1
            right = after[at] = after[gone]
            left = before[at]
            if right < n:
                before[right] = at
                if (r := get(joined + parts[right])) is not None:
                    live[at] = r
                    pending += 1
                    if r < rank:
                        lower = True
                    if r in buckets:
                        heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        v = r >> WIDTH
                        if v in words:
                            words[v] |= BITS[r & MASK]
                        else:
                            words[v] = BITS[r & MASK]
                            top |= 1 << v
            if left >= 0:
                if live[left] >= 0:
                    pending -= 1
                if (r := get(parts[left] + joined)) is not None:
                    live[left] = r
                    pending += 1
                    if r < rank:
                        lower = True
                    if r in buckets:
                        heappush(buckets[r], left)
                    else:
                        buckets[r] = [left]
                        v = r >> WIDTH
                        if v in words:
                            words[v] |= BITS[r & MASK]
                        else:
                            words[v] = BITS[r & MASK]
                            top |= 1 << v
                else:
                    live[left] = -1
        if not bucket:
            del buckets[rank]
            m = words[w] & ~BITS[rank & MASK]
            if m:
                words[w] = m
            else:
                del words[w]
                top &= ~(1 << w)
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Codec:
    def __init__(self, raw: bytes, pattern: str):
        self.ranks = parse_ranks(raw)
        self.tokens: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # White space as the tiktoken library has it, without U+001C to U+001F.
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.young: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit integers, a third of a list's memory
        self.old: dict[str, bytes] = {}

    def _missing(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            found = merge(piece.encode(), self.ranks)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= CACHED_LENGTH:
            if len(self.young) >= CACHE_ENTRIES:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces = self.split(text)
        found = list(map(self.young.get, pieces))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self.young.get(pieces[at]) or self._missing(pieces[at])
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(raw).hexdigest(), pattern
    if key not in _codecs:
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def _shared(docs: DataFrame, ranks_path: str):
    """The rank file, of fixed size, for all executors; only the driver opens it."""
    with open(ranks_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids: array<int>, decoded: binary) of every row."""
    shared = _shared(docs, ranks_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared.value, pattern)
        ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>, decoded binary")


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The contract's row for each document; ids and bytes are hashed where they are made."""
    shared = _shared(docs, ranks_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared.value, pattern)
        n, ids_sha, decoded_sha = [], [], []
        for scalar in batch.column("text"):
            ids = codec.packed(scalar.as_py() or "")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(codec.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
