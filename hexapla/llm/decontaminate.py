"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to `BUCKETS` terms. A first pass over all passages (windows of `PASSAGE` words) counts in how many
each term occurs. The latent space is an index, fitted on the passages of all documents: their TF-IDF matrix A is multiplied by a random
test matrix, as AᵀAΩ, in one sweep whose partial sums are added up on the executors, and the Nyström form of the
randomised SVD turns the sum into right singular vectors, by which terms get whitened latent vectors. The search then
slides windows as long as the benchmark items over every whole text and compares them with all items by cosine.
A window near enough that has a word of the item's rarest quarter around it (any match must have one) is checked: the
longest common subsequence of the item's words with the words around the window, and, for paraphrases that keep only
part of the wording, whether the answer is there too. The answer is the item's `answer` column where there is one,
else the rarest words of the item.

Items are broadcast in blocks of `ITEM_BLOCK` and long items cut into pieces; one pass over the texts meets all blocks, so a
row's result never leaves it. What a worker holds grows with the benchmark (about 5 KB an item), not with the corpus. Of
the corpus only sums of fixed size reach the driver.

Defined results: texts without words match nothing; items without words are ignored; an item of fewer than
`SHORT` words must occur whole; items of one item_id are one item; repeated rows are treated alone; an empty table
gives an empty one; further columns pass through `stage`, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hexapla.llm.common import doc_groups, give_back, map_arrow, utf8_buffer
from hexapla.llm.words import word_hashes

BUCKETS, RANK, OVERSAMPLED, PASSAGE = 1 << 14, 40, 8, 32
STEP = 8  # words between window starts
SWEEP_DOCS, SWEEPS = 20_000, 32  # documents of a partial sum, at least, if there are more than SWEEPS: small partitions share one
MIN_COSINE, VERBATIM, PARAPHRASE, ANSWERED = 0.5, 0.75, 0.5, 0.8
SHORT, RARE, LONGEST, ITEM_BLOCK = 8, 5, 128, 4000
LENGTHS = (16, 32, 64, 128)
FAN_IN = 16
_FAR = 1 << 40  # more than the words of a group of texts


def _sum_rows(partials: DataFrame, dtype: str) -> np.ndarray:
    """The sum of arrays, one in each row (i: partition, blob), added up in groups of FAN_IN on the executors."""

    def add(rows: pa.Table) -> pa.Table:
        total = None
        for x in rows.column("blob"):
            v = np.frombuffer(x.as_py(), dtype)
            total = v.copy() if total is None else np.add(total, v, out=total)
        return pa.table({"i": rows.column("i")[:1], "blob": pa.array([total.tobytes()], pa.binary())})

    left = partials.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        partials = partials.withColumn("i", F.pmod("i", F.lit(left))).groupBy("i").applyInArrow(add, "i int, blob binary")
    rows = partials.collect()  # one row, or as many as FAN_IN groups left; each of fixed size
    return sum(np.frombuffer(r.blob, dtype).astype(np.float64) for r in rows)


def _per_partition(docs: DataFrame, size: int, dtype: str, f: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> DataFrame:
    """One array for each partition that has rows: f adds a group of texts (term, passage number of each word) to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_row = np.zeros(size, dtype), False
        for batch in batches:
            any_row |= batch.num_rows > 0
            for terms, passages in _passages(batch.column("text")):
                f(total, terms, passages)
        give_back()
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "blob"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "i int, blob binary")


def _groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets of rows into them) for groups of texts of bounded size."""
    raw, offsets = utf8_buffer(column)
    for a, b in doc_groups(offsets):
        words, _, _, at = word_hashes(raw, offsets[a : b + 1])
        yield a, words, at


def _passages(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, words, at in _groups(column):
        if len(words):
            lens = np.diff(at)
            counts = -(-lens // PASSAGE)
            first = np.cumsum(counts) - counts
            place = np.arange(len(words)) - np.repeat(at[:-1], lens)
            yield (words & np.uint64(BUCKETS - 1)).astype(np.int64), np.repeat(first, lens) + place // PASSAGE


def term_weights(docs: DataFrame) -> np.ndarray:
    """The inverse passage frequency of every term, over all texts."""

    def count(total: np.ndarray, terms: np.ndarray, passages: np.ndarray) -> None:
        starts = np.flatnonzero(np.diff(passages, prepend=-1))
        square = np.full((len(starts), PASSAGE), BUCKETS, np.int32)
        square[passages, np.arange(len(terms)) - starts[passages]] = terms
        square.sort(axis=1)
        fresh = square[square != np.concatenate([np.full((len(starts), 1), -1, np.int32), square[:, :-1]], axis=1)]
        total[:-1] += np.bincount(fresh, minlength=BUCKETS + 1)[:BUCKETS]
        total[-1] += len(starts)

    df = _sum_rows(_per_partition(docs, BUCKETS + 1, "int64", count), "int64")
    if np.isscalar(df):
        return np.ones(BUCKETS)
    return np.log1p(df[-1] / (1.0 + df[:-1]))


def latent_terms(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """(BUCKETS, rank) whitened latent vectors of terms, idf included."""
    width = RANK + OVERSAMPLED
    docs = docs.select("text").coalesce(max(SWEEPS, docs.count() // SWEEP_DOCS))  # nothing is shuffled but the sums
    omega = np.random.default_rng(7).standard_normal((BUCKETS, width)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((idf.astype(np.float32), omega))

    def sweep(total: np.ndarray, terms: np.ndarray, passages: np.ndarray) -> None:
        weights, test = shared.value
        w = weights[terms]
        starts = np.flatnonzero(np.diff(passages, prepend=-1))
        norm = np.sqrt(np.add.reduceat(w * w, starts))
        w = w / norm[passages]
        seen = np.add.reduceat(test[terms] * w[:, None], starts, axis=0)  # AΩ
        back = total.reshape(width, BUCKETS)
        for k in range(width):
            back[k] += np.bincount(terms, w * seen[passages, k], BUCKETS)

    y = _sum_rows(_per_partition(docs, width * BUCKETS, "float32", sweep), "float32")
    if np.isscalar(y) or not np.abs(y).max():
        return np.zeros((BUCKETS, 1), np.float32)
    y = y.reshape(width, BUCKETS).T
    core = omega.T.astype(np.float64) @ y
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    ok = value > 1e-9 * value.max()
    u, s, _ = np.linalg.svd(y @ (vector[:, ok] / np.sqrt(value[ok])), full_matrices=False)
    good = (s > 1e-6 * s[0]) & (np.arange(len(s)) < RANK)  # s: singular values of A
    return (idf[:, None] * u[:, good] / s[good]).astype(np.float32)


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, a machine word's worth of rows at a time."""
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    row = full = (1 << len(item)) - 1
    for w in words:
        if m := at.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(item) - row.bit_count()


class Items:
    """A block of benchmark pieces, ready for comparison."""

    def __init__(self, rows: list[tuple[int, str, str | None]], idf: np.ndarray, latent: np.ndarray):
        self.pieces: list[tuple[int, list[int], set[int], set[int]]] = []
        signed: list[tuple[int, int]] = []
        for item_id, text, answer in rows:
            words = _words(text)
            key = set(_words(answer).tolist()) if answer else set()
            for a in range(0, len(words), LONGEST):
                piece = words[a : a + LONGEST]
                if len(words) > LONGEST and len(piece) < LONGEST // 2:
                    piece = words[-LONGEST:]
                times = Counter(piece.tolist())
                rarest = sorted(times, key=lambda w: (-idf[w & (BUCKETS - 1)], w))
                held, signs = 0, set(key)
                for w in rarest:  # a subsequence that long can't do without all of these
                    if held > (1 - VERBATIM) * len(piece) and len(signs - key) >= RARE:
                        break
                    held += times[w]
                    signs.add(w)
                signed += [(w, len(self.pieces)) for w in signs]
                self.pieces.append((item_id, piece.tolist(), key or set(rarest[:RARE]), set(rarest)))
        signed.sort()
        self.signs = np.array([w for w, _ in signed], np.uint64)
        self.signed = np.array([i for _, i in signed], np.int64)
        self.sizes = np.array([len(p) for _, p, *_ in self.pieces], np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        level = [min(LENGTHS, key=lambda x: abs(math.log(x / max(len(p), 1)))) for _, p, *_ in self.pieces]
        for length in LENGTHS:
            own = [i for i, x in enumerate(level) if x == length]
            if own:
                v = np.stack([latent[np.array(self.pieces[i][1], np.uint64) & np.uint64(BUCKETS - 1)].sum(axis=0) for i in own])
                self.by_length[length] = np.array(own), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-20)

    def _events(self, words: np.ndarray) -> np.ndarray:
        """Sorted keys (piece, place) of the words that are a sign of a piece."""
        lo, hi = np.searchsorted(self.signs, words), np.zeros(0, np.int64)
        at = np.flatnonzero(self.signs[np.minimum(lo, len(self.signs) - 1)] == words) if len(self.signs) else hi
        lo, hi = lo[at], np.searchsorted(self.signs, words[at], side="right")
        n = hi - lo
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.sort(self.signed[entry] * _FAR + np.repeat(at, n))

    def matches(self, words: np.ndarray, at: np.ndarray, latent: np.ndarray) -> dict[int, dict[int, float]]:
        """{row: {item_id: ratio}} over a group of texts."""
        lens = np.diff(at)
        steps = -(-lens // STEP)  # a text's last step may be short
        first = np.cumsum(steps) - steps
        n = int(steps.sum())
        if not n:
            return {}
        row = np.repeat(np.arange(len(lens)), steps)
        begin = at[:-1][row] + (np.arange(n) - first[row]) * STEP
        # The words of each step, the last one's filled up with a term of no weight (the extra row of `latent`).
        terms = np.full((n, STEP), BUCKETS, np.int32)
        place = np.arange(len(words)) - np.repeat(at[:-1], lens)
        terms[np.repeat(first, lens) + place // STEP, place % STEP] = words & np.uint64(BUCKETS - 1)
        sums = latent[terms[:, 0]]
        for k in range(1, STEP):
            sums += latent[terms[:, k]]
        total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
        end_of_row = (first + steps)[row]
        out: dict[int, dict[int, float]] = {}
        events = np.append(self._events(words), np.iinfo(np.int64).max)
        for length, (own, items) in self.by_length.items():
            over = length // STEP
            stop = np.minimum(np.arange(n) + over, end_of_row)
            window = np.flatnonzero((np.arange(n) + over <= end_of_row) | (np.arange(n) == first[row]))
            v = (total[stop[window]] - total[window]).astype(np.float32)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-20)
            for a in range(0, len(window), 1 << 14):
                near, which = np.nonzero(v[a : a + (1 << 14)] @ items.T >= MIN_COSINE)
                w, i = window[a + near], own[which]
                size = self.sizes[i]
                lo = np.maximum(begin[w] - size // 2 - STEP, at[row[w]])
                hi = np.minimum(begin[w] + np.maximum(size, length) + size // 2 + STEP, at[row[w] + 1])
                signed = events[np.searchsorted(events, i * _FAR + lo)] < i * _FAR + hi
                for r, i, lo, hi in zip(*(x[signed].tolist() for x in (row[w], i, lo, hi)), strict=True):
                    item_id, piece, answer, distinct = self.pieces[i]
                    if out.get(r, {}).get(item_id, 0.0) >= 1.0:
                        continue
                    around = words[lo:hi].tolist()
                    held = set(around)
                    answered = len(piece) >= SHORT and len(answer & held) >= ANSWERED * len(answer)
                    least = 1.0 if len(piece) < SHORT else PARAPHRASE if answered else VERBATIM
                    if len(distinct & held) < len(distinct) - (1 - least) * len(piece):
                        continue  # too many words of the item aren't there at all
                    ratio = common_subsequence(piece, around) / len(piece)
                    if ratio < least:
                        continue
                    kept = out.setdefault(r, {})
                    kept[item_id] = max(kept.get(item_id, 0.0), ratio)
        return out


def _words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: Column | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, contaminated, item_ids (sorted), best_ratio; with `key`, that in place of doc_id."""
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long") if key is None else key
    idf = term_weights(docs)
    latent = latent_terms(docs, idf)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.alias("answer")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = -(-items.count() // ITEM_BLOCK) or 1
    dealt = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() for b in range(blocks))
    shared = [spark.sparkContext.broadcast(Items([tuple(r) for r in rows], idf, latent)) for rows in dealt]
    terms = spark.sparkContext.broadcast(np.concatenate([latent, np.zeros((1, latent.shape[1]), np.float32)]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
        for a, words, at in _groups(batch.column("text")):
            for block in shared:  # a block holds some items only, so their results don't meet
                for r, x in block.value.matches(words, at, terms.value).items():
                    for item_id, ratio in x.items():
                        hits[a + r][item_id] = max(ratio, hits[a + r].get(item_id, 0.0))
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([bool(x) for x in hits]), pa.array([sorted(x) for x in hits], pa.list_(pa.int64())),
            pa.array([max(x.values(), default=0.0) for x in hits], pa.float64()),
        ], ["doc_id", "contaminated", "item_ids", "best_ratio"])

    rows_in = docs.select(key.alias("doc_id"), F.col("text").cast("string"))
    return map_arrow(rows_in, run, f"doc_id {rows_in.schema['doc_id'].dataType.simpleString()}, contaminated boolean, item_ids array<long>, best_ratio double")


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, in all their columns; a doc_id one of whose rows does goes, and of the rows without one each by its own text."""
    row_key = lambda doc, text: F.coalesce(doc.cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)))
    hit = decontaminate(docs, benchmark, row_key(F.col("doc_id"), F.col("text"))).where("contaminated").select(F.col("doc_id").alias("hit_id")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    left = whole.join(hit, row_key(F.col("d.doc_id"), F.col("d.text")) == F.col("hit_id"), "left_anti")
    return left.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
