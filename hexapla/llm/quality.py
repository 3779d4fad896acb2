"""Document quality by co-training.

Two classifiers see different views of a document: its content (character classes, repetition, word shape) and
its page metadata (source, language, declared length, line layout). Each is a logistic regression fitted on
labelled documents. Then, over `ROUNDS`, both score every unlabelled document of the table on the executors, and each hands
those of each kind that it is most certain of, and that it hasn't handed over before, to the other: `SHARE` of the number it was trained on; documents with the same features count
once. Both views learn from all labelled documents of the sample. Their calibrations are fitted on one half of these, and the
logistic combination of the calibrated views that scores every document on the other, with the outputs of models that were
trained without the document's own third.

Training takes at most `LABELLED` labelled documents, chosen by a hash of their id; only their feature vectors and those handed over
reach the driver. Defined results: null and empty texts have all-zero content features; null
metadata is a value of its own; without labels of both kinds in every part every score is 0.5 and every document is accepted;
repeated rows are treated alone; a doc_id with several labels takes their majority, ties upward; of equally certain
documents those with the smaller hash of the features are handed over; an empty table gives an empty one; missing columns are
nulls; further columns pass through `stage`, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hexapla.llm.common import binary_rows, cut, doc_groups, give_back, map_arrow, matrix_of, utf8_buffer
from hexapla.llm.words import word_hashes

LABELLED, ROUNDS = 6000, 3
CERTAIN, SHARE = 0.97, 0.1
ACCEPT = 0.5
HASHED = 32
METADATA = 2 * HASHED + 8
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b"\n", b".,;:", b"!?", b"%$#*&@~^=+<>", b"|/\\_", b"'\"()[]{}-"]
CONTENT = len(_CLASSES) + 9
_LUT = np.full(256, len(_CLASSES), np.int64)  # the rest: non-ASCII and control bytes
for _k, _chars in enumerate(_CLASSES):
    _LUT[list(_chars)] = _k


def content_features(column: pa.Array) -> np.ndarray:
    raw, offsets = utf8_buffer(column)
    parts = []
    for a, b in doc_groups(offsets):
        parts.append(_content(raw, offsets[a : b + 1]))
    return np.concatenate(parts) if parts else np.zeros((0, CONTENT))


def _content(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * (len(_CLASSES) + 1) + _LUT[raw[offsets[0] : offsets[-1]]], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)
    share = kinds / np.maximum(size, 1)[:, None]
    words, _, lens, at = word_hashes(raw, offsets)
    count = np.diff(at)
    owner = np.repeat(np.arange(n), count)
    keyed = np.lexsort((words, owner))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[keyed][1:] != words[keyed][:-1]) | (owner[keyed][1:] != owner[keyed][:-1])
    distinct = np.bincount(owner[keyed][fresh], minlength=n)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[again], minlength=n)
    some = np.maximum(count, 1)
    mean_len = np.bincount(owner, lens, n) / some
    upper = kinds[:, 0] / np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    return np.column_stack([share, np.log1p(count), distinct / some, repeats / some, mean_len, np.log1p(distinct), upper, share[:, 7] > 0.02, share[:, 8] > 0.02])


def metadata_features(source: list, lang: list, n_chars: list, lines: np.ndarray) -> np.ndarray:
    """Hashed source and language, and the layout of the page."""
    out = np.zeros((len(source), METADATA))
    for i, (s, x) in enumerate(zip(source, lang, strict=True)):
        out[i, zlib.crc32(repr(s).encode()) % HASHED] = 1
        out[i, HASHED + zlib.crc32(repr(x).encode()) % HASHED] = 1
    size = np.array([float(x) if x is not None and x >= 0 else np.nan for x in n_chars])
    known = ~np.isnan(size)
    size = np.where(known, size, 0.0)
    per_line = size / np.maximum(lines, 1)
    out[:, 2 * HASHED :] = np.column_stack([known, np.log1p(size), np.log1p(size) ** 2 / 10, np.log1p(lines), np.log1p(per_line), size < 60, size < 200, lines == 1])
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, content: binary of floats, metadata: binary of floats) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, meta = _views(batch)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), binary_rows(content.astype("<f4")), binary_rows(meta.astype("<f4"))], ["doc_id", "content", "metadata"])

    return map_arrow(_columns(docs), run, "doc_id long, content binary, metadata binary")


def _stored(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [matrix_of(batch.column(c), "<f4", n).astype(np.float64) for c, n in (("content", CONTENT), ("metadata", METADATA))]


def _columns(docs: DataFrame) -> DataFrame:
    has = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), has("source", "string"), has("lang", "string"), has("n_chars", "long"))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = utf8_buffer(batch.column("text"))
    newlines = np.flatnonzero(raw[offsets[0] : offsets[-1]] == 10) + offsets[0]
    lines = np.diff(np.searchsorted(newlines, offsets)) + 1
    meta = metadata_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), lines)
    return content_features(batch.column("text")), meta


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._z(x)
        weight = np.ones(len(y)) if weight is None else weight
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty * self.w)
            self.w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


class CoTrained:
    """Both views' classifiers, their calibrations and the combination; unusable where labels don't allow any."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray):
        n = np.arange(len(y))
        self.fold, self.half = n % 3, n // 3 % 2
        parts = [self.fold != f for f in range(3)] + [self.half == h for h in (0, 1)]
        self.usable = all((y[p] == c).sum() >= 2 for p in parts for c in (0, 1))
        self.views, self.y = views, y
        self.gained: list[list[tuple[float, np.ndarray]]] = [[], []]  # for each view what it learnt from the other
        if self.usable:
            self.models = [self._trained(k, np.ones(len(y), bool)) for k in (0, 1)]

    def _trained(self, k: int, rows: np.ndarray) -> Logistic:
        """View k's classifier of some labelled documents and all that were handed over."""
        x, y = self.views[k][rows], self.y[rows]
        if self.gained[k]:
            x, y = np.concatenate([x, np.array([g[1] for g in self.gained[k]])]), np.concatenate([y, [g[0] for g in self.gained[k]]])
        return Logistic(x, y, np.concatenate([np.ones(rows.sum()), np.full(len(self.gained[k]), 0.5)]))

    def certain(self, free: DataFrame, taken: set[tuple[int, int]]) -> list[tuple[int, float, int, bytes]]:
        """(view that hands over, label, hash, features for the other view) of the documents handed over in a round.

        Every partition of `free` is scored whole and sends on its most certain documents only."""
        models = self.models
        most = {label: math.ceil(SHARE * (self.y == label).sum()) for label in (1.0, 0.0)}
        cols = {"view": pa.int32(), "label": pa.float64(), "p": pa.float64(), "fp": pa.int64(), "x": pa.binary()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, float], dict[int, tuple[float, bytes]]] = {(v, label): {} for v in (0, 1) for label in most}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _stored(batch)
                fp = batch.column("fp").to_numpy()
                for (view, label), held in best.items():
                    p = models[view].probability(x[view])
                    sure = p if label else 1 - p
                    order = np.lexsort((fp, -sure))
                    new = 0
                    for i in order[sure[order] >= CERTAIN]:
                        if new == most[label]:
                            break
                        if (view, int(fp[i])) not in taken and int(fp[i]) not in held:
                            held[int(fp[i])] = float(sure[i]), x[1 - view][i].astype("<f4").tobytes()
                            new += 1
                    for f in sorted(held, key=lambda f: (-held[f][0], f))[most[label] :]:
                        del held[f]
            rows = [(view, label, p, f, x) for (view, label), held in best.items() for f, (p, x) in held.items()]
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(cols.values())], list(cols))

        found = cut(free.mapInArrow(run, "view int, label double, p double, fp long, x binary").dropDuplicates(["view", "label", "fp"]))
        out = []
        for view in (0, 1):
            for label, n in most.items():
                out += found.where((F.col("view") == view) & (F.col("label") == label)).orderBy(F.desc("p"), "fp").limit(n).collect()
        return [(r.view, r.label, r.fp, r.x) for r in out]

    def teach(self, free: DataFrame) -> None:
        """The rounds in which each view learns from what the other is certain of."""
        taken: set[tuple[int, int]] = set()
        for _ in range(ROUNDS):
            for view, label, fp, x in self.certain(free, taken):
                self.gained[1 - view].append((label, np.frombuffer(x, "<f4").astype(float)))
                taken.add((view, fp))
            self.models = [self._trained(k, np.ones(len(self.y), bool)) for k in (0, 1)]

    def finish(self) -> None:
        """Calibrations on one half of the labelled documents and the combination on the other, by models that weren't trained on them."""
        z = np.zeros((len(self.y), 2))
        for f in range(3):
            for k in (0, 1):
                z[self.fold == f, k] = self._trained(k, self.fold != f).logit(self.views[k][self.fold == f])
        one, two = self.half == 0, self.half == 1
        self.calibrations = [Logistic(z[one, k : k + 1], self.y[one], ridge=0.1) for k in (0, 1)]
        self.combination = Logistic(np.column_stack([c.logit(z[two, k : k + 1]) for k, c in enumerate(self.calibrations)]), self.y[two], ridge=0.1)
        del self.views, self.y, self.fold, self.half, self.gained

    def _calibrated(self, views: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([c.logit(m.logit(v)[:, None]) for c, m, v in zip(self.calibrations, self.models, views, strict=True)])

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by content, by metadata, and combined."""
        if not self.usable:
            return (np.full(len(content), 0.5),) * 3
        z = self._calibrated([content, metadata])
        own = 1 / (1 + np.exp(-z))
        return own[:, 0], own[:, 1], self.combination.probability(z)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[CoTrained, DataFrame]:
    """The trained views, and the features of all rows that they were trained on."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where("id IS NOT NULL AND quality IS NOT NULL")
    marked = marked.groupBy("id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    every = cut(features(docs).join(marked, F.col("doc_id") == F.col("id"), "left").withColumn("fp", F.xxhash64("content", "metadata")).drop("id"))
    chosen = every.where("quality IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(LABELLED)
    rows = every.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "content", "metadata").count()  # at most LABELLED ids
    known = sorted(rows.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, bytes(r.content)))
    view = lambda k: np.array([np.frombuffer(r[k], "<f4") for r in known], float) if known else np.zeros((0, 1))
    model = CoTrained((view("content"), view("metadata")), np.array([r.quality for r in known], float))
    if model.usable:
        model.teach(every.where("quality IS NULL").select("fp", "content", "metadata"))
        model.finish()
    return model, every


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, content_score, metadata_score, score, accepted."""
    model, every = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, metadata, both = shared.value.scores(*_stored(batch))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content), pa.array(metadata), pa.array(both), pa.array(both >= ACCEPT)], ["doc_id", "content_score", "metadata_score", "score", "accepted"])

    return map_arrow(every.select("doc_id", "content", "metadata"), run, "doc_id long, content_score double, metadata_score double, score double, accepted boolean")


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The accepted documents in all their columns; decided row by row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)[0])
    names = ("doc_id", "text", "source", "lang", "n_chars")
    kinds = {"n_chars": "long", "doc_id": "long"}
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *[(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in names])

    def run(batch: pa.RecordBatch) -> pa.Table:
        content, metadata = (v.astype(np.float32).astype(np.float64) for v in _views(batch))
        kept = shared.value.scores(content, metadata)[2] >= ACCEPT
        return pa.Table.from_batches([batch.select(["d"])]).filter(pa.array(kept))

    return map_arrow(whole, run, whole.select("d").schema).select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
