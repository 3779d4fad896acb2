"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

Sentences are compared by the subsequences of three letters, within a span of `SPAN`, of their words, each weighted by
`DECAY` to the power of its span, so inserted, dropped or spaced-out letters cost little. A mark before a word's first letter
takes part, so beginnings count. Letters are folded first: case, digits that stand for letters, punctuation inside a
word, and runs of single letters become one word. The kernel of two sentences adds up the normalised kernels of their words, over
the root of both numbers of words; so insults of several words add up. Landmarks are words of the training
sentences; Nyström features K(x, L) K(L, L)^-1/2 feed a linear SVM with squared hinge loss. As a linear function of K(x, L)
is one of the subsequence weights, a word's part of a margin is a sum over a fixed table, divided by the word's own kernel
norm, and a sentence's margin the sum of its words' parts over the root of their number.

Labels belong to whole texts, so training sentences are found by multiple-instance rounds: in each toxic text the sentence
with the highest margin (before the first round the one whose letter groups are most typical of toxic texts), in clean texts random
sentences and those with the highest margins. Exclamations of one word take part as sentences of their own: of a toxic text the two
words that speak most for it, of clean texts random, frequent and high ones. A text's score is a logistic function, fitted on texts left out of the
SVM, of its two highest sentence margins and its two highest word margins, over all sentences of the whole text. A sentence ends with a word that ends in
one of `STOPS`, or after `LONG` words.

Training takes at most `TOXIC_SAMPLE` and `CLEAN_SAMPLE` labelled texts, chosen by a hash of their id. Defined
results: a text without words (null, empty) has the margin of a sentence without subsequences; without labels of both
kinds every score is 0; a doc_id with several labels counts as toxic if one says so, and one with several texts trains with the
largest of them; repeated rows are scored alone; an empty table gives an empty one; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hexapla.llm.common import map_arrow

SPAN, DECAY, LETTERS, LONGEST = 6, 0.7, 64, 25
ANCHOR, END = "^", "$"  # stand before the first letter and, in counts, after the last
LANDMARKS, ROUNDS = 320, 3
STOPS, LONG = ".!?;:…。！？", 30
LEAST_ODDS = 1.5
TOXIC_SAMPLE, CLEAN_SAMPLE, TOXIC_WEIGHT = 1000, 3000, 1.5
THRESHOLD = 0.3
CACHE = 400_000
NEGATIVES, SENTENCES, WORDS = 2500, 1500, 3000  # clean sentences in the first round; weights of both kinds of instances
GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_LEET = str.maketrans("013457@$!", "oieastasi")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_ENDS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789¡¿«»“”„‘’…–—"
_SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]*\s+){2,}\w[^\w\s]*(?!\S)")


def tokens(text: str) -> list[str]:
    """Words of a whole text as they stand, and each run of three or more single letters as one more word."""
    low = text.lower()
    out = low.split()
    if runs := _SPACED.findall(low):
        out += ["".join(r.split()) for r in runs]
    return out


def letters(token: str) -> str:
    token = token.strip(_ENDS)
    if not token.isalpha():
        token = _NOT_LETTER.sub("", token.translate(_LEET))
    return token


def _codes(words: list[str], width: int) -> np.ndarray:
    """A row for each word: its letters' codes, then zeros."""
    x = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), width), np.int64)
    out[np.arange(width) < size[:, None]] = np.where((x >= 97) & (x <= 122), x - 96, np.where(x == ord(ANCHOR), LETTERS - 1, 27 + x % (LETTERS - 28)))
    return out


def _subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes (0: none) and weights, for words of at most LONGEST letters."""
    width = max(map(len, words), default=0)
    c = np.pad(_codes(words, width), ((0, 0), (0, SPAN)))
    codes, weights = [], []
    for a, b in GAPS:
        if b < width:
            i, j, k = c[:, :width], c[:, a : a + width], c[:, b : b + width]
            codes.append(np.where(k > 0, (i * LETTERS + j) * LETTERS + k, 0)[:, : width - b])
            weights.append(np.full(width - b, DECAY ** (b + 1)))
    if not codes:
        return np.zeros((len(words), 1), np.int64), np.zeros(1)
    return np.concatenate(codes, axis=1), np.concatenate(weights)


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of every word's kernel with itself."""
    order = np.argsort(codes, axis=1)
    code = np.take_along_axis(codes, order, axis=1)
    w = np.where(code > 0, weights[order], 0.0)
    total = (w * w).sum(axis=1)
    rows = np.arange(len(codes))
    for lag in range(1, codes.shape[1]):
        same = (code[rows, lag:] == code[rows, :-lag]) & (code[rows, lag:] > 0)
        some = same.any(axis=1)
        if not some.any():
            break
        rows = rows[some]
        total[rows] += 2 * (w[rows, lag:] * w[rows, :-lag] * same[some]).sum(axis=1)
    return np.sqrt(total)


def _pieces(word: str) -> list[str]:
    """A long word in overlapping pieces, so that all of it counts."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _table_scores(words: list[str], table: np.ndarray) -> np.ndarray:
    """Normalised table sums: for each word the largest over its pieces."""
    parts = [p for w in words for p in _pieces(ANCHOR + w)]
    owner = np.repeat(np.arange(len(words)), [len(_pieces(ANCHOR + w)) for w in words])
    flat = np.zeros(len(parts))
    lens = np.array([len(p) for p in parts])
    for lo, hi in ((0, 7), (7, 10), (10, 13), (13, 17), (17, LONGEST)):
        own = np.flatnonzero((lens > lo) & (lens <= hi))
        for a in range(0, len(own), 5000):
            some = own[a : a + 5000]
            codes, weights = _subsequences([parts[i] for i in some])
            norm = _norms(codes, weights)
            flat[some] = (table[codes] * weights).sum(axis=1) / np.maximum(norm, 1e-12)
    out = np.full(len(words), -np.inf)
    np.maximum.at(out, owner, flat)
    return out


def _kernel(words: list[str], phi: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Normalised kernel of words (their first pieces) with landmarks given by their subsequence weights; `place` has
    the column of each code (0, of zeros, for those that no landmark has)."""
    by_code = np.ascontiguousarray(phi.T)
    out = np.zeros((len(words), len(phi)))
    for a in range(0, len(words), 200):
        codes, weights = _subsequences([(ANCHOR + w)[:LONGEST] for w in words[a : a + 200]])
        raw = np.einsum("ijk,j->ik", by_code[place[codes]], weights.astype(np.float32), optimize=True)
        out[a : a + 200] = raw / np.maximum(_norms(codes, weights), 1e-12)[:, None]
    return out


class Model:
    """Subsequence weights and bias of the SVM, and the logistic function of a text's margins."""

    def __init__(self, table: np.ndarray, bias: float, logistic: np.ndarray):
        self.table, self.bias, self.logistic = table.astype(np.float32), bias, logistic
        self.name = hashlib.sha256(self.table.tobytes() + np.array([bias, *logistic]).tobytes()).hexdigest()

    def parts(self, words: list[str]) -> np.ndarray:
        """What each word adds to a sentence's margin."""
        return _table_scores(words, self.table) if words else np.zeros(0)


_END = 1e6  # added to the parts of words that end a sentence


def sentence_margins(parts: np.ndarray, bias: float) -> np.ndarray:
    """Margins of a text's sentences from the parts of its words in order; _END is on those that end one."""
    ends = parts > _END / 2
    parts = np.where(ends, parts - _END, parts)
    begins = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
    if len(parts) > LONG:  # long runs are cut
        place = np.arange(len(parts))
        offset = place - np.repeat(begins, np.diff(np.append(begins, len(parts))))
        begins = np.flatnonzero(offset % LONG == 0)
    return np.add.reduceat(parts, begins) / np.sqrt(np.diff(np.append(begins, len(parts)))) + bias


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def parts(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's words' parts in order."""
        words = [tokens(t) for t in texts]
        fresh = [t for t in set(chain.from_iterable(words)) if t not in self.young]
        todo = []
        for t in fresh:
            if (x := self.old.get(t)) is not None:
                self.young[t] = x
            else:
                todo.append(t)
        for t, x in zip(todo, self.model.parts([letters(t) for t in todo]).tolist(), strict=True):
            self.young[t] = x + _END if t[-1] in STOPS else x
        get = self.young.__getitem__
        out = [np.array(list(map(get, own))) for own in words]
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        return out

    def top(self, texts: list[str]) -> np.ndarray:
        """The two highest sentence margins and the two highest word margins of each text."""
        bias = self.model.bias
        out = np.full((len(texts), 4), bias)
        for i, own in enumerate(self.parts(texts)):
            if len(own):
                for k, x in ((0, sentence_margins(own, bias)), (2, np.where(own > _END / 2, own - _END, own) + bias)):
                    out[i, k] = x.max()
                    out[i, k + 1] = np.partition(x, len(x) - 2)[-2] if len(x) > 1 else bias
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for squared hinge loss; y in -1, 1; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None]
        step = np.linalg.solve(a.T @ x[active] + np.diag(penalty), a.T @ y[active])
        if np.abs(step - w).max() < 1e-8:
            break
        w = step
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps; a toxic text weighs `TOXIC_WEIGHT` clean ones."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-4])
    weight = np.where(y == 1, TOXIC_WEIGHT, 1.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _grams(word: str) -> set[str]:
    """Beginnings of a word, its letter trigrams, and the word."""
    whole = ANCHOR + word
    return {whole + END, *(whole[:k] for k in range(3, 9)), *(word[i : i + 3] for i in range(len(word) - 2))}


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence as the kernel sees them, cut as `sentence_margins` does."""
    out: list[list[str]] = [[]]
    for t in tokens(text):
        out[-1].append(letters(t))
        if t[-1] in STOPS or len(out[-1]) == LONG:
            out.append([])
    return [s for s in out if s]


def train(rows: list[tuple[int, str, int]]) -> Model:
    """From (id, text, toxic) rows."""
    rows = sorted((r[0], r[1] or "", int(r[2])) for r in rows)
    y = np.array([r[2] for r in rows])
    fold = np.array([int(hashlib.sha256(str(r[0]).encode()).hexdigest(), 16) % 3 for r in rows])
    fit = fold > 0
    if not (y[fit] == 1).any() or not (y[fit] == 0).any():
        return Model(np.zeros(LETTERS**3), 0.0, np.array([0.0, 0.0, 0.0, 0.0, -30.0]))
    cut = [sentences(r[1]) if used else [] for r, used in zip(rows, fit, strict=True)]
    words = [sorted({w for s in own for w in s if 2 < len(w) <= 2 * LONGEST}) for own in cut]
    seen = [Counter(), Counter()]
    for own, label in zip(words, y, strict=True):
        seen[label].update({g for w in own for g in _grams(w)})
    n = [int((fit & (y == c)).sum()) for c in (0, 1)]
    odds = {g: np.log((k + 0.2) / (n[1] + 0.4)) - np.log((seen[0][g] + 0.2) / (n[0] + 0.4)) for g, k in seen[1].items()}
    strength = {g: seen[1][g] * o for g, o in odds.items() if o >= LEAST_ODDS and seen[1][g] > 1}
    known: dict[str, float] = {}

    def typical(word: str) -> float:
        if word not in known:
            common = seen[0][ANCHOR + word + END] > 0 and odds.get(ANCHOR + word + END, 0.0) < LEAST_ODDS
            known[word] = 0.0 if common else max((strength.get(g, 0.0) for g in _grams(word)), default=0.0)
        return known[word]

    toxic = [own for own, label in zip(cut, y, strict=True) if label and own]
    clean = [s for own, label in zip(cut, y, strict=True) if not label for s in own]
    if not toxic or not clean:
        return Model(np.zeros(LETTERS**3), 0.0, np.array([0.0, 0.0, 0.0, 0.0, -30.0]))
    rng = np.random.default_rng(11)
    innocent = {w for s in clean for w in s if typical(w) == 0.0}
    draw = lambda pool, most: [pool[i] for i in sorted(rng.choice(len(pool), min(most, len(pool)), replace=False).tolist())] if pool else []

    def insults(own: list[list[str]], part: Callable[[str], float]) -> list[str]:
        """The two words of a toxic text that speak most for it."""
        some = {w for s in own for w in s if 2 < len(w) <= 2 * LONGEST and typical(w) >= 2 * LEAST_ODDS}
        return sorted(some, key=lambda w: (-part(w), w))[:2]

    best = lambda own, score: max(own, key=lambda s: (sum(map(score, s)) / len(s) ** 0.5, s))
    positive = [best(own, typical) for own in toxic]
    alone = Counter(w for own in toxic for w in insults(own, typical))
    common = Counter(w for own, label in zip(words, y, strict=True) if not label for w in own)
    negative = draw(clean, NEGATIVES)
    plain = dict.fromkeys(draw(sorted(innocent & set(common)), NEGATIVES) + sorted(innocent & set(common), key=lambda w: (-common[w], w))[:1000])
    # Landmarks: the words most often typical of toxic texts, and words of clean ones.
    chosen = [w for w, _ in sorted(alone.items(), key=lambda x: (-x[1], x[0]))][: LANDMARKS * 2 // 3]
    others = sorted(plain)
    landmarks = chosen + others[:: max(1, len(others) // (LANDMARKS - len(chosen)))][: LANDMARKS - len(chosen)]
    codes, weights = _subsequences([(ANCHOR + w)[:LONGEST] for w in landmarks])
    held = np.unique(np.append(codes, 0))  # code 0 is none
    place = np.zeros(LETTERS**3, np.int32)
    place[held] = np.arange(len(held))
    phi = np.zeros((len(landmarks), len(held)), np.float32)
    np.add.at(phi, (np.arange(len(landmarks))[:, None], place[codes]), weights)
    phi[:, 0] = 0
    phi /= np.maximum(np.linalg.norm(phi, axis=1, keepdims=True), 1e-12)
    value, vector = np.linalg.eigh((phi @ phi.T).astype(float))
    ok = value > 1e-4 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])
    row_of: dict[str, int] = {}
    kernels = np.zeros((0, root.shape[1]), np.float32)

    def features(some: list[list[str]]) -> np.ndarray:
        """Nyström features of sentences, the constant last."""
        nonlocal kernels
        fresh = sorted({w for s in some for w in s if w not in row_of})
        if fresh:
            row_of.update({w: len(row_of) + i for i, w in enumerate(fresh)})
            kernels = np.concatenate([kernels, (_kernel(fresh, phi, place) @ root).astype(np.float32)])
        at = np.array([row_of[w] for s in some for w in s])
        sizes = np.array([len(s) for s in some])
        sums = np.add.reduceat(kernels[at], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
        return np.column_stack([sums, np.ones(len(some))]).astype(np.float64)

    model = Model(np.zeros(LETTERS**3), 0.0, np.zeros(5))
    for turn in range(ROUNDS):
        lone, free = sorted(alone), list(plain)
        x = features([*positive, *negative, *([w] for w in lone), *([w] for w in free)])
        label = np.array([1.0] * len(positive) + [-1.0] * len(negative) + [1.0] * len(lone) + [-1.0] * len(free))
        share = lambda values, total: np.maximum(np.array(values, float) * total / max(sum(values), 1), 0.2)
        weight = np.concatenate([share([1] * len(positive), SENTENCES), share([1] * len(negative), SENTENCES), share([alone[w] for w in lone], WORDS), share([common[w] for w in free], WORDS)])
        w = _svm(x, label, weight)
        table = np.zeros(LETTERS**3)
        table[held] = (root @ w[:-1]) @ phi
        model = Model(table, float(w[-1]), np.zeros(5))
        if turn == ROUNDS - 1:
            break
        every = sorted({x for own in toxic for s in own for x in s} | {x for s in clean for x in s})
        parts = dict(zip(every, model.parts(every).tolist(), strict=True))
        both = lambda w, parts=parts: parts[w] + np.tanh(typical(w) / 30)
        positive = [best(own, both) for own in toxic]
        for own in toxic:
            alone.update(insults(own, both)[:1])
        negative = draw(clean, NEGATIVES) + sorted(clean, key=lambda s: (-sum(map(parts.__getitem__, s)) / len(s) ** 0.5, s))[: NEGATIVES // 3]
        plain |= dict.fromkeys(sorted(innocent & set(common), key=lambda w: (-parts[w], w))[:1500])
        alone = Counter({w: k for w, k in alone.items() if w not in plain})
    left = ~fit if (y[~fit] == 1).any() and (y[~fit] == 0).any() else np.ones(len(y), bool)
    top = Scorer(model).top([r[1] for r, keep in zip(rows, left, strict=True) if keep])
    return Model(model.table, model.bias, _logistic(top, y[left]))


def held_out(doc_id):
    """Whether a row is in the fold that training never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(3))
    chosen = [marked.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(n) for c, n in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE))]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most TOXIC_SAMPLE + CLEAN_SAMPLE pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return train([(r.doc_id, r.text, r.toxic) for r in rows.toLocalIterator()])


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for each document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        if model.name not in _scorers:
            _scorers.clear()
            _scorers[model.name] = Scorer(model)
        scorer, text = _scorers[model.name], batch.column("text")
        top, group, size = [], [], 0
        for i in range(len(text)):
            group.append(text[i].as_py() or "")
            size += len(group[-1])
            if size > 1 << 21 or i == len(text) - 1:
                top.append(scorer.top(group))
                group, size = [], 0
        z = np.column_stack([np.concatenate(top), np.ones(len(text))]) @ model.logistic
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")
