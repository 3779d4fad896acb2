"""Embedding near-duplicates by collision-counting projections.

Two unit vectors whose cosine is at the threshold are one chord apart; on a random direction they differ by about
chord / sqrt(dimension), which two unrelated vectors seldom do on most of many directions. So vectors are projected on
`PROJECTIONS` fixed directions, each projection is sorted, every vector opens a window of `SIGMAS` such deviations
around its own value on each of them, and the collisions in these windows are counted per pair. Pairs whose count
reaches the minimum, calibrated on random pairs just at the threshold so that under `MISS` of them fall below, are
verified by their cosine in double precision. Below `PROJECTIONS` dimensions windows are a whole chord wide and all of
them must collide, which loses nothing.

Sorted lists are made for each label, and, where a label has so many vectors that fewer pairs meet that way, for each
cell of a grid on `depth` further directions. A grid with a random shift parts some linked pairs, so there are as many
lists, each with a grid of its own, as bring the chance that all of them part a pair at the threshold under `MISS`;
`plan` chooses the depth that ships and compares least for the number of vectors of the largest label, from pair
probabilities on the sphere. The work so grows like n to the power 1.2, not with the square. A cell of more than
`BLOCK` vectors is dealt into blocks that meet pairwise; these grow with the square of a group only where its vectors
are alike, as then its pairs are links, whose number the result has to state.

Blocks send back link counts of their vectors and a spanning forest, never pairs; a pair counts in the first list that
it shares. Identical vectors collapse first (with map-side combine) and count by their number.

Defined results: a vector that is null, of length 0 or norm 0, or holds null or non-finite components, or whose
label or vec_id is null, has no links and is its own component (null where vec_id is); vectors of different
dimensions aren't compared; repeated equal rows count once and each gets the result; an empty table gives an empty
one; a cosine just at the threshold counts; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hexapla.llm.common import connected_components, cut, map_arrow
from hexapla.llm.words import mix

MIN_COSINE, PROJECTIONS, SIGMAS, MISS = 0.93, 32, 1.5, 1e-7
TAIL = 5.2  # standard deviations below the mean that MISS is of a normal distribution; the true tail is shorter
BLOCK, GRID, DEEPEST = 2048, 5.0, 24  # GRID: width of a grid's cells in deviations of a pair at the threshold
_CELLS = 1 << 21  # counters at a time


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    """(dim, n) fixed unit directions, orthogonal as far as the dimension allows."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(max(1, -(-n // dim)))], axis=1)[:, :n]


@cache
def directions(dim: int) -> np.ndarray:
    return _directions(dim, PROJECTIONS, 20240229)


@cache
def chord(min_cosine: float) -> float:
    """The largest distance of two unit vectors that are linked, with room for rounding."""
    return math.sqrt(max(2 - 2 * min_cosine, 0.0)) * (1 + 1e-6) + 1e-7


@cache
def _coordinate(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Absolute values of a coordinate of a random unit vector, and their probabilities."""
    angle = (np.arange(20_000) + 0.5) * math.pi / 40_000
    p = np.sin(angle) ** max(dim - 2, 0)  # of the angle to a fixed direction
    return np.cos(angle), p / p.sum()


@cache
def calibration(dim: int, min_cosine: float) -> tuple[float, int]:
    """Window half-width, and the number of collisions that a pair needs."""
    if dim < PROJECTIONS:
        return chord(min_cosine), PROJECTIONS
    # The difference of such a pair has a random direction: how many of its coordinates on the projections are in the window?
    width = SIGMAS / math.sqrt(dim)
    counts = []
    rng = np.random.default_rng(20240301)
    for _ in range(50):
        v = rng.standard_normal((2000, dim))
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        counts.append((np.abs(v[:, :PROJECTIONS]) <= width).sum(axis=1))
    count = np.concatenate(counts)
    return width * chord(min_cosine), int(count.mean() - TAIL * count.std())


@cache
def plan(dim: int, n: int, min_cosine: float) -> tuple[int, int]:
    """(depth, lists) for labels of up to n vectors."""
    x, p = _coordinate(dim)
    width = GRID * chord(min_cosine) / math.sqrt(dim)
    near = float((p * np.maximum(0.0, 1 - x * chord(min_cosine) / width)).sum())
    far = float((p * np.maximum(0.0, 1 - x * math.sqrt(2) / width)).sum())  # unrelated vectors are sqrt(2) apart
    best = (math.inf, 0, 1)
    for depth in range(DEEPEST + 1):
        lists = math.ceil(math.log(MISS) / math.log1p(-(near**depth))) if depth else 1
        best = min(best, (lists * max(1.0, n * far**depth / BLOCK), depth, lists))
    return best[1:]


@cache
def _grids(dim: int, depth: int, lists: int, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions over the cell width, and shifts, of all lists' grids."""
    width = GRID * chord(min_cosine) / math.sqrt(dim)
    return _directions(dim, depth * lists, 7) / width, np.random.default_rng(8).random(depth * lists)


def cells(units: np.ndarray, n: int, min_cosine: float) -> np.ndarray:
    """(vectors, lists): the number of each vector's cell in every list."""
    dim = units.shape[1]
    depth, lists = plan(dim, n, min_cosine)
    if not depth:
        return np.zeros((len(units), 1), np.int64)
    way, shift = _grids(dim, depth, lists, min_cosine)
    at = np.floor(units @ way + shift).astype(np.int64).view(np.uint64).reshape(len(units), lists, depth)
    out = np.zeros((len(units), lists), np.uint64)
    for k in range(depth):  # cells whose numbers happen to agree are one cell: more is compared, nothing less
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + at[:, :, k])
    return out.view(np.int64)


def _units(flat: np.ndarray, dim: int) -> np.ndarray:
    v = flat.reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def items(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, fp, vec: binary of doubles) of the vectors that can have links."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        columns: list[list] = [[] for _ in range(5)]
        for vec_id, label, values in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True):
            if not values or None in values:
                continue
            v = np.array(values, np.float64)
            if not np.isfinite(v).all() or not v.any():
                continue
            raw = v.tobytes()
            for c, x in zip(columns, (vec_id, label, len(v), hashlib.blake2b(raw, digest_size=16).digest(), raw), strict=True):
                c.append(x)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["vec_id", "label", "dim", "fp", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return map_arrow(rows, run, "vec_id long, label long, dim int, fp binary, vec binary")


def blocks(groups: DataFrame, largest: int, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Each distinct vector (label, dim, rep, n, vec) once for every block (list, cell, x, y) that it is in, and its chunk."""

    def place(batch: pa.RecordBatch) -> pa.Table:
        dims = batch.column("dim").to_numpy()
        parts = []
        for dim in np.unique(dims).tolist():
            rows = pa.Table.from_batches([batch]).take(pa.array(np.flatnonzero(dims == dim)))
            at = cells(_units(np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64), dim), largest, min_cosine)
            parts.append(rows.append_column("cells", pa.array(list(at), pa.list_(pa.int64()))))
        return pa.concat_tables(parts)

    placed = map_arrow(groups.select("label", "dim", "rep", "n", "vec"), place, "label long, dim int, rep long, n long, vec binary, cells array<long>")
    cell = ["label", "dim", "list", "cell"]
    listed = placed.select("label", "dim", "rep", "n", "vec", F.posexplode("cells").alias("list", "cell"))
    sizes = listed.groupBy(*cell).agg(F.count("*").alias("m")).where("m > 1").select(*cell, F.ceil(F.col("m") / BLOCK).cast("int").alias("chunks"))
    dealt = listed.join(sizes, cell).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return met.select(*cell, F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "rep", "n", "vec")


def collisions(ua: np.ndarray, ub: np.ndarray, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose projections collide often enough, for a range of rows of `ua` at a time."""
    dim = ua.shape[1]
    width, least = calibration(dim, min_cosine)
    values, asking = (ub @ directions(dim)).T, (ua @ directions(dim)).T
    order = np.argsort(values, axis=1, kind="stable")
    windows = []
    for v, q, by in zip(values, asking, order, strict=True):
        v = v[by]
        windows.append((np.searchsorted(v, q - width - 1e-9), np.searchsorted(v, q + width + 1e-9, side="right")))
    step = max(1, _CELLS // len(ub))
    for a in range(0, len(ua), step):
        rows = min(step, len(ua) - a)
        count = np.zeros(rows * len(ub), np.uint8)
        for by, (lo, hi) in zip(order, windows, strict=True):
            lo, held = lo[a : a + rows], (hi - lo)[a : a + rows]
            # Entries of all windows, one window after the other; none twice on one projection.
            at = np.arange(int(held.sum())) + np.repeat(lo - (np.cumsum(held) - held), held)
            count[by[at] + np.repeat(np.arange(rows) * len(ub), held)] += 1
        i, j = np.divmod(np.flatnonzero(count >= least), len(ub))
        yield i + a, j


def _linked(ua: np.ndarray, ub: np.ndarray, same: bool, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked vectors; in a block with itself each pair once, smaller index first."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in collisions(ua, ub, min_cosine):
        if same:
            once = i < j
            i, j = i[once], j[once]
        for s in range(0, len(i), 1 << 16):
            x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            good = np.einsum("ij,ij->i", ua[x], ub[y]) >= min_cosine
            left.append(x[good])
            right.append(y[good])
    return np.concatenate(left), np.concatenate(right)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest index reachable over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def compare(met: DataFrame, largest: int, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(u, v, n): u has n links (v null), or u and v are connected (n = 0)."""

    def run(group: pa.Table) -> pa.Table:
        rep, number, chunk = (group.column(c).to_numpy() for c in ("rep", "n", "chunk"))
        dim, nth, x, y = (group.column(c)[0].as_py() for c in ("dim", "list", "x", "y"))
        unit = _units(np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float64), dim)
        first, second = np.flatnonzero(chunk == x), np.flatnonzero(chunk == y)
        i, j = _linked(unit[first], unit[second], x == y, min_cosine)
        i, j = first[i], second[j]
        if nth and len(i):  # those that share an earlier list's cell are counted there
            at = cells(unit, largest, min_cosine)[:, :nth]
            fresh = np.concatenate([~(at[i[s : s + 4096]] == at[j[s : s + 4096]]).any(axis=1) for s in range(0, len(i), 4096)])
            i, j = i[fresh], j[fresh]
        total = (np.bincount(i, number[j], len(rep)) + np.bincount(j, number[i], len(rep))).astype(np.int64)
        held = np.flatnonzero(total)
        root = _forest(i, j, len(rep))
        tied = np.flatnonzero(root != np.arange(len(rep)))
        u, n = np.concatenate([rep[held], rep[tied]]), np.concatenate([total[held], np.zeros(len(tied), np.int64)])
        return pa.table({"u": u, "v": pa.array(np.concatenate([rep[held], rep[root[tied]]]), mask=n > 0), "n": n})

    return met.groupBy("label", "dim", "list", "cell", "x", "y").applyInArrow(run, "u long, v long, n long")


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The contract's row for each vector: vec_id, n_links, component_id, kept."""
    whole = vectors.select("vec_id", "label", "embedding")
    own = cut(items(whole).dropDuplicates(["vec_id", "label", "dim", "fp"]))
    groups = cut(own.groupBy("label", "dim", "fp").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")))
    largest = groups.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    found = cut(compare(blocks(groups, largest, min_cosine), largest, min_cosine))
    links = found.where("n > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("far"))
    members = own.select("vec_id", "label", "dim", "fp").join(groups.select("label", "dim", "fp", "rep", "n"), ["label", "dim", "fp"]).select("vec_id", "rep", "n")
    near = members.join(links, "rep", "left").groupBy("vec_id").agg(F.sum(F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    edges = found.where("n = 0").select("u", "v").unionByName(members.where("vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v")))
    parts = connected_components(edges).select(F.col("node").alias("vec_id"), "component")
    out = whole.select(F.col("vec_id").cast("long").alias("vec_id")).join(near, "vec_id", "left").join(parts, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}
), reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a
), least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id)
"""
