"""Vector index of cells: points by their nearest centroid, searched with bounds.

Centroids come from spherical k-means over a sample of bounded size; every point is stored in the cell of its nearest centroid, one
partition of the table for each cell, with its distance from the centroid. A search probes each query's nearest cells first. By
the triangle inequality no point of a cell is nearer to a query than their distance less the cell's radius, so the exact
search then reads only the cells that could still hold a better row than the k-th found, and a search that is to be quick stops after the probes. How
many probes that takes is calibrated when the index is written: some of its points are searched exactly, and the cells of what they find say how many of the
nearest cells hold the wanted share. Only the cells that some query of a block asks for are read, and in a cell only its own queries are compared.

Vectors that are zero, or not of the index's length, stand in a cell of their own that every search reads; null and non-finite ones meet nothing. Below
`LEAST` points there is one cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hexapla.config import DEFAULTS, Settings
from hexapla.functions.lineage import cut
from hexapla.operators.retrieve import DIGITS, ranked
from hexapla.sources.sinks import exists, replace_table

#: Points below which one cell holds all; cells at most; points that centroids are fitted on at most, in so many rounds.
LEAST, MOST_CELLS, SAMPLE, ROUNDS = 10_000, 4096, 200_000, 8
#: Points that the number of probes is calibrated with, and the share of true neighbours that the probed cells are to hold.
TRIED, TARGET = 256, 0.95
ASIDE = -1
#: Cells that the exact search probes before it has a bound.
EAGER = 4
_STEP = 4096  # rows of a matrix product


def _matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows with finite numbers only, their length each); others count as length -1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False).astype(np.float64))
    of = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    sizes[np.unique(of[bad])] = -1
    return sizes, of


def _take(column: pa.ChunkedArray | pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    part = column.take(pa.array(rows))
    part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def _nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance) of unit vectors, a bounded number of rows at a time."""
    cells, far = np.zeros(len(v), np.int32), np.zeros(len(v))
    for a in range(0, len(v), _STEP):
        cos = v[a : a + _STEP] @ centroids.T
        cells[a : a + _STEP] = cos.argmax(axis=1)
        far[a : a + _STEP] = np.sqrt(np.maximum(2 - 2 * cos.max(axis=1), 0))
    return cells, far


def fit(points: DataFrame, n_cells: int, rounds: int = ROUNDS, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids (at most n_cells, ordered as they began) of the points' directions. The points with the smallest hashes are the sample, the first of them the
    first centroids; each round is one pass over the sample in its partitions, which sends a sum for each cell."""
    spark = points.sparkSession
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    dims = points.where(usable).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return np.zeros((0, 0))
    dim, total = dims["d"], dims["count"]
    place = F.xxhash64(F.col("chunk_id").cast("string"))
    own = points.where(usable & (F.size("vector") == dim)).select("vector", place.alias("place"))
    if total > sample:  # hashes are spread evenly over their range, so their order needs no sort of all
        edge = -(2**63) + int(2**64 * min(1.0, 1.1 * sample / total))
        own = own.where(F.col("place") < F.lit(min(edge, 2**63 - 1)))
    own = cut(own)
    start = own.dropDuplicates(["vector"]).orderBy("place").limit(n_cells).collect()  # n_cells rows
    centroids = _unit(np.array([r.vector for r in start], np.float64))

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(shared.value)
            for batch in batches:
                if batch.num_rows:
                    v = _unit(_take(batch["vector"], np.arange(batch.num_rows), total.shape[1]))
                    np.add.at(total, _nearest(v, shared.value)[0], v)
            hit = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(list(total[hit]), pa.list_(pa.float64()))], ["cell", "total"])

        def add(table: pa.Table) -> pa.Table:
            return pa.table({"cell": table["cell"][:1], "total": pa.array([_take(table["total"], np.arange(table.num_rows), len(table["total"][0])).sum(axis=0)], pa.list_(pa.float64()))})

        for r in own.mapInArrow(sums, "cell int, total array<double>").groupBy("cell").applyInArrow(add, "cell int, total array<double>").collect():  # a row a cell
            if (v := np.array(r.total)).any():
                centroids[r.cell] = v / np.sqrt((v * v).sum())
    return centroids


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The points, all columns, with `cell` and `residual` (distance of its direction from the centroid)."""
    from pyspark.sql import types as T

    shared = points.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("residual", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            cells, far = np.full(batch.num_rows, ASIDE, np.int32), np.zeros(batch.num_rows)
            sizes, _ = _matrix(batch["vector"])
            if len(c) and len(own := np.flatnonzero(sizes == c.shape[1])):
                v = _take(batch["vector"], own, c.shape[1])
                own, v = own[v.any(axis=1)], v[v.any(axis=1)]
                if len(own):
                    cells[own], far[own] = _nearest(_unit(v), c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(far)], [*batch.schema.names, "cell", "residual"])

    return points.mapInArrow(run, schema)


def write(points: DataFrame, path: str, n_cells: int | None = None, least: int = LEAST, k: int = DEFAULTS.dense_k, target: float = TARGET) -> None:
    """A new index of `points` (chunk_id, vector, payload); by default about the square root of their number of cells. The probes
    are calibrated for k rows a query."""
    n = points.count()
    n_cells = n_cells or (1 if n < least else min(MOST_CELLS, round(n**0.5)))
    centroids = fit(points, n_cells)
    replace_table(points.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1), f"{path}/centroids")
    mark = points.sparkSession.createDataFrame([(ASIDE,)], "cell int")  # a row without id, so that an empty table has its columns
    rows = assign(points, centroids).unionByName(mark, allowMissingColumns=True)
    replace_table(rows.hint("rebalance", "cell").sortWithinPartitions("cell", "residual"), f"{path}/points", partition_by=["cell"])
    probes = calibrate(points.sparkSession, path, k, target) if len(centroids) > 1 else 1
    replace_table(points.sparkSession.createDataFrame([(k, target, probes)], "k int, target double, probes int"), f"{path}/probes")


def calibrate(spark: SparkSession, path: str, k: int, target: float, tried: int = TRIED) -> int:
    """The number of nearest cells that hold `target` of the k best rows of some points (those with the smallest hashes), which are searched exactly."""
    points, centroids = read(spark, path), _centroids(spark, path)
    place = F.xxhash64(F.col("chunk_id").cast("string"), F.lit(1))
    some = cut(points.where(F.col("cell") != ASIDE).select(F.col("chunk_id").alias("query_id"), "vector").orderBy(place).limit(tried))
    found = search(spark, path, some, k, probes=len(centroids))[0].join(points.select("chunk_id", "cell"), "chunk_id")
    cells = {r.query_id: r.n for r in found.groupBy("query_id", "cell").count().groupBy("query_id").agg(F.collect_list(F.struct("cell", "count")).alias("n")).collect()}  # TRIED rows
    held = np.zeros(len(centroids))
    for r in some.collect():
        order = np.argsort(2 - 2 * (_unit(np.array([r.vector], np.float64)) @ centroids.T)[0], kind="stable")
        rank = np.argsort(order)
        for x in cells.get(r.query_id, []):
            if x.cell != ASIDE:
                held[rank[x.cell]] += x["count"]
    share = np.cumsum(held) / max(held.sum(), 1)
    return int(np.searchsorted(share, min(target, share[-1]))) + 1


def upsert(points: DataFrame, path: str) -> None:
    """Points given anew replace those of the same chunk_id; only the cells that lose or gain a point are written again."""
    spark = points.sparkSession
    new = cut(assign(points, _centroids(spark, path)).dropDuplicates(["chunk_id"]))
    there = read(spark, path)
    lost = there.join(new.select("chunk_id"), "chunk_id", "left_semi").select("cell")
    touched = [r.cell for r in lost.unionByName(new.select("cell")).distinct().collect()]  # at most the number of cells
    stay = there.where(F.col("cell").isin(touched)).join(new.select("chunk_id"), "chunk_id", "left_anti")
    # A row without id in each cell, so that one that lost all its points is written too.
    marks = spark.createDataFrame([(c,) for c in touched], "cell int")
    rows = cut(stay.unionByName(new, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True))
    rows.hint("rebalance", "cell").sortWithinPartitions("cell", "residual").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{path}/points")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/points").where("chunk_id IS NOT NULL")


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect() if exists(spark, f"{path}/centroids") else []
    return np.array([r.centroid for r in rows], np.float64) if rows else np.zeros((0, 0))


@dataclass
class _Block:
    """Queries of a block by length of their vectors: ids, vectors, norms."""

    lengths: dict[int, tuple[list, np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list) -> _Block:
        lengths: dict[int, tuple[list, list]] = {}
        for r in rows:
            if r.vector and None not in r.vector and np.isfinite(r.vector).all():
                ids, vectors = lengths.setdefault(len(r.vector), ([], []))
                ids.append(r.query_id)
                vectors.append(r.vector)
        return _Block({d: (ids, v := np.array(vectors, np.float64), np.sqrt((v * v).sum(axis=1))) for d, (ids, vectors) in lengths.items()})


def _scan(points: DataFrame, queries: DataFrame, block: _Block, asked: dict[int, np.ndarray], dim: int, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the best k, and rows that equal the k-th, of each Arrow batch and cell for the queries that ask for it."""
    spark, kind = points.sparkSession, to_arrow_type(queries.schema["query_id"].dataType)
    shared = spark.sparkContext.broadcast((block.lengths, asked))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {points.schema['chunk_id'].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, asked = shared.value
        for batch in batches:
            sizes, _ = _matrix(batch["vector"])
            cells = batch["cell"].to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                for d, (ids, matrix, norms) in lengths.items():
                    rows = np.flatnonzero((cells == cell) & (sizes == d))
                    of = np.arange(len(ids)) if cell == ASIDE else asked.get(int(cell), np.zeros(0, int)) if d == dim else np.zeros(0, int)
                    if len(rows) and len(of):
                        v = _take(batch["vector"], rows, d)
                        length = np.sqrt((v * v).sum(axis=1))
                        cos = np.round(v @ matrix[of].T / np.maximum(length[:, None] * norms[of][None, :], 1e-300), DIGITS)
                        edge = np.partition(cos, len(rows) - k, axis=0)[len(rows) - k] if len(rows) > k else np.full(len(of), -np.inf)
                        at, q = np.nonzero(cos >= edge)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[of[j]] for j in q], kind), batch["chunk_id"].take(pa.array(rows[at])), pa.array(cos[at, q])], ["query_id", "chunk_id", "score"])

    wanted = sorted({*asked, ASIDE})
    return points.where(F.col("cell").isin(wanted)).select("chunk_id", "vector", "cell").mapInArrow(run, schema)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = DEFAULTS.dense_k, probes: int | None = None, exact: bool = True, where: Column | None = None, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """((query_id, chunk_id, score, rank), report: query_id, n_cells, cells_read, n_points, points_read) for queries (query_id, vector).

    Exact: the rows, scores and ranks of the search over all points. Otherwise only each query's `probes` nearest cells (as calibrated, if not given) are read, and more until they
    hold k points; the exact search begins with EAGER. `where` is a filter of points. The table of cells is read once; queries are taken in blocks of bounded size."""
    points, centroids = read(spark, path), _centroids(spark, path)
    probes = probes or (EAGER if exact else spark.read.parquet(f"{path}/probes").first().probes)
    known = points.groupBy("cell").agg(F.count("*").alias("n"), F.min("residual").alias("near"), F.max("residual").alias("far")).collect()  # a row a cell
    dim, total = (centroids.shape[1] if len(centroids) else 0), sum(r.n for r in known)
    size, near, far = (np.zeros(len(centroids)) for _ in range(3))
    for r in known:
        if r.cell != ASIDE:
            size[r.cell], near[r.cell], far[r.cell] = r.n, r.near, r.far
    aside = total - int(size.sum())
    points = points if where is None else points.where(where)
    n = -(-queries.count() // settings.query_block) or 1
    hits, reports = None, []
    for b in range(n):
        block = _Block.of(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).select("query_id", "vector").collect())
        ids, matrix, norms = block.lengths.get(dim, ([], np.zeros((0, dim)), np.zeros(0)))
        away = np.sqrt(np.maximum(2 - 2 * _unit(matrix) @ centroids.T, 0)) if len(ids) and dim else np.zeros((len(ids), len(centroids)))
        away[norms == 0] = 0
        first = np.zeros(away.shape, bool)
        for q, order in enumerate(np.argsort(away, axis=1, kind="stable")):
            order = order[size[order] > 0]
            enough = max(probes, int(np.searchsorted(np.cumsum(size[order]), k)) + 1)
            first[q, order[:enough]] = True
        read_cells = first.copy()
        found = cut(_scan(points, queries, block, _by_cell(first), dim, k))
        if exact and len(ids):
            least = ranked(found, k, "score").groupBy("query_id").agg(F.min("score").alias("edge"), F.count("*").alias("n")).where(F.col("n") >= k)
            edge = {r.query_id: r.edge for r in least.collect()}  # a row for each query of the block
            nearest = np.maximum(np.maximum(away - far[None, :], near[None, :] - away), 0)
            best = 1 - nearest**2 / 2 + 10.0**-DIGITS  # no row of the cell scores more, after rounding
            best[norms == 0] = 1
            more = (best >= np.array([edge.get(i, -2.0) for i in ids])[:, None]) & ~first & (size > 0)[None, :]
            read_cells |= more
            if more.any():
                found = found.unionByName(_scan(points.where(F.col("cell") != ASIDE), queries, block, _by_cell(more), dim, k))
        hits = found if hits is None else hits.unionByName(found)
        reports += [(i, len(centroids), int(read_cells[q].sum()), total, int(size[read_cells[q]].sum()) + aside) for q, i in enumerate(ids)]
    kind = queries.schema["query_id"].dataType.simpleString()
    report = spark.createDataFrame(reports, f"query_id {kind}, n_cells int, cells_read int, n_points long, points_read long")
    return ranked(hits, k, "score"), report


def _by_cell(mask: np.ndarray) -> dict[int, np.ndarray]:
    """Which queries ask for each cell that some do."""
    return {int(c): np.flatnonzero(mask[:, c]) for c in np.flatnonzero(mask.any(axis=0))}


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (recall): the share of the exact rows that were found."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))
