"""Shared pieces of the training-data operators: lineage cuts, Arrow helpers, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hexapla.functions.lineage import cut


#: Keys with more than a HOT-th of all rows are joined by broadcast; there are fewer than HOT of them.
HOT = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls count as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def doc_groups(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `most` bytes, so that per-byte arrays stay small; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one stage's scratch arrays took would be held through all others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect what no plan refers to any more: Spark deletes shuffle files and checkpoints of past rounds only when their handles are collected, and
    a driver with memory to spare may not do so for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """A matrix as one binary value a row, without a copy for each."""
    matrix = np.ascontiguousarray(matrix)
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def matrix_of(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """What binary_rows made, from a column without nulls."""
    if not len(column):
        return np.zeros((0, width), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        give_back()

    return df.mapInArrow(run, schema)


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined to `keys`, one row for each key with the number `n` of its rows; `total` is the number of all rows.

    Fewer than `HOT` keys can hold more than total / HOT rows each: these are broadcast, so their rows stay where they are.
    The others are joined by a shuffle, in which no key has more rows than that. Both inputs are read twice: cut them first."""
    many = F.broadcast(keys.where(F.col("n") * HOT > total))
    few = keys.where(F.col("n") * HOT <= total)
    return rows.join(many, on).unionByName(rows.join(many.select(*on), on, "left_anti").join(few, on))


def connected_components(edges: DataFrame, tidy: bool = False) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long); component is its smallest reachable node.

    Alternates large-star and small-star steps until the edge set is a forest of stars. Only minima are
    aggregated, with map-side combine, and the joins that carry them back can be split when a node is hot;
    no task holds the neighbours of one node. The number of steps is about the square of the logarithm of the longest
    path, and there is no limit to it: every step but the last lowers some node's neighbour. Self-loops keep their node as a component of its own.
    `tidy`: the files of a round go with it (see let_go).
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = cut(pairs)
    nodes = pairs
    pairs = pairs.where("u <> v")
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        pairs = cut(small)
        if tidy:
            del both, low, large, small
            let_go(pairs.sparkSession)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    found = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    alone = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return alone.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
