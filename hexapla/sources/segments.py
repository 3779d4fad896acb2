"""A stored keyword index that grows by batches.

One table, partitioned by batch and kind, holds what each batch brought: postings, documents (a row for each field a document has), the
rows of older batches that it replaced or deleted, and the differences it makes to the field statistics, in parts that are summed up. Postings are grouped where
the texts are read: a row has a term and those of some thousand neighbouring texts that hold it, as arrays. Rows of one posting each are read as well. A batch is one write with
dynamic partition overwrite, so writing it again, after a failure, replaces it. A reader takes the postings without those replaced
since, and the sums of the differences. Batches of like size are merged into one: live rows move to the youngest
of them in one write, which leaves an empty row in the partitions of the others.

Defined results: rows without chunk_id are left out; of rows with the same chunk_id in a batch the one whose fields
sort last stays; a chunk_id loaded again replaces its document as a whole, and if no field has terms it is gone; ids that aren't there are deleted without effect.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hexapla.functions.lineage import cut
from hexapla.operators.blocks import coded, last_rows
from hexapla.operators.index import FIELDS, Field
from hexapla.operators.keyword import _SUMMED
from hexapla.operators.retrieve import BROADCAST_ROWS
from hexapla.sources.sinks import exists

KINDS = ("posting", "document", "replaced", "statistics")
_COLUMNS = ["chunk_id", "field", "term", "tf", "dl", "of", "ids", "tfs", "dls", "batch", "kind"]


def _schema(id_type: str) -> str:
    return f"chunk_id {id_type}, field string, term string, tf long, dl long, of int, ids array<{id_type}>, tfs array<int>, dls array<int>, batch int, kind string"


def _read(spark: SparkSession, path: str, id_type: str | None = None) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], _schema(id_type or "string"))
    id_type = id_type or spark.read.parquet(path).schema["chunk_id"].dataType.simpleString()
    return spark.read.schema(_schema(id_type)).parquet(path)


def _write(rows: DataFrame, path: str) -> None:
    """Sorted by term within files, so that row groups without a wanted term are skipped; AQE deals the rows out by size."""
    rows.hint("rebalance", "batch", "kind").sortWithinPartitions("batch", "kind", "field", "term").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "kind").parquet(path)


def _gone(table: DataFrame, group: list[int] | None = None) -> tuple[DataFrame, int]:
    """(chunk_id, batch) that later batches replaced, in `group` only if it is given; and their number, or one more than are broadcast. They are many only where much was loaded again."""
    gone = table.where((F.col("kind") == "replaced") & F.col("chunk_id").isNotNull()).select("chunk_id", F.col("of").alias("batch"))
    gone = gone.where(F.col("batch").isin(group)) if group is not None else gone
    return gone, gone.limit(BROADCAST_ROWS + 1).count()


def _live(table: DataFrame, kind: str) -> DataFrame:
    """Rows of a kind that no later batch replaced; of postings, one for each text."""
    rows = table.where((F.col("kind") == kind) & (F.col("chunk_id").isNotNull() | F.col("ids").isNotNull()))
    if kind == "posting":
        of = f"array<struct<chunk_id: {table.schema['chunk_id'].dataType.simpleString()}, tf: bigint, dl: bigint>>"
        each = F.when(F.col("ids").isNotNull(), F.arrays_zip("ids", "tfs", "dls").cast(of)).otherwise(F.array(F.struct("chunk_id", "tf", "dl")).cast(of))
        rows = rows.select("field", "term", "of", "batch", "kind", F.inline(each))
    gone, n = _gone(table)
    if n == 0:
        return rows
    return rows.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone, ["chunk_id", "batch"], "left_anti")


def _grouped(batches: Iterator[pa.RecordBatch], fields: tuple[Field, ...], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of the table, of postings, documents and a part of the statistics, for about _SUMMED words at a time."""
    kinds = {"chunk_id": id_type, "field": pa.string(), "term": pa.string(), "tf": pa.int64(), "dl": pa.int64(), "ids": pa.list_(id_type), "tfs": pa.list_(pa.int32()), "dls": pa.list_(pa.int32()), "kind": pa.string()}

    def made(n: int, columns: dict) -> pa.RecordBatch:
        known = {c: pa.repeat(pa.scalar(v, kinds[c]), n) if isinstance(v, str) else v for c, v in columns.items()}
        return pa.RecordBatch.from_arrays([known[c] if c in known else pa.nulls(n, kind) for c, kind in kinds.items()], list(kinds))

    for batch in batches:
        lengths = [pc.fill_null(pc.list_value_length(batch.column(f"w{i}")), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(fields))]
        work = np.concatenate([[0], np.cumsum(np.sum(lengths, axis=0))])
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(work, work[a] + _SUMMED, side="right")) - 1)
            rows = batch.slice(a, z - a)
            for i, f in enumerate(fields):
                dl = lengths[i][a:z]
                some = np.flatnonzero(dl)
                if not len(some):
                    continue
                yield made(len(some), {"kind": "document", "field": f.name, "chunk_id": rows["chunk_id"].take(pa.array(some)), "dl": pa.array(dl[some])})
                yield made(1, {"kind": "statistics", "field": f.name, "tf": pa.array([len(some)], pa.int64()), "dl": pa.array([int(dl.sum())], pa.int64())})
                terms, code = coded(rows[f"w{i}"].flatten(), bool(f.words))
                key, tf = np.unique((code * len(dl) + np.repeat(np.arange(len(dl)), dl))[code >= 0], return_counts=True)
                term, row = key // len(dl), key % len(dl)
                begin = np.flatnonzero(np.diff(term, prepend=-1))
                at = pa.array(np.append(begin, len(key)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, x) for x in (rows["chunk_id"].take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(dl[row], pa.int32()))]
                yield made(len(begin), {"kind": "posting", "field": f.name, "term": terms.take(pa.array(term[begin])), "ids": lists[0], "tfs": lists[1], "dls": lists[2]})
            a = z


def load(rows: DataFrame, path: str, batch: int, fields: Iterable[Field] = FIELDS) -> None:
    """Documents (chunk_id and the fields' columns) as batch number `batch`, greater than all before; the same number writes the same batch anew."""
    spark, fields = rows.sparkSession, tuple(fields)
    id_type = rows.schema["chunk_id"].dataType.simpleString()
    before = _read(spark, path, id_type).where(F.col("batch") < batch)
    one = last_rows(rows, list(dict.fromkeys(f.column for f in fields)))
    words = one.select("chunk_id", *[(f.words or f.analyzer)(F.col(f.column)).alias(f"w{i}") for i, f in enumerate(fields)])
    kind = to_arrow_type(rows.schema["chunk_id"].dataType)
    brought = words.mapInArrow(lambda batches: _grouped(batches, fields, kind), f"chunk_id {id_type}, field string, term string, tf long, dl long, ids array<{id_type}>, tfs array<int>, dls array<int>, kind string")
    _put(brought, cut(_live(before, "document").join(one.select("chunk_id").distinct(), "chunk_id", "left_semi")) if exists(spark, path) else before, path, batch)


def delete(ids: DataFrame, path: str, batch: int) -> None:
    """Documents whose chunk_id is in `ids` go, as batch number `batch`."""
    before = _read(ids.sparkSession, path).where(F.col("batch") < batch)
    old = cut(_live(before, "document").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    _put(None, old, path, batch)


def _put(brought: DataFrame | None, old: DataFrame, path: str, batch: int) -> None:
    """Writes what a batch brought, and that it replaced the documents `old`."""
    less = old.groupBy("field").agg((-F.count("*")).alias("tf"), (-F.sum("dl")).alias("dl"))
    parts = [
        *([] if brought is None else [brought]),
        old.select("chunk_id", F.col("batch").alias("of")).distinct().withColumn("kind", F.lit("replaced")),
        less.withColumn("kind", F.lit("statistics")),
        _empty(old.sparkSession, old, [(batch, kind) for kind in KINDS]).drop("batch"),  # what an earlier attempt wrote of any kind goes
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("batch", F.lit(batch))
    _write(_whole_rows(rows), path)


def _whole_rows(rows: DataFrame) -> DataFrame:
    """All columns of the table; those that no part has are null."""
    kinds = {"term": "string", "ids": f"array<{rows.schema['chunk_id'].dataType.simpleString()}>", "tfs": "array<int>", "dls": "array<int>"}
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _COLUMNS])


def _empty(spark: SparkSession, like: DataFrame, places: list[tuple[int, str]]) -> DataFrame:
    """A row without content for each (batch, kind)."""
    return spark.createDataFrame(places, "batch int, kind string").withColumn("chunk_id", F.lit(None).cast(like.schema["chunk_id"].dataType))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings: field, chunk_id, term, tf, dl; statistics: field, n, avgdl) of the documents that are live."""
    table = _read(spark, path)
    sums = table.where("kind = 'statistics' AND field IS NOT NULL").groupBy("field").agg(F.sum("tf").alias("n"), F.sum("dl").alias("length")).where("n > 0")
    return _live(table, "posting").select("field", "chunk_id", "term", "tf", "dl"), sums.select("field", "n", (F.col("length") / F.col("n")).alias("avgdl"))


def sizes(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(batch, documents it brought), live or not; a row for each batch."""
    table = _read(spark, path).where("kind = 'document' AND chunk_id IS NOT NULL")
    return [(r.batch, r.n) for r in table.groupBy("batch").agg(F.count_distinct("chunk_id").alias("n")).orderBy("batch").collect()]


def merge(spark: SparkSession, path: str, fan: int = 4) -> list[list[int]]:
    """Merges batches, `fan` or more of a size alike (within a factor of `fan`), as often as there are such; the groups merged. Each document is
    rewritten once for each factor of `fan` by which the index has grown."""
    done = []
    while True:
        tiers: dict[int, list[int]] = {}
        for batch, n in sizes(spark, path):
            tiers.setdefault(int(math.log(n, fan) + 1e-9), []).append(batch)
        group = next((own for _, own in sorted(tiers.items()) if len(own) >= fan), None)
        if group is None:
            return done
        merge_batches(spark, path, group)
        done.append(group)


def merge_batches(spark: SparkSession, path: str, group: list[int]) -> None:
    table, target = _read(spark, path), max(group)
    own = F.col("batch").isin(group)
    if _gone(table, group)[1]:
        live = _live(table, "posting").where(own).unionByName(_live(table, "document").where(own), allowMissingColumns=True)
    else:  # groups of postings stay as they are
        live = table.where(own & F.col("kind").isin("posting", "document") & (F.col("chunk_id").isNotNull() | F.col("ids").isNotNull()))
    hidden = table.where(own & (F.col("kind") == "replaced") & F.col("chunk_id").isNotNull() & ~F.col("of").isin(group))
    sums = table.where(own & (F.col("kind") == "statistics") & F.col("field").isNotNull()).groupBy("field").agg(F.sum("tf").alias("tf"), F.sum("dl").alias("dl")).withColumn("kind", F.lit("statistics"))
    empty = _empty(spark, table, [(b, kind) for b in group for kind in KINDS])
    moved = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [live.drop("batch"), hidden.drop("batch"), sums]).withColumn("batch", F.lit(target))
    rows = moved.unionByName(empty, allowMissingColumns=True)
    _write(cut(_whole_rows(rows)), path)


def vocabulary(postings: DataFrame) -> DataFrame:
    """(term, df, cf): texts that have a term, and how often it occurs."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
