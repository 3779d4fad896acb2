"""Filtered vector top-k, BM25 top-k, fusion and pools, for whole batches of queries.

Ids travel; payload is joined last. Scores are rounded before they rank, and ties end by id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hexapla.config import DEFAULTS, Settings
from hexapla.functions.lineage import cut
from hexapla.operators.index import BUCKETS, FIELDS, Field

DIGITS = 6


def facets(languages: list[str] | None = None, traditions: list[str] | None = None, date_from: int | None = None, date_to: int | None = None) -> Column | None:
    """Conjunction of the filters that are given; both kinds of lists and open ranges reach the scan."""
    parts = []
    if languages:
        parts.append(F.col("language").isin(languages))
    if traditions:
        parts.append(F.col("tradition").isin(traditions))
    if date_from is not None:
        parts.append(F.col("date_approx") >= date_from)
    if date_to is not None:
        parts.append(F.col("date_approx") <= date_to)
    return reduce(lambda a, b: a & b, parts) if parts else None


def ranked(df: DataFrame, k: int, score: str, by: tuple[str, ...] = ("query_id",), rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), "chunk_id")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


#: Columns of queries that are filters of their own: one tradition, and bounds of date_approx, null where there is none.
OWN = ("only", "date_from", "date_to")


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int = DEFAULTS.dense_k, per: str | None = None, settings: Settings = DEFAULTS, own: bool = False) -> DataFrame:
    """(query_id, [per,] chunk_id, score, rank): exact cosine over every row of `corpus` (chunk_id, vector).

    With `own`, each query also has the filters OWN, which are held against the rows' tradition and date_approx beside the products: one scan for
    all filters. What all queries of a block rule out isn't read.

    Queries are taken in blocks of bounded size and broadcast; each Arrow batch is one matrix product and sends on
    at most k rows for each query (and value of `per`), so the shuffle carries candidates only. Vectors meet those of their
    own length; one that is null, empty, or holds nulls or non-finite numbers, on either side, meets none. A zero vector scores 0.
    """
    spark = corpus.sparkSession
    n = -(-queries.count() // settings.query_block) or 1
    cols = list(dict.fromkeys(["chunk_id", "vector", *([per] if per else []), *(["tradition", "date_approx"] if own else [])]))
    group_type = corpus.schema[per].dataType.simpleString() if per else "string"
    id_type, query_type = corpus.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    schema = f"query_id {query_type}, chunk_id {id_type}, score double" + (f", grp {group_type}" if per else "")
    out = None
    for block in range(n):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block).select("query_id", "vector", *(OWN if own else ())).collect()
        lengths: dict[int, tuple[list, list, list]] = {}
        for r in mine:
            if r.vector and None not in r.vector and np.isfinite(r.vector).all():
                ids, vectors, filters = lengths.setdefault(len(r.vector), ([], [], []))
                ids.append(r.query_id)
                vectors.append(r.vector)
                filters.append(tuple(r[2:]))
        asked = {d: (ids, v := np.array(vectors, np.float64), np.sqrt((v * v).sum(axis=1)), filters) for d, (ids, vectors, filters) in lengths.items()}
        shared = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.Table]:
            for batch in batches:
                sizes = pa.compute.fill_null(pa.compute.list_value_length(batch["vector"]), 0).to_numpy(zero_copy_only=False)
                for dim, (ids, matrix, norms, filters) in shared.value.items():
                    table = pa.Table.from_batches([batch]).take(pa.array(np.flatnonzero(sizes == dim)))
                    if table.num_rows:
                        v = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                        good = np.flatnonzero(np.isfinite(v).all(axis=1))
                        if len(good):
                            yield from best(table.take(pa.array(good)), v[good], ids, matrix, norms, filters).to_batches()

        def best(table: pa.Table, v: np.ndarray, ids: list, matrix: np.ndarray, norms: np.ndarray, filters: list) -> pa.Table:
            length = np.sqrt((v * v).sum(axis=1))
            cosine = np.round(v @ matrix.T / np.maximum(length[:, None] * norms[None, :], 1e-300), DIGITS)
            groups = np.array(table[per].to_pylist(), object) if per else np.zeros(table.num_rows, int)
            rows, qs = [], []
            ok = allowed(table, filters) if own else None
            for g in sorted(set(groups.tolist()), key=str):
                in_group = np.flatnonzero(groups == g)
                for q in range(len(ids)):
                    at = in_group if ok is None else in_group[ok[in_group, q]]
                    c = cosine[at, q]
                    # All ties of the k-th stay; the window settles them.
                    rows.append(at[c >= np.partition(c, len(c) - k)[len(c) - k]] if len(at) > k else at)
                    qs.append(np.full(len(rows[-1]), q))
            rows, qs = np.concatenate(rows), np.concatenate(qs)
            out = {"query_id": pa.array([ids[q] for q in qs], kind), "chunk_id": table["chunk_id"].take(pa.array(rows)), "score": pa.array(cosine[rows, qs])}
            return pa.table(out | ({"grp": table[per].take(pa.array(rows))} if per else {}))

        part = corpus.where(_some([f for _, _, _, filters in asked.values() for f in filters] if own else []) & F.col("vector").isNotNull()).select(*cols).mapInArrow(run, schema) if asked else spark.createDataFrame([], schema)
        out = part if out is None else out.unionByName(part)
    if per:
        out = out.withColumnRenamed("grp", per)
    return ranked(out, k, "score", ("query_id", per) if per else ("query_id",))


def allowed(table: pa.Table, filters: list[tuple]) -> np.ndarray:
    """Rows x queries: which rows each query's filters let through; a null passes no filter on it."""
    tradition = np.array(table["tradition"].to_pylist(), object)
    date = np.array([np.nan if d is None else d for d in table["date_approx"].to_pylist()], np.float64)
    out = np.ones((table.num_rows, len(filters)), bool)
    for f in set(filters):
        only, first, last = f
        ok = np.ones(table.num_rows, bool) if only is None else tradition == only
        if first is not None:
            ok &= date >= first
        if last is not None:
            ok &= date <= last
        out[:, [q for q, x in enumerate(filters) if x == f]] = ok[:, None]
    return out


def _some(filters: list[tuple]) -> Column:
    """What at least one of the queries may let through, as the scan can use it."""
    out = F.lit(True)
    traditions, first, last = ([f[i] for f in filters] for i in range(3))
    if filters and None not in traditions:
        out &= F.col("tradition").isin(sorted(set(traditions)))
    if filters and None not in first:
        out &= F.col("date_approx") >= min(first)
    if filters and None not in last:
        out &= F.col("date_approx") <= max(last)
    return out


def dense_and_floors(corpus: DataFrame, queries: DataFrame, per: str, settings: Settings = DEFAULTS, own: bool = False) -> tuple[DataFrame, DataFrame]:
    """Top-k of all rows and of each value of `per`, from one scan: the best of all are among the best of each."""
    each = cut(dense_topk(corpus, queries, max(settings.dense_k, settings.floor_pool), per, settings, own))
    return ranked(each.drop("rank"), settings.dense_k, "score").drop(per), each.where(F.col("rank") <= settings.floor_pool)


def bm25_scores(postings: DataFrame, stats: DataFrame, terms: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, field, chunk_id, score): `terms` (query_id, term) met with postings; document frequencies are
    counted for the queries' terms alone, and the few statistics rows and terms are small by nature."""
    wanted = terms.select("term").distinct()
    on = ["term"]
    if "bucket" in postings.columns:  # a stored index: other buckets aren't read
        wanted, on = wanted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")), ["term", "bucket"]
    own = postings.join(wanted, on, "left_semi")
    df = own.groupBy("field", "term").agg(F.count("*").alias("df"))
    met = own.join(df, ["field", "term"]).join(stats, "field").join(terms, "term")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") / (F.col("tf") + settings.bm25_k1 * (1 - settings.bm25_b + settings.bm25_b * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", "field", "chunk_id").agg(F.sum(idf * weight).alias("raw")).select("query_id", "field", "chunk_id", F.round("raw", DIGITS).alias("score"))


def best_field(scores: DataFrame, settings: Settings = DEFAULTS, fields: Iterable[Field] = FIELDS) -> DataFrame:
    """The largest boosted field score of each text."""
    boost = F.create_map(*[F.lit(x) for f in fields for x in (f.name, f.boost)])
    boosted = F.round(F.coalesce(boost[F.col("field")], F.lit(1.0)) * F.col("score"), DIGITS)
    return scores.groupBy("query_id", "chunk_id").agg(F.max(boosted).alias("score"))


def fuse(dense: DataFrame, sparse: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, chunk_id, rrf, d_rank, s_rank, pos): reciprocal ranks added up; ties keep dense before sparse order."""
    both = dense.select("query_id", "chunk_id", F.col("rank").alias("d_rank"), F.lit(None).cast("int").alias("s_rank")).unionByName(sparse.select("query_id", "chunk_id", F.lit(None).cast("int").alias("d_rank"), F.col("rank").alias("s_rank")))
    term = lambda c: F.coalesce(1.0 / (settings.rrf_k + F.col(c)), F.lit(0.0))
    one = both.groupBy("query_id", "chunk_id").agg(F.max("d_rank").alias("d_rank"), F.max("s_rank").alias("s_rank"))
    one = one.withColumn("rrf", F.round(term("d_rank") + term("s_rank"), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.coalesce("d_rank", F.col("s_rank") + 100_000))
    return one.withColumn("pos", F.row_number().over(w))


def pool(fused: DataFrame, floors: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, chunk_id, pool_pos): the head of the fusion, then floor rows that aren't in it, by group and rank.

    `floors`: query_id, chunk_id, floor_no (place of the group in the query's list), rank."""
    head = fused.where(F.col("pos") <= settings.pool).select("query_id", "chunk_id", F.col("pos").alias("pool_pos"))
    if floors is None:
        return head
    more = floors.where(F.col("rank") <= settings.floor_pool).join(head, ["query_id", "chunk_id"], "left_anti")
    more = more.groupBy("query_id", "chunk_id").agg(F.min(F.struct("floor_no", "rank")).alias("at"))
    size = head.groupBy("query_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy("at")
    added = more.join(size, "query_id", "left").select("query_id", "chunk_id", (F.coalesce("n", F.lit(0)) + F.row_number().over(w)).cast("int").alias("pool_pos"))
    return head.unionByName(added)


#: Candidates that are broadcast at once.
BROADCAST_ROWS = 200_000


def with_chunks(pooled: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with their chunks' columns. They are broadcast in parts of bounded size, so texts are read where they are and none but theirs moves."""
    pooled = cut(pooled)
    parts = -(-pooled.count() // BROADCAST_ROWS) or 1
    each = [F.broadcast(pooled.where(F.pmod(F.xxhash64("query_id", "chunk_id"), F.lit(parts)) == p)).join(chunks, "chunk_id") for p in range(parts)]
    return reduce(DataFrame.unionByName, each)


def rerank(pooled: DataFrame, score: Column) -> DataFrame:
    """All rows with `score` and `rank`: highest score first, pool order among equals."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_pos")
    return pooled.withColumn("score", F.round(score, DIGITS)).withColumn("rank", F.row_number().over(w))
