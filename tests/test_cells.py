"""The vector index of cells against the search over all points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexapla.config import Settings
from hexapla.operators import cells, retrieve

POINT = "chunk_id long, vector array<double>, tradition string"


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Thirty tight clusters, one of them a third of all, and points that stand aside; the index and the points."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(30, 16))
    rows = [(i, (middle[0 if i % 3 == 0 else i % 30] + 0.1 * rng.normal(size=16)).tolist(), "ab"[i % 2]) for i in range(1500)]
    rows += [(2000, [0.0] * 16, "a"), (2001, [1.0, 2.0], "a"), (2002, None, "a"), (2003, [float("nan")] * 16, "b"), (2004, [], "b"), (2005, [None] * 16, "b"), (2006, rows[0][1], "a")]
    points = spark.createDataFrame(rows, POINT).repartition(5).cache()
    path = str(tmp_path_factory.mktemp("cells"))
    cells.write(points, path, 30, k=10)
    return points, path


def asked(spark, points):
    some = points.where("chunk_id % 100 = 0 AND chunk_id < 1500").select(F.col("chunk_id").alias("query_id"), "vector")
    return some.unionByName(spark.createDataFrame([(9000, [0.0] * 16), (9001, [3.0, 1.0]), (9002, None), (9003, [float("inf")] * 16)], "query_id long, vector array<double>"))


def test_exact_search_equals_all_points_and_reads_few_cells(spark, clustered):
    points, path = clustered
    queries = asked(spark, points)
    for block in (1000, 5):
        found, report = cells.search(spark, path, queries, 10, settings=Settings(query_block=block))
        assert rows_of(found) == rows_of(retrieve.dense_topk(points, queries, 10))
    share = {r.query_id: r.points_read / r.n_points for r in report.collect()}
    assert np.mean([v for q, v in share.items() if q < 9000]) < 0.5 and share[9000] == 1.0


def test_a_filter_and_more_rows_than_a_cell_has(spark, clustered):
    points, path = clustered
    queries = asked(spark, points)
    found, _ = cells.search(spark, path, queries, 120, where=F.col("tradition") == "b")
    assert rows_of(found) == rows_of(retrieve.dense_topk(points.where("tradition = 'b'"), queries, 120))


def test_probed_search_has_the_calibrated_recall(spark, clustered, tmp_path):
    points, path = clustered
    queries = asked(spark, points).where("query_id < 9000")
    found, report = cells.search(spark, path, queries, 10, exact=False)
    assert cells.recall(found, retrieve.dense_topk(points, queries, 10)).first().recall >= 0.9
    assert report.agg(F.avg(F.col("points_read") / F.col("n_points"))).first()[0] < 0.5
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    cells.write(e, str(tmp_path / "e"), 40, k=10)  # hardly any clusters: many cells have to be read
    queries = e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    found, _ = cells.search(spark, str(tmp_path / "e"), queries, 10, exact=False)
    assert cells.recall(found, retrieve.dense_topk(e, queries, 10)).first().recall >= 0.9


def test_every_point_is_in_the_cell_of_its_nearest_centroid(spark, clustered):
    points, path = clustered
    stored = cells.read(spark, path)
    assert stored.count() == points.count() and stored.where(F.col("cell") == cells.ASIDE).count() == 6
    centroids = {r.cell: np.array(r.centroid) for r in spark.read.parquet(f"{path}/centroids").collect()}
    for r in stored.where("chunk_id < 200").collect():
        v = np.array(r.vector) / np.linalg.norm(r.vector)
        assert r.cell == max(centroids, key=lambda c: v @ centroids[c]) and abs(np.linalg.norm(v - centroids[r.cell]) - r.residual) < 1e-6


def test_upsert_writes_only_the_cells_it_touches(spark, tmp_path):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(6, 8))
    rows = [(i, (middle[i % 6] + 0.05 * rng.normal(size=8)).tolist(), "a") for i in range(120)]
    points, path = spark.createDataFrame(rows, POINT), str(tmp_path / "cells")
    cells.write(points, path, 6, k=3)
    files = lambda: set(spark.read.parquet(f"{path}/points").inputFiles())
    before = files()
    moved = spark.createDataFrame([(0, middle[1].tolist(), "a"), (500, middle[1].tolist(), "a")], POINT)
    cells.upsert(moved, path)
    assert len(before & files()) >= 4  # cells of other clusters
    for again in range(2):
        now = points.where("chunk_id <> 0").unionByName(moved)
        queries = now.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
        assert rows_of(cells.search(spark, path, queries, 5)[0]) == rows_of(retrieve.dense_topk(now, queries, 5))
        cells.upsert(moved, path)
    everything = spark.createDataFrame([(i, middle[2].tolist(), "b") for i in (*range(120), 500)], POINT)  # five cells lose all
    cells.upsert(everything, path)
    assert cells.read(spark, path).count() == 121 and cells.read(spark, path).where("tradition = 'a'").count() == 0


def test_few_points_and_none(spark, tmp_path):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    for name, rows in (("none", []), ("null", [(1, None, "a")]), ("one", [(1, [2.0, 0.0], "a")])):
        points = spark.createDataFrame(rows, POINT)
        cells.write(points, str(tmp_path / name))
        found, report = cells.search(spark, str(tmp_path / name), queries, 3)
        assert rows_of(found) == rows_of(retrieve.dense_topk(points, queries, 3))
