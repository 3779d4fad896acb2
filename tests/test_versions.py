"""Replacement of a table without a gap."""

import threading

import pytest
from pyspark.sql import functions as F

from hexapla.sources import versions


def test_a_reader_in_a_loop_never_fails(spark, tmp_path):
    path, stop, seen, failed = str(tmp_path / "t"), threading.Event(), set(), []
    versions.replace_version(spark.range(50).withColumn("v", F.lit(0)), path)

    def read():
        while not stop.is_set():
            try:
                rows = versions.read_version(spark, path).groupBy("v").count().collect()
                seen.add((rows[0].v, rows[0]["count"], len(rows)))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    t = threading.Thread(target=read)
    t.start()
    for v in range(1, 6):
        versions.replace_version(versions.read_version(spark, path).withColumn("v", F.lit(v)), path, keep=3)  # reads what it replaces
    stop.set()
    t.join()
    assert not failed and seen and {(n, k) for _, n, k in seen} == {(50, 1)}
    assert versions.read_version(spark, path).first().v == 5
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == 3


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    assert versions.replace_version(spark.range(3), path) == 1

    @F.udf("long")
    def slow(i):
        import time

        time.sleep(1.5)
        return i

    errors = []

    def write():
        try:
            versions.replace_version(spark.range(9).repartition(1).limit(2).select(slow("id").alias("id")), path)
        except versions.Conflict as e:
            errors.append(e)

    t = threading.Thread(target=write)
    t.start()
    import time

    time.sleep(1.0)
    assert versions.replace_version(spark.range(7), path) == 2
    t.join()
    assert len(errors) == 1 and versions.read_version(spark, path).count() == 7
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == 2
    with pytest.raises(Exception):  # noqa: B017  a write that fails leaves the table
        versions.replace_version(spark.range(3).select(F.raise_error(F.lit("no"))), path)
    assert versions.read_version(spark, path).count() == 7
    assert versions.replace_version(spark.range(1), path) == 3


def test_a_writer_that_died_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_version(spark.range(4), path)
    (tmp_path / "t" / "_version-000000000002").touch()  # claimed, never named
    assert versions.read_version(spark, path).count() == 4
    assert versions.replace_version(spark.range(6), path) == 3 and versions.read_version(spark, path).count() == 6
