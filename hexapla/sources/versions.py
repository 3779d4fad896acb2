"""Tables that are replaced without a gap.

A table is a folder of versions. A new version is written aside as a whole and takes effect with a small file that has the next number and names it; a reader
takes the version that the highest number names and keeps to it, so a table that is there is there at every moment, old or new. A number's file can be made once
only: of two writers that began from the same version the second finds its number taken, takes its version back and fails. One that dies between making
the file and naming its version leaves a number that readers pass over. The last `keep` versions stay for readers that are still at work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from hexapla.sources.sinks import hadoop_files

_MARK = "_version-"


class Conflict(RuntimeError):
    """Another writer replaced the table meanwhile."""


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = hadoop_files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[len(_MARK) :]) for n in names if n.startswith(_MARK))


def _mark(path: str, number: int) -> str:
    return f"{path}/{_MARK}{number:012d}"


def _named(spark: SparkSession, path: str, number: int) -> str:
    """The folder that a number names; empty if it doesn't yet, or no longer is there."""
    fs, at = hadoop_files(spark, _mark(path, number))
    try:
        stream = fs.open(at)
    except Py4JJavaError as e:
        if "FileNotFoundException" in str(e.java_exception):
            return ""
        raise
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The table as it now is; later replacements don't change what this reads, until `keep` of them have come."""
    for number in reversed(_numbers(spark, path)):
        if folder := _named(spark, path, number):
            return spark.read.parquet(f"{path}/{folder}")
    raise FileNotFoundError(path)


def replace_version(rows: DataFrame, path: str, partition_by: Iterable[str] = (), keep: int = 3) -> int:
    """Replaces the table by `rows`, which may read it, and returns the version's number. Fails with Conflict, and changes nothing, if another did so meanwhile."""
    spark = rows.sparkSession
    number, folder = max(_numbers(spark, path), default=0) + 1, f"data-{uuid.uuid4().hex}"
    rows.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    fs, own = hadoop_files(spark, f"{path}/{folder}")
    mark = hadoop_files(spark, _mark(path, number))[1]
    try:
        out = fs.create(mark, False)  # fails if it is there
    except Py4JJavaError as e:
        fs.delete(own, True)
        if "FileAlreadyExists" in str(e.java_exception) or fs.exists(mark):
            raise Conflict(path) from None
        raise
    out.write(bytearray(folder.encode()))
    out.close()
    named = [(n, f) for n in _numbers(spark, path) if (f := _named(spark, path, n))]
    for old, gone in named[:-keep]:
        fs.delete(hadoop_files(spark, _mark(path, old))[1], False)
        fs.delete(hadoop_files(spark, f"{path}/{gone}")[1], True)
    return number
