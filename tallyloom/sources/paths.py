"""Files by URI on any file system that Hadoop opens: look, list, copy, delete.  For a job's few files, not for data."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _at(spark, uri)
    return bool(fs.exists(path))


def make_folder(spark: SparkSession, uri: str) -> None:
    fs, path = _at(spark, uri)
    fs.mkdirs(path)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """URIs that match a pattern, in order."""
    fs, path = _at(spark, pattern)
    return sorted(str(s.getPath().toString()) for s in fs.globStatus(path) or [])


def children(spark: SparkSession, uri: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    fs, path = _at(spark, uri)
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []


def read_bytes(spark: SparkSession, uri: str) -> bytes:
    row = spark.read.format("binaryFile").load(uri).select("content").first()
    return bytes(row.content)


def write_bytes(spark: SparkSession, uri: str, data: bytes, overwrite: bool = True) -> None:
    """Written beside its place and renamed, so that no reader sees a part of it."""
    fs, path = _at(spark, uri)
    if not overwrite and fs.exists(path):
        raise FileExistsError(uri)
    part = _at(spark, f"{uri}.part")[1]
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(path, False)
    if not fs.rename(part, path):
        raise OSError(f"cannot rename to {uri}")


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A file or a folder, from one file system to another."""
    (from_, a), (to, b) = _at(spark, source), _at(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_, a, to, b, False, spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, uri: str) -> bool:
    """Whether something was there to delete; folders go with all that is in them."""
    fs, path = _at(spark, uri)
    return bool(fs.delete(path, True))
