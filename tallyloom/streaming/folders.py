"""Numbered folders below a path, as batches and versions are kept; only complete ones count."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended."""
    where, fs = _of(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def numbers(spark: SparkSession, path: str, name: str = "batch") -> list[int]:
    """The numbers N of complete folders ``name=N``, ascending."""
    where, fs = _of(spark, path)
    if not fs.exists(where):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}=") and complete(spark, f"{path}/{f}"))


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _of(spark, path)
    fs.delete(where, True)
