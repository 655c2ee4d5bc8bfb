"""Stage tables: written once to shared storage, read back when complete and fresh."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import return_shuffles


def _status(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None


def is_fresh(spark: SparkSession, path: str, newer_than: str | None = None, token: str | None = None) -> bool:
    """The stage has finished (`_SUCCESS`), is not older than its input and was built under `token`."""
    done = _status(spark, f"{path}/_SUCCESS")
    if done is None or (token and _status(spark, f"{path}/_TOKEN-{token}") is None):
        return False
    if newer_than is None:
        return True
    source = _status(spark, newer_than)
    return source is None or done >= source


def token_of(*parts: DataFrame | object) -> str:
    """Digest of parameters and of tables: a table counts by its plan, its files and their times."""
    said = []
    for part in parts:
        if isinstance(part, DataFrame):
            files = sorted(part.inputFiles())
            said.append((part.semanticHash(), [(f, _status(part.sparkSession, f)) for f in files]))
        else:
            said.append(part)
    return hashlib.md5(repr(said).encode()).hexdigest()


def cached(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    *,
    newer_than: str | None = None,
    token: str | None = None,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Read the stage at `path`, building it first when absent, older than its input or built under another token.

    A token stands for inputs and parameters (`token_of`); it is recorded beside the data.
    """
    if not is_fresh(spark, path, newer_than, token):
        writer = build().write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        if token:
            jvm = spark.sparkContext._jvm
            mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_TOKEN-{token}")
            mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()
        return_shuffles(spark)
    return spark.read.parquet(path)
