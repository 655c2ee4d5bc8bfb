"""Sinks: CSV, Parquet, JSON records, JSON lines of training messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_messages(df: DataFrame, path: str, system: str, user: str, assistant: str) -> None:
    """One JSON line per row: system, user and assistant messages."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    line = F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", F.col(user)), message("assistant", F.col(assistant))).alias("messages")))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str) -> None:
    """Enriched CSV -> narrow typed Parquet."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(csv_path)
    to_parquet(schemas.narrow(raw), parquet_path)
