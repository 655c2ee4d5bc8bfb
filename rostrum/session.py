"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that suit both a laptop and a large cluster. Partition counts are left
# to AQE: it starts from shuffle.partitions and coalesces to the advisory size.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(app: str = "rostrum", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the cluster's own setting wins.

    A temporary folder is used only on a local master, where the driver and the
    executors share one disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="rostrum-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def return_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what has ended; otherwise they stay until the driver happens to collect its garbage."""
    for pause in (0.2, 0):  # only the second collection finds the shuffles unused
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def cut_lineage(df: DataFrame, large: bool = False) -> DataFrame:
    """Write `df` as a Parquet table below the shared checkpoint folder and continue from the files.

    Unlike a checkpoint the table keeps its size for the optimizer, is read by column and is compressed.
    `large`: much was shuffled for it, whose files go once it is written.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if large:
        return_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
