"""Stage tables in the folder that driver and executors share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below `spark.checkpoint.dir`; the owner of that folder empties it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet and go on from the files.

    Costly Python work is not repeated by the several readers that follow, a lost executor
    costs only its own tasks, and the files keep sizes for the optimizer.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about `size` bytes, a longer text by itself."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield at, texts.slice(at, upto - at)
        at = upto


def forget_encoders() -> None:
    """Give back what tasks of other stages left in this Python worker: the segments that packing remembers, Arrow's unused memory."""
    kept = getattr(sys.modules.get("tokenizers"), "_rostrum_encoders", None)
    if kept:
        kept.clear()
    pa.default_memory_pool().release_unused()
