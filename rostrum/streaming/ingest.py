"""Resumable ingestion: the batch loops that append, update and score, as streams.

Every query runs with `availableNow`: it takes what has landed since its checkpoint and
stops, so a run can be scheduled or repeated at any time. Checkpoints and outputs live in
shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import labels
from ..operators import relational as rel


def _source(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


#: Buckets that keys are kept in, and how many runs are put together into one.
BUCKETS, FAN = 16, 8


def runs_before(batch: int, fan: int = FAN) -> list[tuple[int, int]]:
    """The runs [from, to) that hold all batches before `batch`: fewer than `fan` of each length, lengths being powers of it."""
    out, at = [], 0
    while at < batch:
        size = 1
        while at % (size * fan) == 0 and at + size * fan <= batch:
            size *= fan
        out.append((at, at + size))
        at += size
    return out


def _completed_by(batch: int, fan: int) -> list[tuple[int, int]]:
    """The longer runs that batch number `batch` completes, the shorter first."""
    out, size = [], fan
    while (batch + 1) % size == 0:
        out.append((batch + 1 - size, batch + 1))
        size *= fan
    return out


def _run(root: str, run: tuple[int, int]) -> str:
    return f"{root}/run={run[0]}-{run[1]}"


def _read_runs(spark: SparkSession, root: str, runs: list[tuple[int, int]], schema: T.StructType) -> DataFrame:
    """The rows of some runs. Their names follow from the batch number, so nothing is listed but what they hold."""
    parts = [spark.read.schema(schema).parquet(_run(root, r)).withColumn("_to", F.lit(r[1])) for r in runs]
    return rel.union_all(*parts) if parts else spark.createDataFrame([], T.StructType([*schema, T.StructField("_to", T.IntegerType())]))


def _read_keys(spark: SparkSession, root: str, runs: list[tuple[int, int]], keys: T.StructType) -> DataFrame:
    """The seen keys of some runs and their buckets, in one scan."""
    wide = T.StructType([*keys, T.StructField("run", T.StringType())])
    return spark.read.schema(wide).option("basePath", root).parquet(*[_run(root, r) for r in runs]).drop("run")


def _parts_of(run: tuple[int, int], fan: int) -> list[tuple[int, int]]:
    step = (run[1] - run[0]) // fan
    return [(a, a + step) for a in range(run[0], run[1], step)]


def append_new(
    spark: SparkSession, landed: str, schema: str | T.StructType, out: str, checkpoint: str, *, key: list[str], time_col: str,
    files_per_batch: int | None = None, buckets: int = BUCKETS, fan: int = FAN,
) -> None:
    """Append every record whose key has not been seen before, however late it lands.

    A batch keeps its keys once, the earliest record by `time_col`, and drops those that earlier batches
    wrote. It goes to its own folder, partitioned by month, and a batch that is run again overwrites what
    it wrote. The output has the columns of the source, `month` and `batch`.

    Seen keys lie beside the output in `{out}-keys`, in runs of batches, each partitioned by a bucket of the key. A batch
    reads only the buckets that its own keys fall into and, of a whole number as key, the range that they span. Whenever `fan`
    runs of a length are complete they are put together, so after n batches a bucket lies in fewer than fan * log(n) files and
    a key has been rewritten log(n) times. Seen keys are looked through where they lie: only those that the batch may hold move.
    """
    kept = f"{out}-keys"

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        keys = T.StructType([*(batch.schema[k] for k in key), T.StructField("bucket", T.IntegerType())])
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        runs = runs_before(batch_id, fan)
        new = _first_of_each(batch, key, time_col)
        if runs:
            new = unseen(new, batch.select(*key), _read_keys(session, kept, runs, keys), key, bucket)
        month = F.date_format(F.col(time_col).cast("timestamp"), "yyyy-MM")
        new.withColumn("month", month).write.mode("overwrite").partitionBy("month").parquet(f"{out}/batch={batch_id}")
        written = session.read.schema(T.StructType([*batch.schema, T.StructField("month", T.StringType())])).parquet(f"{out}/batch={batch_id}")
        _by_bucket(written.select(*key).withColumn("bucket", bucket), _run(kept, (batch_id, batch_id + 1)))
        for run in _completed_by(batch_id, fan):
            _by_bucket(_read_keys(session, kept, _parts_of(run, fan), keys), _run(kept, run))

    _finish(
        _source(spark, landed, schema, files_per_batch).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _first_of_each(batch: DataFrame, key: list[str], time_col: str) -> DataFrame:
    """The earliest row of each key.

    A landed file is often one row group and so one task: its rows are dealt out before they are reduced. Time is part of
    the deal, so a key that holds much of a batch is still reduced by many tasks.
    """
    rest = sorted(c for c in batch.columns if c not in key and c != time_col)
    return rel.first_by(batch.repartition(*key, time_col), key, [time_col, *rest])


def unseen(new: DataFrame, asked: DataFrame, seen: DataFrame, key: list[str], bucket: Column) -> DataFrame:
    """The rows of `new` whose key is not in `seen`; `asked` has the keys of `new`, any number of times. Null keys are never seen."""
    first = key[0]
    whole = isinstance(asked.schema[first].dataType, T.IntegralType)
    span = [F.min(first), F.max(first)] if whole else []
    touched, n, *ends = asked.agg(F.sort_array(F.collect_set(bucket)), F.count(F.lit(1)), *span).first()
    near = seen.filter(F.col("bucket").isin(touched))
    if whole:
        near = near.filter(F.col(first).between(*ends))
    marked, perhaps = rel.perhaps_listed(near.select(*key), asked, key, n)
    return new.join(marked.filter(perhaps).select(*key), key, "left_anti")


def _by_bucket(keys: DataFrame, path: str) -> None:
    """One file a bucket and task, in order of the keys; a large bucket is dealt to several tasks by AQE's rebalancing."""
    key = [c for c in keys.columns if c != "bucket"]
    keys.hint("rebalance", "bucket").sortWithinPartitions("bucket", *key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def upsert_log(
    spark: SparkSession, landed: str, schema: str | T.StructType, out: str, checkpoint: str, *, key: list[str], modified: str,
    files_per_batch: int | None = None, fan: int = FAN,
) -> None:
    """Newest version per key of every batch, as a log of runs under `out`.

    A batch that is run again overwrites its own run. Whenever `fan` runs of a length are complete they are put together
    into one with a single version per key; when all that landed is taken, the whole log is put together once,
    so `latest` reads one version per key.
    """
    wide = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def newest(rows: DataFrame) -> DataFrame:
        """Later batches win ties."""
        rest = sorted(c for c in wide.names if c not in key and c != modified)
        return rel.last_by(rows, key, [modified, "_to", *rest]).select(*wide.names)

    def write(batch: DataFrame, batch_id: int) -> None:
        newest(batch.withColumn("_to", F.lit(0))).write.mode("overwrite").parquet(_run(out, (batch_id, batch_id + 1)))
        for run in _completed_by(batch_id, fan):
            newest(_read_runs(batch.sparkSession, out, _parts_of(run, fan), wide)).write.mode("overwrite").parquet(_run(out, run))

    query = (
        _source(spark, landed, schema, files_per_batch).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    _finish(query)
    done = _batches_done(spark, checkpoint)
    if done and not _exists(spark, f"{out}/whole={done}/_SUCCESS"):
        newest(_read_runs(spark, out, runs_before(done, fan), wide)).write.mode("overwrite").parquet(f"{out}/whole={done}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    """The numbers that entries of a folder are named by, behind a prefix."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()]


def _batches_done(spark: SparkSession, checkpoint: str) -> int:
    """How many batches the stream has committed."""
    return max(_numbers(spark, f"{checkpoint}/commits"), default=-1) + 1


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Newest version per key, as of the last run of `upsert_log` that ended."""
    return spark.read.parquet(f"{out}/whole={max(_numbers(spark, out, 'whole='))}")


def score(
    spark: SparkSession, landed: str, schema: str | T.StructType, out: str, checkpoint: str, *, text_col: str, scorer: Callable[[pd.Series], pd.Series], files_per_batch: int | None = None
) -> None:
    """Score landed texts; a restarted run goes on after the last finished batch."""
    scored = labels.score_text(_source(spark, landed, schema, files_per_batch), text_col, scorer)
    _finish(
        scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
