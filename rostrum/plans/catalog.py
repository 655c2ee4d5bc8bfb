"""Registry of named queries, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


#: Session setting: deal the rows of tables that come in fewer splits out to so many partitions. Unset: as read.
PARTITIONS = "spark.rostrum.input.partitions"
#: Bytes below which a table is left as read.
WORTH_DEALING = 4 << 20


class Tables:
    """Attribute access to the parquet tables of one scale-factor folder.

    A file with a single row group is one split however many cores there are, and whatever is computed from it
    without a shuffle then runs in one task. With PARTITIONS set, the needed columns of such tables are dealt out first.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self._dealt(self.spark.read.parquet(self.path(name)), name)
        self.__dict__[name] = df
        return df

    def _dealt(self, df: DataFrame, name: str) -> DataFrame:
        wanted = int(self.spark.conf.get(PARTITIONS, None) or 0)
        if wanted <= 1:
            return df
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        size = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        few = size >= WORTH_DEALING and len(df.inputFiles()) < wanted
        return df.repartition(wanted) if few else df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register
