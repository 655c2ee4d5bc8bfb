"""Readers for the hearing sources. Every reader has an explicit schema."""

from __future__ import annotations

import csv as csv_lines

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import members
from ..operators import relational as rel

CSV_TABLES = {
    "hearings": schemas.HEARINGS,
    "hearings_metadata": schemas.HEARINGS,
    "hearings_members": schemas.HEARING_MEMBERS,
    "hearings_committees": schemas.HEARING_COMMITTEES,
    "hearings_dates": schemas.HEARING_DATES,
    "members": schemas.MEMBERS,
    "members_terms": schemas.TERMS,
}


def csv(spark: SparkSession, path: str, schema: str | T.StructType, *, tolerant: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV whose columns are found by header name; `tolerant` drops malformed rows.

    Columns missing from the file become typed nulls, extra ones are not read.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    if multi_line:
        reader = reader.option("multiLine", True)
    head = reader.csv(path)
    if not tolerant:
        return schemas.conform(head, schema)
    as_text = T.StructType([T.StructField(c, T.StringType()) for c in head.columns])
    strict = reader.schema(as_text).option("mode", "DROPMALFORMED").option("enforceSchema", True)
    # Pruning would hide malformed rows from the parser.
    return schemas.conform(strict.option("columnPruning", False).csv(path), schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the CSV dimension or bridge tables in a folder."""
    return csv(spark, f"{folder}/{name}.csv", CSV_TABLES[name])


def hearing_texts(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Transcripts, optionally only those of the wanted hearings.

    Quoted multi-line CSV cannot be split; convert it to Parquet once (`to_parquet`) and
    read that here for anything large.
    """
    df = spark.read.schema(schemas.HEARING_TEXTS).parquet(path) if not path.endswith(".csv") else csv(spark, path, schemas.HEARING_TEXTS, multi_line=True)
    return df if ids is None else rel.keep_in(df, ids, "hearing_id")


def ideology(spark: SparkSession, path: str, congress_range: tuple[int, int] | None = None, chamber: str | None = "House") -> DataFrame:
    df = csv(spark, path, schemas.IDEOLOGY)
    if chamber:
        df = df.filter(F.col("chamber") == chamber)
    return df if congress_range is None else df.filter(F.col("congress").between(*congress_range))


def elections(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.ELECTIONS, tolerant=True)


def bills(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Nested bill files, found recursively, one document per file."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.schema(schemas.BILLS).json(folder)


def leaders(spark: SparkSession, path: str, congresses: list[int] | None = None) -> DataFrame:
    """Leader table from JSON lines whose role fields hold one id or a list of ids."""
    raw = spark.read.schema("congress int, thomas_id string, chair string, ranking_member string").json(path)

    def ids(c):
        text = F.col(c)
        return F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text)).alias(c)

    nested = raw.select("congress", "thomas_id", *[F.when(F.col(c).isNotNull(), ids(c)).alias(c) for c in ("chair", "ranking_member")])
    return members.leaders_from_nested(nested, congresses)


def xml(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType) -> DataFrame:
    """XML records; repeated elements become arrays."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def xml_full_text(spark: SparkSession, path: str, row_tag: str, key: str, node: str) -> DataFrame:
    """Repeated text nodes of each record joined by blanks."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(node, T.ArrayType(T.StringType()))])
    df = xml(spark, path, row_tag, schema)
    return df.select(key, F.array_join(node, " ").alias("raw_text"))


def _by_header(spark: SparkSession, glob: str) -> dict[tuple[str, ...], list[str]]:
    """Files of a glob grouped by their header columns; empty files are left out.

    Reads the first line of each file and nothing else.
    """
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(glob)
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[tuple[str, ...], list[str]] = {}
    pending = sorted(fs.globStatus(pattern) or [], key=lambda s: s.getPath().toString())
    while pending:
        status = pending.pop(0)
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if status.isDirectory():
            pending = sorted(fs.listStatus(status.getPath()), key=lambda s: s.getPath().toString()) + pending
        elif status.getLen():
            stream = fs.open(status.getPath())
            try:
                line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
            finally:
                stream.close()
            if line:
                header = tuple(c.strip() for c in next(csv_lines.reader([line.lstrip("\ufeff")], skipinitialspace=True)))
                found.setdefault(header, []).append(status.getPath().toString())
    return found


def csv_union(spark: SparkSession, glob: str, schema: str | T.StructType, *, tolerant: bool = False) -> DataFrame:
    """Many CSV files with the file name and path kept; columns are found by each file's own header.

    Files may order their columns differently, lack some or have more. `tolerant` drops malformed
    rows and corrupt files.
    """
    want = schemas.struct(schema)
    out = spark.createDataFrame([], T.StructType([*want.fields, T.StructField("file_name", T.StringType()), T.StructField("file_path", T.StringType())]))
    for header, files in _by_header(spark, glob).items():
        as_text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        reader = spark.read.schema(as_text).option("header", True).option("escape", '"').option("enforceSchema", True)
        if tolerant:
            reader = reader.option("mode", "DROPMALFORMED").option("columnPruning", False).option("ignoreCorruptFiles", True)
        meta = F.col("_metadata")
        named = reader.csv(files).select("*", meta["file_name"].alias("file_name"), meta["file_path"].alias("file_path"))
        extra = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("file_path", T.StringType())])
        out = out.unionByName(schemas.conform(named, T.StructType([*want.fields, *extra.fields])))
    return out


def slices(spark: SparkSession, glob: str, schema: str | T.StructType, key: list[str]) -> DataFrame:
    """Slice files combined: empty and corrupt ones are skipped, keys kept once (last file by path wins)."""
    df = csv_union(spark, glob, schema, tolerant=True).drop("file_name").withColumnRenamed("file_path", "_file").dropna(subset=key)
    rest = [c for c in df.columns if c not in key and c != "_file"]
    return rel.last_by(df, key, ["_file", *rest]).drop("_file")


def packages(spark: SparkSession, path: str) -> DataFrame:
    """Landed package-list pages -> one row per package; missing fields null, ids kept once."""
    pages = spark.read.schema(schemas.PACKAGE_PAGE).option("multiLine", True).json(path)
    rows = pages.select(F.explode("packages").alias("p")).select("p.*")
    typed = rows.withColumn("congress", F.col("congress").try_cast("int")).filter(F.col("packageId").isNotNull())
    return rel.last_by(typed, ["packageId"], ["lastModified", "title"])


def without_heavy(df: DataFrame, heavy: tuple[str, ...] = ("context_before", "context_after")) -> DataFrame:
    """The table without its context columns; the scan then never reads them."""
    return df.drop(*heavy)


def point(df: DataFrame, wanted: list[str], **keys) -> DataFrame:
    """Lookup by key values; the predicates reach the Parquet scan."""
    for k, v in keys.items():
        df = df.filter(F.col(k) == v)
    return rel.existing(df, wanted)
