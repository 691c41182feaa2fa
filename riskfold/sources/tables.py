"""Feature-table and report readers / writers."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.operators.dataset import align
from riskfold.schema import FEATURE_NAMES, REPORT

log = logging.getLogger(__name__)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def read_feature_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The 30 known features in model order as DOUBLE (missing column
    or null -> 0, with a warning for missing columns) and an INT label.

    CSV is read as strings by header name and cast, so no inference pass
    runs over the data.  A missing path raises FileNotFoundError.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"no feature table under {path}")
    if fmt == "csv":
        raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    missing = [f for f in FEATURE_NAMES if f not in raw.columns]
    if missing:
        log.warning("columns filled with zeros, as the table has none: %s", missing)
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in raw.columns else F.lit(0.0).alias(f)
            for f in FEATURE_NAMES]
    label = F.col("label").cast("double").cast("int") if "label" in raw.columns else F.lit(None).cast("int")
    return raw.select(*cols, label.alias("label"))


def write_feature_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Feature table with a header row (CSV) or as parquet."""
    out = df.select(*FEATURE_NAMES, "label")
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)


def read_feature_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per-repo feature tables (Parquet) that need not have the same
    columns, as one aligned table with its ``repo``, ``path`` and label.  The
    schemas of all files are merged, columns that a table lacks are zeros,
    unknown ones are left out; missing and empty tables are skipped."""
    there = [p for p in paths if _has_files(spark, p)]
    if not there:
        raise FileNotFoundError("none of these feature tables has a file: " + ", ".join(paths))
    return align(spark.read.option("mergeSchema", "true").parquet(*there), keep=("repo", "path"))


def _has_files(spark: SparkSession, path: str) -> bool:
    """Whether any Parquet file lies under ``path``."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return False
    files = fs.listFiles(folder, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def write_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The nested scored report as JSON lines (structs and arrays kept)."""
    report.write.mode(mode).json(path)


def read_report_json(spark: SparkSession, path: str) -> DataFrame:
    """A nested report by its declared schema."""
    return spark.read.schema(REPORT).json(path)


def report_order(score: str, *names: str) -> list[Column]:
    """Riskiest first; files without a score count as 0; ties by name."""
    return [F.coalesce(F.col(score), F.lit(0.0)).desc(), *[F.col(n).asc() for n in names]]


_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_report_csv(table: DataFrame, path: str, order: Sequence[Column] = (), mode: str = "overwrite") -> None:
    """A flat report as CSV with a fixed header.  Null is a blank, an
    empty text is a pair of quotes.  With ``order`` the rows are dealt by
    ranges and sorted, so the files in the order of their names, read one
    after the other, hold the report in its order."""
    (table.orderBy(*order) if order else table).write.mode(mode).options(**_CSV).csv(path)


def read_report_csv(spark: SparkSession, path: str, schema: T.StructType, position: str | None = None) -> DataFrame:
    """A flat report by its declared schema; blanks are nulls again.
    ``position`` names a column for the place of each row in the whole report,
    from 1: its line, behind those of the files before its own."""
    empty = "\x01"  # a pair of quotes is read as this: as an empty text it would count as a blank
    df = spark.read.schema(schema).options(**_CSV, multiLine=True, enforceSchema=False, emptyValue=empty).csv(path)
    texts = {f.name: F.when(F.col(f.name) == empty, "").otherwise(F.col(f.name)) for f in schema.fields if f.dataType == T.StringType()}
    df = df.withColumns(texts)
    if position is None:
        return df
    # a file with quoted line breaks is one split, read from its first line
    rows = df.select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    lines = Window.partitionBy("_file").orderBy("_id")
    rows = rows.withColumn("_line", F.row_number().over(lines)).drop("_id")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file
    starts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_file").withColumn(position, F.col("_start") + F.col("_line")).drop("_file", "_line", "_start")
