"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.session import cut_lineage, ensure_checkpoint_dir, ship_package

__all__ = ["Tables", "crc_fold", "cut_lineage", "documents", "ensure_checkpoint_dir", "pieces_for",
           "read_table", "releasing", "ship_package", "text_batches"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, through Spark's reader (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Tables of one operator's steps in the shared checkpoint folder, dropped
    when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/riskfold-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Delete all but the ``keep`` last written."""
        sc = self.spark.sparkContext
        while len(self.paths) > keep:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.paths.pop(0))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def documents(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null text as empty): other columns of the
    input, whatever their names, never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def crc_fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id falls in fold 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(0))


def text_batches(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with at most ``limit`` bytes of ``text`` each
    (one longer row stands alone), so a worker holds a bounded piece."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def pieces_for(rows: int, per_piece: int, least: int = 1, most: int = 1 << 20) -> int:
    """How many pieces hold ``rows`` rows at ``per_piece`` rows each."""
    return max(least, min(most, math.ceil(rows / max(1, per_piece))))


def release_memory() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc
    if trim is not None:
        trim(0)


def releasing(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A ``mapInArrow`` function that leaves its worker, which Spark keeps for
    other tasks and stages, without the memory that it freed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release_memory()
    return run


def each_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int = 8 << 20):
    """A ``mapInArrow`` function that applies ``fn`` to bounded slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
    return run
