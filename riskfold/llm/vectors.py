"""Vector tables: which rows take part, and how blocks of rows meet queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id and x (doubles) of the rows whose vector is not null, has no
    null or non-finite component and, unless ``zero``, is not all zeros.
    Rows of another length than the most common one (the greater, if two are
    as common) take no part either; an id must not be null."""
    x = F.col("x")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    if not zero:
        rows = rows.where(F.exists(x, lambda v: v != 0))
    common = rows.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("x") == (common.n if common else 0))


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    """(rows, dimensions) of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0), dtype)
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(dtype, copy=False)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of highest score of each query, ties to the smaller
    vec_id, ranked from 1.  Each task keeps k rows a query before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
