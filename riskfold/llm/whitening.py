"""Embedding whitening with distributed block matrices.

Each component c of a vector becomes the whole number floor(1024 * c) +
100000, so sums and deviations are exact.  Rows get an index without a
shuffle, are centred (as ``(n * x - S) / n``, a difference of whole numbers)
and laid out as a Spark MLlib ``BlockMatrix``: blocks of rows, as high as
``BLOCK_BYTES`` allow.  The product of its transpose with itself is the
scatter matrix; the products of ``MIDDLE`` blocks each are summed where they
are made and their sums reduced, so no task gathers all blocks.  The scatter
matrix (dimensions squared, whatever the number of rows) comes to the driver
for its eigenvectors, and a second product with the small whitening matrix
projects all rows.  Index, matrices and results stay in the JVM.

What grows on the driver is only the list of block coordinates that MLlib
itself keeps while it plans a product: a pair of numbers for some ten
thousand rows.

Defined results: rows whose vector is null, empty or holds a null or
non-finite component take no part, nor do components too large to count
exactly (1024 * c beyond 2**40) and vectors of another length than the most
common one (the longest, if several are).  Repeated rows and ids, and rows
without an id, each count and each come back.  Components whose eigenvalue is
zero to rounding (at most ``dimensions * 2**-52`` of the largest) have no unit
variance to give and are left out, so a single row or equal rows have no
result.  ``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfold.llm.common import Tables, cut_lineage

#: Most bytes of a block of rows, and blocks that one task multiplies.
BLOCK_BYTES = 2 << 20
MIDDLE = 16

SCALE, OFFSET = 1024, 100_000
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (whole numbers) of the rows that take part."""
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE > F.lit(float(1 << 40)))))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0)).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(OFFSET)).alias("x"))


def indexed(rows: DataFrame, tables: Tables) -> DataFrame:
    """The rows with a gapless ``row``: numbered within the tasks that write
    them, behind the rows of the tasks before."""
    low = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    kept = tables.write(rows.select("*", F.spark_partition_id().alias("part"), low.alias("at")), "whitening-rows")
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # a row for each task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return kept.join(F.broadcast(starts), "part").select((F.col("start") + F.col("at")).alias("row"), *rows.columns)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many rows, and the sum of each dimension."""
    found = rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("s")).orderBy("i").collect()
    return (found[0]["n"], [r["s"] for r in found]) if found else (0, [])


def _product(left: BlockMatrix, right: BlockMatrix, pieces: int = 1) -> BlockMatrix:
    """``left.multiply(right)`` with the middle dimension split in ``pieces``
    (MLlib's own parameter, which its Python method leaves out)."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, pieces)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def _blocks(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """``row`` and ``y`` as blocks of rows, each block as wide as a row."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector("y").alias("vector")), "vector")
    high = max(1, min(n, BLOCK_BYTES // (8 * dims)))
    return IndexedRowMatrix(vectors, n, dims).toBlockMatrix(high, dims)


def _by_row(matrix: BlockMatrix) -> DataFrame:
    """index and z (array of double) of each row of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("row"), vector_to_array("vector").alias("z"))


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times itself: dimensions x dimensions."""
    pieces = max(1, math.ceil(blocks.numRowBlocks / MIDDLE))
    return _product(blocks.transpose(), blocks, pieces).toLocalMatrix().toArray()


def _constant(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def whiten(table: DataFrame, components: int = 8) -> DataFrame:
    """One row for each vector that takes part and each component."""
    spark = table.sparkSession
    tables = Tables(spark)
    rows = indexed(whole_vectors(table), tables)
    n, sums = _sums(rows)
    if not n:
        return spark.createDataFrame([], RESULT)
    dims = len(sums)
    many, digits = F.lit(n).cast("long"), "decimal(19,0)"
    deviations = F.zip_with("x", _constant(sums), lambda c, s: F.struct(
        F.try_subtract(F.try_multiply(many, c), s).alias("d"), (c - s / many).alias("near")))
    square = F.aggregate("d", F.lit(0).cast("decimal(38,0)"), lambda a, c: F.try_add(a, c["d"].cast(digits) * c["d"].cast(digits)).cast("decimal(38,0)"))
    centred = F.transform("d", lambda c: F.coalesce(c["d"] / many, c["near"]))
    rows = tables.write(rows.select("row", "vec_id", deviations.alias("d")).select(
        "row", "vec_id", square.try_cast("long").alias("deviation"), centred.alias("y")), "whitening-centred")
    blocks = _blocks(rows, n, dims)
    covariance = _scatter(blocks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > max(values[0], 0) * dims * 2.0 ** -52).sum())
    if not k:
        tables.drop()
        return spark.createDataFrame([], RESULT)
    matrix = vectors[:, :k] / np.sqrt(values[:k])
    whitener = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, k, matrix.ravel(order="F").tolist()))], 1),
                           dims, k, dims, k)
    projected = tables.write(_by_row(_product(blocks, whitener)), "whitening-projected")
    means = projected.select(F.posexplode("z").alias("i", "c")).groupBy("i").agg(F.avg("c").alias("m")).orderBy("i").collect()
    centre = [r["m"] for r in means]
    centred = projected.select("row", F.zip_with("z", F.array(*[F.lit(m) for m in centre]), lambda a, m: a - m).alias("y"))
    error = float(np.abs(_scatter(_blocks(centred, n, k)) / n - np.eye(k)).max())
    shares = [float(v) for v in values[:k] / np.trace(covariance)]
    each = rows.join(projected, "row").select("vec_id", "deviation", F.posexplode("z").alias("i", "whitened"))
    out = cut_lineage(each.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(s) for s in shares]), F.col("i")).alias("explained"), F.lit(error).alias("identity_error")), "whitened")
    tables.drop()
    return out
