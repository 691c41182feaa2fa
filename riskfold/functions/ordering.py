"""Exact global positions and running sums without a global window.

A window over a whole ordered table runs in one task.  Here the table is
range-partitioned by its sort key instead (``orderBy`` samples the key, so
slices are balanced even when one value or group holds a third of the
rows, as long as the key includes a unique tie-breaker).  Each slice is a
contiguous run of the global order; per-slice totals form a table with one
row per slice, whose running offsets are broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def _slices(df: DataFrame, keys: list[Column], n: int | None, extra: list[Column] = ()) -> DataFrame:
    """Range-partition into ``n`` slices, sort each slice, tag rows with
    their slice id (and ``extra`` per-slice columns), and materialise the
    result once.

    Range bounds come from sampling the input; two independent reads of an
    un-materialised plan could sample (and so slice) differently, which
    would make slice offsets and slice contents disagree.  Reading one
    written table makes every later pass see the same slices.
    """
    from riskfold.session import cut_lineage

    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_slice", F.spark_partition_id())
    for c in extra:
        s = s.withColumn(*c)
    return cut_lineage(s, "slices")


def global_positions(df: DataFrame, order: list[Column], name: str = "position",
                     slices: int | None = None) -> DataFrame:
    """Adds ``name``: the 1-based position of each row in ``order`` (which
    must be a total order for the result to be deterministic)."""
    in_slice = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), _LOW_BITS)
    s = _slices(df, order, slices, [("_in_slice", in_slice)])
    sizes = s.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row per slice (= partition of the sorted table)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offsets), "_slice")
            .withColumn(name, F.col("_off") + F.col("_in_slice") + 1)
            .drop("_slice", "_in_slice", "_off"))


def running_sums(df: DataFrame, by: list[str], order: list[Column], cols: list[str],
                 inclusive: bool = True, slices: int | None = None) -> DataFrame:
    """Adds ``cum_<c>`` per group ``by``: the sum of ``c`` over the rows of
    the group before this one in ``order`` (and this row if ``inclusive``).

    ``order`` must break ties (rows with equal keys would otherwise split
    arbitrarily).  Slices come from a range partitioning on (by, order);
    the running sum inside a slice is a window over that slice only.
    """
    by = list(by)
    s = _slices(df, [*[F.col(b) for b in by], *order], slices)
    part = s.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (group, slice): at most groups + slices rows, which is
    # small for features / models / folds but grows with the number of
    # groups (e.g. repos), so the join strategy is left to AQE's size check
    offsets = part.select(*by, "_slice", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                           for c in cols])
    frame_end = 0 if inclusive else -1
    w = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    out = s.join(offsets if by else F.broadcast(offsets), [*by, "_slice"])
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0)))
    return out.drop("_slice", *[f"_o_{c}" for c in cols])
