"""Assemble, profile and split the labelled feature table.

Scale notes
* Profiles are single global aggregates (partial aggregation per task, one
  tiny row to the driver side), unpivoted afterwards.
* Exact percentiles go through a (feature, value, count) frequency table
  (partial aggregation collapses repeated values before any shuffle); the
  running counts over it are range-partitioned, so a feature with very many
  distinct values is still spread over many tasks.
* Stratified ranks never put a whole class in one task: rows are bucketed by
  a hash prefix, bucket sizes are counted (a table of 2 x n_buckets rows,
  broadcast back), and ranks are computed inside a bucket plus the bucket's
  cumulative offset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions.columns import exact_mean, md5_order_key, md5_unit, round_fixed
from riskfold.functions.ordering import running_sums
from riskfold.schema import FEATURE_NAMES
from riskfold.session import ship_package

DEFAULT_SEED = "42"
RANK_BUCKETS = 1024


# --- D1-D3: assembly ----------------------------------------------------------

def attach_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of labelled files; files that failed analysis drop out."""
    ok = features.where(F.col("error").isNull()) if "error" in features.columns else features
    return ok.join(labels.select("repo", "path", "label"), ["repo", "path"], "inner")


def union_datasets(frames: list[DataFrame], skip_empty: bool = True) -> DataFrame:
    """Union per-repo frames by column name, skipping missing and (with
    ``skip_empty``) empty inputs; missing columns become null and are
    zero-filled by ``align``.  ``isEmpty`` reads at most one row per frame."""
    out = None
    for df in frames:
        if df is None or (skip_empty and df.isEmpty()):
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no non-empty frames to union")
    return out


def align(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """D3: the 30 features in model order as DOUBLE (missing or null -> 0)
    plus an INT label."""
    cols = [F.col(k) for k in keep if k in df.columns]
    for f in FEATURE_NAMES:
        c = F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double")
        cols.append(F.coalesce(c, F.lit(0.0)).alias(f))
    label = F.col("label") if "label" in df.columns else F.lit(None)
    cols.append(F.coalesce(label.cast("int"), F.lit(0)).alias("label"))
    return df.select(*cols)


# --- D5-D8: profiles ------------------------------------------------------------

def class_balance(df: DataFrame) -> DataFrame:
    """Total, buggy and clean counts and percentages."""
    total = F.count(F.lit(1))
    buggy = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
    denom = F.greatest(total, F.lit(1))
    return df.agg(
        total.cast("long").alias("n_total"),
        buggy.cast("long").alias("n_buggy"),
        round_fixed(100.0 * buggy / denom, 6).alias("pct_buggy"),
        (total - buggy).cast("long").alias("n_clean"),
        round_fixed(100.0 * (total - buggy) / denom, 6).alias("pct_clean"),
    )


def _long(df: DataFrame, features: list[str]) -> DataFrame:
    label = F.col("label") if "label" in df.columns else F.lit(None).cast("int").alias("label")
    return df.select(
        label,
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("idx"),
                                     F.col(f).cast("double").alias("value"))
                            for i, f in enumerate(features)])).alias("kv"),
    ).select("label", "kv.feature", "kv.idx", "kv.value")


def feature_ranges(df: DataFrame, features: list[str] = FEATURE_NAMES) -> DataFrame:
    """Min / mean / max of every feature, one row per feature."""
    aggs = []
    for f in features:
        aggs += [F.min(f).cast("double").alias(f"{f}__min"), exact_mean(F.col(f)).alias(f"{f}__mean"),
                 F.max(f).cast("double").alias(f"{f}__max")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__min").alias("min"),
                 round_fixed(F.col(f"{f}__mean"), 6).alias("mean"), F.col(f"{f}__max").alias("max"))
        for f in features])).alias("r")).select("r.*")


def value_frequencies(df: DataFrame, features: list[str] = FEATURE_NAMES) -> DataFrame:
    """(feature, idx, value, n): distinct values per feature with counts."""
    return _long(df, features).groupBy("feature", "idx", "value").agg(F.count(F.lit(1)).alias("n"))


def feature_profile(df: DataFrame, features: list[str] = FEATURE_NAMES,
                    quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample std, min, linear-interpolated quartiles, max.

    Works on the (feature, value, count) frequency table: running counts
    come from a range partitioning of (feature, value) (balanced even for a
    feature with very many distinct values), totals and means from a
    30-row aggregate broadcast back, and one aggregate per feature picks the
    order statistics and sums squared deviations.  Quantiles are exact
    (linear interpolation between order statistics).
    """
    freq = value_frequencies(df, features)
    # running counts read one materialised copy of the frequency table; the
    # per-feature totals come from that same copy (no second evaluation of
    # the input)
    cum = running_sums(freq, ["feature"], [F.col("value").asc()], ["n"], inclusive=True)
    totals = F.broadcast(cum.groupBy("feature").agg(  # one row per feature
        F.sum("n").alias("cnt"),
        (# 10^15 rows of one value and twelve digits before the point fit exactly
        F.sum(F.col("n").cast("decimal(15,0)") * F.col("value").cast("decimal(22,10)")).cast("double")
         / F.sum("n")).alias("_mean")))
    cum = cum.join(totals, "feature").withColumnRenamed("cum_n", "cum_end")
    aggs = [F.first("idx").alias("idx"), F.first("cnt").alias("count"), F.first("_mean").alias("_mean"),
            F.sum(F.col("n") * (F.col("value") - F.col("_mean")) ** 2).alias("_ss"),
            F.min("value").alias("min"), F.max("value").alias("max")]
    for q in quantiles:
        pos = (F.col("cnt") - 1) * F.lit(q)
        lo, hi = F.floor(pos), F.ceil(pos)
        tag = int(round(q * 1000))
        aggs += [F.min(F.when(F.col("cum_end") > lo, F.col("value"))).alias(f"lo_{tag}"),
                 F.min(F.when(F.col("cum_end") > hi, F.col("value"))).alias(f"hi_{tag}"),
                 F.first(pos - lo).alias(f"frac_{tag}")]
    qs = cum.groupBy("feature").agg(*aggs)
    qcols = []
    for q in quantiles:
        tag = int(round(q * 1000))
        lo, hi, fr = F.col(f"lo_{tag}"), F.col(f"hi_{tag}"), F.col(f"frac_{tag}")
        qcols.append(round_fixed(lo + (hi - lo) * fr, 6).alias(f"p{int(round(q * 100))}"))
    std = F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1)))
    return qs.select("feature", "idx", F.col("count").cast("long").alias("count"),
                     round_fixed(F.col("_mean"), 6).alias("mean"), round_fixed(std, 6).alias("std"), "min", *qcols, "max")


def class_distribution(df: DataFrame) -> DataFrame:
    """Rows per label and share of the total."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the grouped table: one row per label
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("label", F.col("n").cast("long").alias("n"), round_fixed(F.col("n") / total, 6).alias("share"))


# --- D9-D11: histogram and correlations ------------------------------------------

def class_histogram(df: DataFrame, feature: str, bins: int = 30) -> DataFrame:
    """Per-class histogram of ``feature`` with ``bins`` equal bins over
    each class's own min..max (last bin closed; a constant class gets the
    range widened by 0.5 on both sides).  Empty bins are included."""
    v = F.col(feature).cast("double")
    rng = df.groupBy("label").agg(F.min(v).alias("mn"), F.max(v).alias("mx"))
    rng = rng.select(
        "label",
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    # one row per class: bounded by the number of labels
    rng = F.broadcast(rng)
    b = F.least(F.floor(F.lit(float(bins)) * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))),
                F.lit(bins - 1))
    counts = (df.select("label", v.alias("v")).join(rng, "label")
              .select("label", b.cast("int").alias("bin"))
              .groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = rng.select("label", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (grid.join(counts, ["label", "bin"], "left")
            .select("label", "bin",
                    round_fixed(F.col("lo") + F.col("bin") * width, 6).alias("bin_lo"),
                    round_fixed(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def _pearson(a: Column, b: Column) -> Column:
    den = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(den > 0, F.covar_pop(a, b) / den)


def label_correlation(df: DataFrame, features: list[str] = FEATURE_NAMES) -> DataFrame:
    """Pearson correlation of every feature with the label (null for a
    constant feature), one global aggregate, rounded to 6 places."""
    y = F.col("label").cast("double")
    wide = df.agg(*[_pearson(F.col(f).cast("double"), y).alias(f) for f in features])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(i).alias("idx"), round_fixed(F.col(f), 6).alias("corr"))
        for i, f in enumerate(features)])).alias("r")).select("r.*")


def top_correlated(df: DataFrame, k: int = 12, features: list[str] = FEATURE_NAMES) -> list[str]:
    """Names of the k features with the largest |corr| with the label (ties
    by feature order; constant features last).  Returns <= 30 names."""
    rows = (label_correlation(df, features)
            .orderBy(F.abs("corr").desc_nulls_last(), F.col("idx")).limit(k).collect())
    return [r["feature"] for r in rows]


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Pairwise Pearson correlations among ``features``, long form
    (f1, f2, r); one pass over the data."""
    x = {f: F.col(f).cast("double") for f in features}
    aggs = []
    pairs = []
    for i, a in enumerate(features):
        for j, b in enumerate(features):
            if j < i:
                continue
            aggs.append(_pearson(x[a], x[b]).alias(f"c_{i}_{j}"))
            pairs.append((i, j))
    wide = df.agg(*aggs)
    cells = []
    for i, j in pairs:
        cells.append(F.struct(F.lit(features[i]).alias("f1"), F.lit(features[j]).alias("f2"),
                              round_fixed(F.col(f"c_{i}_{j}"), 6).alias("r")))
        if i != j:
            cells.append(F.struct(F.lit(features[j]).alias("f1"), F.lit(features[i]).alias("f2"),
                                  round_fixed(F.col(f"c_{i}_{j}"), 6).alias("r")))
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _correlation(n: float, sx: float, sy: float, sxx: float, syy: float, sxy: float) -> float | None:
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return (n * sxy - sx * sy) / math.sqrt(vx * vy) if vx > 0 and vy > 0 else None


#: Scaled values below this are split into halves whose products of a slice
#: of rows fit 64 bits; larger ones are added up as Python integers.
_HALF, _GRAM_ROWS = 22, 4096


def _gram(batches):
    """Upper triangle of the Gram matrix of a task's rows, scaled by 10^6, as
    (i, j, sum); the first column is one, so its row holds the plain sums."""
    import numpy as np
    import pyarrow as pa

    total = None
    for batch in batches:
        whole = np.rint(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) * 1e6)
        for start in range(0, len(whole), _GRAM_ROWS):
            x = whole[start:start + _GRAM_ROWS]
            if np.abs(x).max() < 1 << (2 * _HALF):
                x = x.astype(np.int64)
                high, low = x >> _HALF, x & ((1 << _HALF) - 1)
                mixed = high.T @ low
                part = ((high.T @ high).astype(object) << (2 * _HALF)) + ((mixed + mixed.T).astype(object) << _HALF) + (low.T @ low).astype(object)
            else:
                x = np.array([[int(v) for v in row] for row in x], dtype=object)
                part = x.T @ x
            total = part if total is None else total + part
    if total is not None:
        cells = [(i, j, Decimal(int(total[i, j]))) for i in range(len(total)) for j in range(i, len(total))]
        i, j, s = zip(*cells)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s, pa.decimal128(38, 0))], names=["i", "j", "s"])


def top_correlation_matrix(df: DataFrame, k: int = 12, features: list[str] = FEATURE_NAMES) -> DataFrame:
    """D10 and D11 from one pass: (f1, f2, r) for the ``k`` features of
    largest |correlation| with the label (ties by feature order, constant
    features last).

    Each task adds up the Gram matrix of its rows in whole numbers (values
    times 10^6), which is exact, so the product form loses nothing to
    cancellation; the (features + 1)^2 / 2 sums of a task are then summed by
    Spark, and as many reach the driver, whatever the input.
    """
    names = [*features, "label"]
    ship_package(df.sparkSession)
    columns = df.select(F.lit(1.0).alias("one"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(names)])
    found = columns.mapInArrow(_gram, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    unit = 10 ** 12  # two values of 10^6
    gram = {(r["i"], r["j"]): Fraction(int(r["s"]), unit) for r in found}
    n = gram.get((0, 0), 0)
    sums = {c: gram.get((0, i), Fraction(0)) for i, c in enumerate(names, 1)}
    products = {(x, y): gram.get((i, j), Fraction(0)) for i, x in enumerate(names, 1) for j, y in enumerate(names, 1) if j >= i}
    order = {c: i for i, c in enumerate(names)}

    def r(a: str, b: str) -> float | None:
        a, b = sorted((a, b), key=order.get)
        return _correlation(n, sums[a], sums[b], products[a, a], products[b, b], products[a, b])

    with_label = {f: r(f, "label") for f in features}
    rank = lambda f: (with_label[f] is None, -abs(round(with_label[f] or 0, 6)), order[f])
    top = sorted(features, key=rank)[:k]
    cells = [(a, b, r(a, b)) for a in top for b in top]
    table = df.sparkSession.createDataFrame(cells, "f1 string, f2 string, r double")
    return table.select("f1", "f2", round_fixed(F.col("r"), 6).alias("r"))


# --- M4, M6, M7: weights, split, folds ------------------------------------------

def class_weights(df: DataFrame) -> DataFrame:
    """M4: balanced weight n / (k * n_c) per label."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    # windows over the grouped table: one row per label
    everything = Window.partitionBy()
    n, k = F.sum("n_c").over(everything), F.count(F.lit(1)).over(everything)
    return counts.select("label", F.col("n_c").cast("long").alias("n"), (n / (k * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, col: str = "weight") -> DataFrame:
    """Attach the balanced class weight (the weights table has one row per
    label and is broadcast)."""
    w = class_weights(df).select("label", F.col("weight").alias(col))
    return df.join(F.broadcast(w), "label")


def file_id(df: DataFrame, id_col: str | Sequence[str] | None = None) -> list[str]:
    """The columns that name a row: those given, or (repo, path) as far as
    ``df`` has them."""
    if id_col is None:
        return [c for c in ("repo", "path") if c in df.columns]
    return [id_col] if isinstance(id_col, str) else list(id_col)


def _joined(ids: list[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids])


def stratified_rank(df: DataFrame, id_col: str | Sequence[str] | None = None, seed: str = DEFAULT_SEED,
                    buckets: int | None = None) -> DataFrame:
    """Adds ``rank`` (1-based, per label) in the seeded order (md5 key of
    the id columns joined, then those columns) and ``n_label``.  Exact, and
    no task ever holds more than one hash bucket of one class: ``buckets``
    follows the session's shuffle partitions.  The id columns together must
    name a row; equal paths of different repos are different rows.

    Rows are shuffled once by (label, bucket) and ranked inside the bucket;
    bucket sizes come from that same windowed stream (the shuffle is reused,
    the input is computed once), and their running offsets form a table of
    at most 2 x buckets rows that is broadcast back.
    """
    ids = file_id(df, id_col)
    buckets = buckets or max(RANK_BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = md5_order_key(_joined(ids), seed)
    bits = max(1, (buckets - 1).bit_length())
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.shiftright(F.col("_key"), 32 - bits))
    w = Window.partitionBy("label", "_bucket").orderBy("_key", *ids)
    local = keyed.withColumn("_local", F.row_number().over(w))
    sizes = local.groupBy("label", "_bucket").agg(F.max("_local").alias("_bn"))
    wcum = Window.partitionBy("label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wtot = Window.partitionBy("label")
    offsets = sizes.select(
        "label", "_bucket",
        F.coalesce(F.sum("_bn").over(wcum), F.lit(0)).alias("_offset"),
        F.sum("_bn").over(wtot).alias("n_label"))
    ranked = local.join(F.broadcast(offsets), ["label", "_bucket"])
    return (ranked.withColumn("rank", F.col("_offset") + F.col("_local"))
            .drop("_key", "_bucket", "_offset", "_local"))


def stratified_split(df: DataFrame, id_col: str | Sequence[str] | None = None, test_size: float = 0.2, seed: str = DEFAULT_SEED,
                     buckets: int | None = None) -> DataFrame:
    """M6: ``split`` = 'test' for the first round(test_size * n_label) rows
    of each class in the seeded order, else 'train'."""
    r = stratified_rank(df, id_col, seed, buckets)
    n_test = F.round(F.lit(float(test_size)) * F.col("n_label"), 0)
    return (r.withColumn("split", F.when(F.col("rank") <= n_test, F.lit("test")).otherwise(F.lit("train")))
            .drop("rank", "n_label"))


def stratified_folds(df: DataFrame, id_col: str | Sequence[str] | None = None, k: int = 5, seed: str = DEFAULT_SEED,
                     buckets: int | None = None) -> DataFrame:
    """M7: ``fold`` = (rank - 1) mod k within each class."""
    r = stratified_rank(df, id_col, seed, buckets)
    return r.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("rank", "n_label")


def hash_split(df: DataFrame, id_col: str | Sequence[str] | None = None, test_size: float = 0.2, seed: str = DEFAULT_SEED) -> DataFrame:
    """M6, approximate variant for scale: a row is 'test' when its md5
    uniform is below ``test_size`` -- a per-row test with no ranking and no
    shuffle; class shares of the test set are test_size only in
    expectation."""
    u = md5_unit(_joined(file_id(df, id_col)), seed)
    return df.withColumn("split", F.when(u < F.lit(float(test_size)), F.lit("test")).otherwise(F.lit("train")))
