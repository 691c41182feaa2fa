"""Risk levels, flags, factors and reports over a scored
file table ``(path, score, error, <features>)``.

``score`` is P(buggy) from a model (``riskfold.operators.train.score_files``)
or any other scorer; rows with a null score are files that failed analysis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.functions.columns import exact_mean, round_fixed
from riskfold.functions.ordering import global_positions
from riskfold.schema import REPORT_FEATURES

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results).
RISK_THRESHOLDS = {"low": 0.3, "medium": 0.6, "high": 0.8}
FLAG_THRESHOLD = 0.6
HISTOGRAM_BINS = 30
# ---------------------------------------------------------------------------


def _repo(df: DataFrame) -> list[Column]:
    """A file is known by repo and path; tables of a single tree may have no repo."""
    return [F.col("repo")] if "repo" in df.columns else []


def risk_level(score: Column, thresholds: dict = RISK_THRESHOLDS) -> Column:
    """Low / Medium / High / Critical on the unrounded score; 'Error'
    when there is no score."""
    return (F.when(score.isNull(), F.lit("Error"))
            .when(score < thresholds.get("low", 0.3), F.lit("Low"))
            .when(score < thresholds.get("medium", 0.6), F.lit("Medium"))
            .when(score < thresholds.get("high", 0.8), F.lit("High"))
            .otherwise(F.lit("Critical")))


def risk_report(scored: DataFrame, threshold: float = FLAG_THRESHOLD,
                thresholds: dict = RISK_THRESHOLDS) -> DataFrame:
    """file_path, risk_score (rounded to 4, half-even),
    risk_level, flagged (score >= threshold, unrounded), error."""
    s = F.col("score")
    return scored.select(
        *_repo(scored), F.col("path").alias("file_path"),
        F.bround(s, 4).alias("risk_score"),
        risk_level(s, thresholds).alias("risk_level"),
        F.when(s.isNotNull(), s >= F.lit(threshold)).alias("flagged"),
        F.col("error"),
    )


def top_factor_names(importances: DataFrame, n: int = 3) -> list[tuple[str, float]]:
    """The ``n`` most important features (ties by feature order) from an
    importance table (feature, idx, importance) with one row per feature."""
    rows = importances.orderBy(F.col("importance").desc(), F.col("idx").asc()).limit(n).collect()
    return [(r["feature"], float(r["importance"])) for r in rows]


def top_factors(factors: list[tuple[str, float]]) -> Column:
    """array<struct<feature, value, importance>> of the globally most
    important features with this file's values (the same names for every
    file; ranking is by importance only)."""
    return F.array(*[F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("value"),
                              F.lit(imp).alias("importance")) for name, imp in factors])


def scored_report(scored: DataFrame, factors: list[tuple[str, float]] | None = None,
                  threshold: float = FLAG_THRESHOLD) -> DataFrame:
    """The nested per-file report (S7 shape): risk columns, top factors,
    features struct without syntax_error, error."""
    s = F.col("score")
    cols = [*_repo(scored), F.col("path").alias("file_path"), F.bround(s, 4).alias("risk_score"),
            risk_level(s).alias("risk_level"),
            F.when(s.isNotNull(), s >= F.lit(threshold)).alias("flagged")]
    if factors is not None:
        cols.append(top_factors(factors).alias("top_factors"))
    cols.append(F.struct(*[F.col(f) for f in REPORT_FEATURES]).alias("features"))
    cols.append(F.col("error"))
    return scored.select(*cols)


def flat_report(scored: DataFrame, threshold: float = FLAG_THRESHOLD, with_error: bool = False) -> DataFrame:
    """The flat CSV form -- file_path, risk_score, risk_level, flagged
    and the 29 report features, projected straight from the scored table."""
    s = F.col("score")
    extra = [F.col("error")] if with_error and "error" in scored.columns else []
    return scored.select(
        *_repo(scored), F.col("path").alias("file_path"), F.bround(s, 4).alias("risk_score"), risk_level(s).alias("risk_level"),
        F.when(s.isNotNull(), s >= F.lit(threshold)).alias("flagged"), *REPORT_FEATURES, *extra)


def ranked_report(scored: DataFrame, slices: int | None = None) -> DataFrame:
    """P5: repo, path, score and 1-based ``rank`` of every file, by score
    (descending; error rows count as 0; ties by repo and path).  Exact global
    ranks from a range partitioning on (score, repo, path) -- balanced even
    when many files share a score -- plus per-slice offsets; no global window.
    Only these columns are sorted and written; join others by (repo, path)."""
    key = F.coalesce(F.col("score"), F.lit(0.0))
    narrow = scored.select(*_repo(scored), "path", "score")
    return global_positions(narrow, [key.desc(), *[c.asc() for c in _repo(scored)], F.col("path").asc()], "rank", slices)


def top_risk(scored: DataFrame, k: int) -> DataFrame:
    """P5 top-k: the k riskiest files (a per-task top-k, then a merge)."""
    key = F.coalesce(F.col("score"), F.lit(0.0))
    return scored.orderBy(key.desc(), *[c.asc() for c in _repo(scored)], F.col("path").asc()).limit(k)


def report_footer(scored: DataFrame, threshold: float = FLAG_THRESHOLD) -> DataFrame:
    """Files analysed and flagged."""
    return scored.agg(
        F.count(F.lit(1)).cast("long").alias("n_files"),
        F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0)).cast("long").alias("n_flagged"))


def batch_summary(scored: DataFrame) -> DataFrame:
    """Valid files, mean score, High+Critical count, Low count."""
    s = F.col("score")
    lvl = risk_level(s)
    return scored.where(s.isNotNull()).agg(
        F.count(F.lit(1)).cast("long").alias("n_valid"),
        round_fixed(exact_mean(s), 6).alias("mean_score"),
        F.sum(F.when(lvl.isin("High", "Critical"), 1).otherwise(0)).cast("long").alias("n_high_critical"),
        F.sum(F.when(lvl == "Low", 1).otherwise(0)).cast("long").alias("n_low"))


def batch_rows(scored: DataFrame) -> DataFrame:
    """Filename, risk_score (unrounded), risk_level, lines,
    complexity, docstring_cov; error rows carry zeros and their message."""
    err = F.col("score").isNull()
    return scored.select(
        *_repo(scored), F.col("path").alias("filename"), F.col("score").alias("risk_score"),
        risk_level(F.col("score")).alias("risk_level"),
        F.when(err, F.lit(0)).otherwise(F.col("total_lines")).cast("int").alias("lines"),
        F.when(err, F.lit(0)).otherwise(F.col("cyclomatic_complexity")).cast("int").alias("complexity"),
        F.when(err, F.lit(0.0)).otherwise(F.col("docstring_coverage")).cast("double").alias("docstring_cov"),
        F.col("error"))


def batch_csv_rows(scored: DataFrame) -> DataFrame:
    """Valid rows only, riskiest first."""
    return (batch_rows(scored).where(F.col("risk_score").isNotNull()).drop("error")
            .orderBy(F.col("risk_score").desc(), *_repo(scored), F.col("filename")))


def risk_histogram(scored: DataFrame, bins: int = HISTOGRAM_BINS, thresholds: dict = RISK_THRESHOLDS) -> DataFrame:
    """P10: equal-width histogram of valid scores over their own range
    (last bin closed; a constant range is widened by 0.5), with the zone of
    each bin's left edge.  Empty bins included."""
    s = F.col("score")
    valid = scored.where(s.isNotNull()).select(s.alias("v"))
    rng = valid.agg(F.min("v").alias("mn"), F.max("v").alias("mx")).select(
        F.lit(0).alias("_g"),
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    rng = F.broadcast(rng)  # a single row
    b = F.least(F.floor(F.lit(float(bins)) * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))),
                F.lit(bins - 1)).cast("int")
    counts = (valid.withColumn("_g", F.lit(0)).join(rng, "_g").select(b.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    left = F.col("lo") + F.col("bin") * width
    grid = rng.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    zone = (F.when(left < thresholds["low"], "Low").when(left < thresholds["medium"], "Medium")
            .when(left < thresholds["high"], "High").otherwise("Critical"))
    return (grid.join(counts, "bin", "left")
            .select("bin", round_fixed(left, 6).alias("bin_lo"), round_fixed(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("bin_hi"),
                    zone.alias("zone"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))
