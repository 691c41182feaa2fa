"""Composed jobs: the public entry points, built only from the operators.

    corpus scoring:  scan -> extract_features -> score -> report
    training:        build_dataset -> train (split, CV, fit, test, select)
    mining:          mine_dataset (history and file limits if asked for, labels, features)
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.operators import dataset as ds
from riskfold.operators import evaluate as ev
from riskfold.operators import explain as xp
from riskfold.operators import features as feat
from riskfold.operators import labels as lab
from riskfold.operators import score as sc
from riskfold.operators import train as tr
from riskfold.session import cut_lineage
from riskfold.sources.generate import generate_dataset as _generate


def extract_features(sources: DataFrame, source_col: str = "source") -> DataFrame:
    """Per-file features (repo, path, error, 30 features)."""
    return feat.extract_features(sources, source_col)


def label_files(files: DataFrame, commits: DataFrame, commit_files: DataFrame, as_of: str,
                max_files: int | None = None, cap: int | None = None,
                depth: int | None = None) -> DataFrame:
    """(repo, path, label) from commit history."""
    return lab.label_files(files, commits, commit_files, as_of, max_files=max_files, cap=cap, depth=depth)


def mine_dataset(sources: DataFrame, commits: DataFrame, commit_files: DataFrame, as_of: str,
                 source_col: str = "source", max_files: int | None = None, cap: int | None = None,
                 depth: int | None = None) -> DataFrame:
    """The mining flow: labels from bug fixes (over the newest ``depth``
    commits, ``cap`` fixes and ``max_files`` files of a repo, if given),
    features of the labelled files (files that fail analysis are dropped),
    aligned to the model schema."""
    tree = sources.select("repo", "path")
    labels = lab.label_files(tree, commits, commit_files, as_of, max_files=max_files, cap=cap, depth=depth)
    labelled_sources = sources.join(labels.select("repo", "path"), ["repo", "path"], "left_semi")
    features = feat.extract_features(labelled_sources, source_col)
    return ds.align(ds.attach_labels(features, labels), keep=("repo", "path"))


def build_dataset(spark: SparkSession, features: DataFrame | None = None, labels: DataFrame | None = None,
                  n_synthetic: int = 2500, buggy_ratio: float = 0.35, seed: str = "42") -> DataFrame:
    """Labelled feature table from mined tables when they give any rows,
    otherwise the generated table.  The mined table is written once, so the
    look for a row does not parse the sources a second time."""
    if features is not None and labels is not None:
        mined = cut_lineage(ds.align(ds.attach_labels(features, labels), keep=("repo", "path")), "mined")
        if not mined.isEmpty():
            return mined
    g = _generate(spark, n_synthetic, buggy_ratio, seed)
    return g.withColumn("path", F.concat(F.lit("synthetic/"), F.col("id")))


def generate_dataset(spark: SparkSession, n: int = 2500, buggy_ratio: float = 0.35, seed: str = "42") -> DataFrame:
    return _generate(spark, n, buggy_ratio, seed)


def train(dataset: DataFrame, model_names: list[str] | None = None, **kwargs: Any) -> dict[str, Any]:
    return tr.run_training(dataset, model_names, **kwargs)


def evaluate(predictions: DataFrame, by: list[str] = ()) -> dict[str, DataFrame]:
    return {
        "metrics": ev.fold_metrics(predictions, list(by)),
        "report": ev.classification_report(predictions, list(by)),
        "confusion": ev.normalized_confusion(predictions, list(by)),
        "roc": ev.roc_curve(predictions, list(by)),
    }


def score(sources: DataFrame, model, source_col: str = "source") -> DataFrame:
    """Scored files (features + score) for a source table."""
    return tr.score_files(model, feat.extract_features(sources, source_col))


def report(scored: DataFrame, model=None, threshold: float = sc.FLAG_THRESHOLD) -> dict[str, DataFrame]:
    factors = None
    if model is not None:
        factors = sc.top_factor_names(tr.feature_importance(model, scored.sparkSession), 3)
    return {
        "report": sc.scored_report(scored, factors, threshold),
        "table": sc.flat_report(scored, threshold),
        "ranked": sc.ranked_report(scored),
        "footer": sc.report_footer(scored, threshold),
        "summary": sc.batch_summary(scored),
        "batch": sc.batch_csv_rows(scored),
        "histogram": sc.risk_histogram(scored),
    }


def explain(features: DataFrame) -> dict[str, DataFrame]:
    recs = xp.recommendations(features)
    return {
        "status": xp.feature_status(features),
        "recommendations": recs,
        "recommendation_counts": xp.recommendation_counts(recs),
        "radar": xp.radar_values(features),
    }


def profile(dataset: DataFrame, histogram_feature: str = "cyclomatic_complexity") -> dict[str, DataFrame]:
    return {
        "balance": ds.class_balance(dataset),
        "ranges": ds.feature_ranges(dataset),
        "describe": ds.feature_profile(dataset),
        "classes": ds.class_distribution(dataset),
        "histogram": ds.class_histogram(dataset, histogram_feature),
        "label_correlation": ds.label_correlation(dataset),
        "correlation_matrix": ds.top_correlation_matrix(dataset),
    }
