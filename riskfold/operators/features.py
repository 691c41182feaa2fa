"""The thirty per-file features as one Spark aggregate.

The aggregate runs over the parse stream grouped by (repo, path).  A file's
nodes come added up in its parse task, or one by one from the full relation;
either way the partial (map-side) aggregate leaves a single row a file before
the shuffle, and only one narrow row per file crosses the exchange.  Every expression is a built-in aggregate (sum / max), so the
whole stage stays inside whole-stage codegen with a fixed-width
hash-aggregate buffer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions.columns import ratio_round
from riskfold.operators.parse import parse_sums, scan_lines, sums_of
from riskfold.schema import DOUBLE_FEATURES, FEATURE_NAMES, NODE_MAXIMA, NODE_SUMS


def feature_aggregates(sums: DataFrame) -> DataFrame:
    """Intermediate per-file sums and counts (one row per file) of a stream of
    node sums."""
    # ``error`` is a grouping key rather than an aggregate: a file that
    # failed analysis has no node rows, so the key never splits a file, and
    # all buffers stay fixed-width (a string max would force a sort-based
    # aggregate over the whole node stream).
    return sums.groupBy("repo", "path", "file_id", "error").agg(
        *[F.max(c).alias(c) for c in ("total_lines", "blank_lines", "comment_lines", "syntax_error", *NODE_MAXIMA)],
        *[F.sum(c).alias(c) for c in NODE_SUMS])


def finish_features(agg: DataFrame, keep: tuple[str, ...] = ("repo", "path", "error")) -> DataFrame:
    """Turn the per-file sums into the 30 typed feature columns."""
    total = F.col("total_lines")
    code = F.greatest(total - F.col("blank_lines") - F.col("comment_lines"), F.lit(0))
    thc = ratio_round(F.col("n_annotated"), F.col("n_args"), 4)
    cols = {
        "total_lines": total,
        "code_lines": code,
        "blank_lines": F.col("blank_lines"),
        "comment_lines": F.col("comment_lines"),
        "comment_ratio": ratio_round(F.col("comment_lines"), F.greatest(total, F.lit(1)), 4),
        "num_functions": F.col("n_funcs") - F.col("num_methods"),
        "num_classes": F.col("num_classes"),
        "num_methods": F.col("num_methods"),
        "avg_function_length": ratio_round(F.col("sum_fn_len"), F.col("n_funcs"), 2),
        "max_function_length": F.col("max_fn_len"),
        "num_imports": F.col("num_imports"),
        "num_unique_imports": F.col("num_unique_imports"),
        "cyclomatic_complexity": F.col("decisions") + 1,
        "max_nesting_depth": F.col("max_depth"),
        "avg_nesting_depth": ratio_round(F.col("sum_sync_depth"), F.col("n_sync_blocks"), 2),
        "num_branches": F.col("num_branches"),
        "num_loops": F.col("num_loops"),
        "num_try_except": F.col("num_try_except"),
        "num_assertions": F.col("num_assertions"),
        "num_lambda_functions": F.col("num_lambda_functions"),
        "has_docstrings": F.when((F.col("module_doc") + F.col("funcs_with_doc")) > 0, 1).otherwise(0),
        "docstring_coverage": ratio_round(F.col("funcs_with_doc"), F.col("n_funcs"), 4),
        "has_type_hints": F.when(thc > 0, 1).otherwise(0),
        "type_hint_coverage": thc,
        "avg_identifier_length": ratio_round(F.col("sum_ident_len"), F.col("n_idents"), 2),
        "num_global_variables": F.col("num_global_variables"),
        "num_nested_functions": F.col("num_nested_functions"),
        "num_return_statements": F.col("num_return_statements"),
        "uses_star_import": F.col("uses_star_import"),
        "syntax_error": F.col("syntax_error"),
    }
    out = [F.col(k) for k in keep if k in agg.columns]
    for name in FEATURE_NAMES:
        typ = "double" if name in DOUBLE_FEATURES else "int"
        out.append(cols[name].cast(typ).alias(name))
    return agg.select(*out)


def extract_features(sources: DataFrame, source_col: str = "source") -> DataFrame:
    """``sources(repo, path, source)`` -> one row per file with the 30
    features plus ``error`` (non-null when the file could not be analysed;
    such rows still carry their line features)."""
    return finish_features(feature_aggregates(parse_sums(sources, source_col)))


def features_from_parsed(parsed: DataFrame) -> DataFrame:
    return finish_features(feature_aggregates(sums_of(parsed)))


def mining_features(features: DataFrame) -> DataFrame:
    """F29, mining form: files that failed analysis are dropped."""
    return features.where(F.col("error").isNull())


def node_type_counts(parsed: DataFrame) -> DataFrame:
    """Node-type histogram per file from the node relation (a corpus query
    over ``ast_nodes``)."""
    return (parsed.where(F.col("kind") == "node")
            .groupBy("repo", "path", "node_type").agg(F.count(F.lit(1)).cast("int").alias("n")))


def line_features(sources: DataFrame, source_col: str = "source") -> DataFrame:
    """F1-F5 without parsing: total, code, blank and comment lines and the
    comment ratio per file (the column-pruned path for consumers that need
    only line features)."""
    lines = scan_lines(sources, source_col)
    total = F.col("total_lines")
    return lines.select(
        "repo", "path", "error", total.alias("total_lines"),
        F.greatest(total - F.col("blank_lines") - F.col("comment_lines"), F.lit(0)).cast("int").alias("code_lines"),
        "blank_lines", "comment_lines",
        ratio_round(F.col("comment_lines"), F.greatest(total, F.lit(1)), 4).alias("comment_ratio"))
