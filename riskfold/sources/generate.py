"""Labelled feature-table generator.

Every value is a pure function of (row id, column, seed): uniforms come from
md5, normals from Box-Muller over two such uniforms.  The output therefore
does not depend on partitioning, task order or retries, and the generator
scales with the id source (``spark.range(n)`` or any table's keys).

Class assignment is exact: the first ``int(n * buggy_ratio)`` rows in the
seeded md5 order are buggy (ranked with the bucketed rank, so no task holds
all rows).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.functions.columns import md5_unit
from riskfold.operators.dataset import stratified_rank
from riskfold.schema import FEATURE_NAMES

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical distributions).
# Per column: (clean spec, buggy spec).  Specs:
#   ("int", a, b)        integer uniform on [a, b)
#   ("uni", a, b)        continuous uniform on [a, b)
#   ("times", col, a, b) other column times a uniform on [a, b)
#   ("bern", p)          1 with probability p, else 0
#   ("norm", mu, sd, lo, hi) normal clipped to [lo, hi]
#   ("const", v)
DISTRIBUTIONS = {
    "total_lines": (("int", 50, 300), ("int", 80, 600)),
    "code_lines": (("times", "total_lines", 0.55, 0.75), ("times", "total_lines", 0.7, 0.9)),
    "blank_lines": (("times", "total_lines", 0.1, 0.2), ("times", "total_lines", 0.03, 0.1)),
    "comment_lines": (("times", "total_lines", 0.1, 0.25), ("times", "total_lines", 0.0, 0.08)),
    "comment_ratio": (("ratio", "comment_lines", "total_lines"), ("ratio", "comment_lines", "total_lines")),
    "num_functions": (("int", 2, 15), ("int", 1, 25)),
    "num_classes": (("int", 0, 4), ("int", 0, 6)),
    "num_methods": (("times", "num_classes", 2, 8), ("times", "num_classes", 3, 12)),
    "avg_function_length": (("uni", 5, 25), ("uni", 20, 80)),
    "max_function_length": (("times", "avg_function_length", 1.5, 3.0), ("times", "avg_function_length", 2.0, 5.0)),
    "num_imports": (("int", 2, 12), ("int", 5, 25)),
    "num_unique_imports": (("times", "num_imports", 0.7, 1.0), ("times", "num_imports", 0.5, 0.9)),
    "cyclomatic_complexity": (("int", 1, 12), ("int", 10, 50)),
    "max_nesting_depth": (("int", 1, 4), ("int", 4, 10)),
    "avg_nesting_depth": (("times", "max_nesting_depth", 0.4, 0.8), ("times", "max_nesting_depth", 0.5, 0.9)),
    "num_branches": (("int", 0, 10), ("int", 8, 40)),
    "num_loops": (("int", 0, 6), ("int", 3, 20)),
    "num_try_except": (("int", 0, 4), ("int", 0, 8)),
    "num_assertions": (("int", 0, 5), ("int", 0, 3)),
    "num_lambda_functions": (("int", 0, 3), ("int", 0, 8)),
    "has_docstrings": (("bern", 0.8), ("bern", 0.35)),
    "docstring_coverage": (("norm", 0.72, 0.18, 0.0, 1.0), ("norm", 0.18, 0.18, 0.0, 1.0)),
    "has_type_hints": (("bern", 0.65), ("bern", 0.25)),
    "type_hint_coverage": (("norm", 0.60, 0.22, 0.0, 1.0), ("norm", 0.12, 0.15, 0.0, 1.0)),
    "avg_identifier_length": (("norm", 9.5, 2.5, 3.0, 20.0), ("norm", 5.5, 2.5, 1.0, 15.0)),
    "num_global_variables": (("int", 0, 3), ("int", 2, 15)),
    "num_nested_functions": (("int", 0, 2), ("int", 1, 10)),
    "num_return_statements": (("int", 1, 12), ("int", 0, 20)),
    "uses_star_import": (("bern", 0.05), ("bern", 0.4)),
    "syntax_error": (("const", 0.0), ("bern", 0.15)),
}
DEFAULT_SAMPLES = 2500
DEFAULT_BUGGY_RATIO = 0.35
# ---------------------------------------------------------------------------

NORMAL_COLUMNS = [c for c, (a, _) in DISTRIBUTIONS.items() if a[0] == "norm"]


def _u(idc: Column, seed: str, name: str) -> Column:
    return md5_unit(idc, f"{seed}-{name}")


def _value(spec: tuple, idc: Column, seed: str, name: str, done: dict[str, Column]) -> Column:
    kind = spec[0]
    if kind == "int":
        a, b = spec[1], spec[2]
        return (F.lit(float(a)) + F.floor(_u(idc, seed, name) * (b - a))).cast("double")
    if kind == "uni":
        a, b = spec[1], spec[2]
        return F.lit(float(a)) + _u(idc, seed, name) * (b - a)
    if kind == "times":
        base, a, b = spec[1], spec[2], spec[3]
        return done[base] * (F.lit(float(a)) + _u(idc, seed, name) * (b - a))
    if kind == "ratio":
        return done[spec[1]] / done[spec[2]]
    if kind == "bern":
        return F.when(_u(idc, seed, name) < spec[1], F.lit(1.0)).otherwise(F.lit(0.0))
    if kind == "norm":
        mu, sd, lo, hi = spec[1:]
        u1 = F.lit(1.0) - _u(idc, seed, name + "-a")   # (0, 1]
        u2 = _u(idc, seed, name + "-b")
        z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
        return F.least(F.greatest(F.lit(mu) + F.lit(sd) * z, F.lit(lo)), F.lit(hi))
    if kind == "const":
        return F.lit(float(spec[1]))
    raise ValueError(f"unknown distribution {spec!r}")


def synthesize(ids: DataFrame, id_col: str = "id", buggy_ratio: float = DEFAULT_BUGGY_RATIO,
               seed: str = "42") -> DataFrame:
    """One labelled synthetic feature row per id: (id, 30 DOUBLE features, label)."""
    base = ids.select(F.col(id_col).alias("id"), F.lit(0).alias("label"))
    ranked = stratified_rank(base, "id", seed=f"{seed}-class")
    n_buggy = F.floor(F.col("n_label") * F.lit(float(buggy_ratio)))
    labelled = ranked.select("id", F.when(F.col("rank") <= n_buggy, 1).otherwise(0).alias("label"))
    idc = F.col("id")
    is_buggy = F.col("label") == 1
    done: dict[str, Column] = {}
    for name in FEATURE_NAMES:
        clean, buggy = DISTRIBUTIONS[name]
        done[name] = F.when(is_buggy, _value(buggy, idc, seed, name, done)).otherwise(
            _value(clean, idc, seed, name, done))
    return labelled.select("id", *[done[n].alias(n) for n in FEATURE_NAMES], F.col("label").cast("int").alias("label"))


def generate_dataset(spark: SparkSession, n: int = DEFAULT_SAMPLES, buggy_ratio: float = DEFAULT_BUGGY_RATIO,
                     seed: str = "42", partitions: int | None = None) -> DataFrame:
    """``n`` generated rows (ids 0..n-1); partitions default to the session's
    parallelism."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(0, n)
    return synthesize(ids, "id", buggy_ratio, seed)
