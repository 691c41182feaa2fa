"""Declared schemas and fixed values.

Nothing here is inferred at read time: every table the library produces or
consumes has a declared ``StructType``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results).
# Feature names in model-vector order.
FEATURE_NAMES: list[str] = [
    "total_lines", "code_lines", "blank_lines", "comment_lines",
    "comment_ratio", "num_functions", "num_classes", "num_methods",
    "avg_function_length", "max_function_length", "num_imports",
    "num_unique_imports", "cyclomatic_complexity", "max_nesting_depth",
    "avg_nesting_depth", "num_branches", "num_loops", "num_try_except",
    "num_assertions", "num_lambda_functions", "has_docstrings",
    "docstring_coverage", "has_type_hints", "type_hint_coverage",
    "avg_identifier_length", "num_global_variables", "num_nested_functions",
    "num_return_statements", "uses_star_import", "syntax_error",
]

# Features stored as DOUBLE; all others are INT.
DOUBLE_FEATURES: frozenset[str] = frozenset({
    "comment_ratio", "avg_function_length", "avg_nesting_depth",
    "docstring_coverage", "type_hint_coverage", "avg_identifier_length",
})
# ---------------------------------------------------------------------------

INT_FEATURES: list[str] = [f for f in FEATURE_NAMES if f not in DOUBLE_FEATURES]

LINE_FEATURES: list[str] = [
    "total_lines", "code_lines", "blank_lines", "comment_lines", "comment_ratio",
]

# Value of each feature for a file that has no syntax nodes (empty file,
# syntax error, parse failure).  Cyclomatic complexity starts at one.
FEATURE_DEFAULTS: dict[str, float] = {
    f: (0.0 if f in DOUBLE_FEATURES else 0) for f in FEATURE_NAMES
}
FEATURE_DEFAULTS["cyclomatic_complexity"] = 1


def feature_type(name: str) -> T.DataType:
    return T.DoubleType() if name in DOUBLE_FEATURES else T.IntegerType()


FEATURE_STRUCT = T.StructType([T.StructField(f, feature_type(f), False) for f in FEATURE_NAMES])

SOURCE_FILES = T.StructType([
    T.StructField("repo", T.StringType(), True),
    T.StructField("path", T.StringType(), False),
    T.StructField("source", T.StringType(), True),
])

# One row per syntax node *or* per file (kind = 'file' | 'node'): the parse
# pass writes both in one stream so a file is parsed exactly once.
PARSED = T.StructType([
    T.StructField("repo", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("kind", T.StringType(), False),
    # node columns
    T.StructField("node_id", T.IntegerType(), True),
    T.StructField("parent_id", T.IntegerType(), True),
    T.StructField("node_type", T.StringType(), True),
    T.StructField("lineno", T.IntegerType(), True),
    T.StructField("end_lineno", T.IntegerType(), True),
    T.StructField("at_module_level", T.BooleanType(), True),
    T.StructField("block_depth", T.IntegerType(), True),
    T.StructField("block_depth_sync", T.IntegerType(), True),
    T.StructField("class_depth", T.IntegerType(), True),
    T.StructField("func_depth", T.IntegerType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("bool_operands", T.IntegerType(), True),
    T.StructField("n_aliases", T.IntegerType(), True),
    T.StructField("import_roots", T.ArrayType(T.StringType()), True),
    T.StructField("new_import_roots", T.IntegerType(), True),
    T.StructField("is_star", T.BooleanType(), True),
    T.StructField("has_docstring", T.BooleanType(), True),
    T.StructField("n_args", T.IntegerType(), True),
    T.StructField("n_annotated", T.IntegerType(), True),
    # file columns
    T.StructField("total_lines", T.IntegerType(), True),
    T.StructField("blank_lines", T.IntegerType(), True),
    T.StructField("comment_lines", T.IntegerType(), True),
    T.StructField("syntax_error", T.IntegerType(), True),
    T.StructField("error", T.StringType(), True),
    # a number of the input row: two files of one (repo, path) stay two
    T.StructField("file_id", T.LongType(), True),
])

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results).
# Node types that add one decision point to cyclomatic complexity.
COMPLEXITY_NODES = ["If", "For", "While", "ExceptHandler", "With", "Assert", "comprehension", "IfExp"]
FUNCTION_NODES = ["FunctionDef", "AsyncFunctionDef"]
AVG_DEPTH_BLOCK_NODES = ["If", "For", "While", "With", "Try", "FunctionDef", "AsyncFunctionDef", "ClassDef"]
LOOP_NODES = ["For", "While", "AsyncFor"]
GLOBAL_ASSIGN_NODES = ["Assign", "AnnAssign", "AugAssign"]
# ---------------------------------------------------------------------------

# What the features read of a file's nodes: sums that count nodes of some
# types, other sums, and maxima.
NODE_COUNTS: dict[str, list[str]] = {
    "num_classes": ["ClassDef"], "n_funcs": FUNCTION_NODES, "decisions": COMPLEXITY_NODES, "n_sync_blocks": AVG_DEPTH_BLOCK_NODES,
    "num_branches": ["If"], "num_loops": LOOP_NODES, "num_try_except": ["Try"], "num_assertions": ["Assert"],
    "num_lambda_functions": ["Lambda"], "num_return_statements": ["Return"],
}
NODE_SUMS = [
    *NODE_COUNTS, "num_methods", "sum_fn_len", "num_imports", "num_unique_imports", "sum_sync_depth", "module_doc", "funcs_with_doc",
    "n_args", "n_annotated", "sum_ident_len", "n_idents", "num_global_variables", "num_nested_functions",
]
NODE_MAXIMA = ["max_fn_len", "max_depth", "uses_star_import"]

# One row per file with its nodes added up.
SUMMED = T.StructType([
    T.StructField("repo", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("file_id", T.LongType(), True),
    *[T.StructField(c, T.LongType(), True) for c in (*NODE_SUMS, *NODE_MAXIMA)],
    T.StructField("total_lines", T.IntegerType(), True),
    T.StructField("blank_lines", T.IntegerType(), True),
    T.StructField("comment_lines", T.IntegerType(), True),
    T.StructField("syntax_error", T.IntegerType(), True),
    T.StructField("error", T.StringType(), True),
])

NODE_COLUMNS = [
    "repo", "path", "node_id", "parent_id", "node_type", "lineno", "end_lineno",
    "at_module_level", "block_depth", "block_depth_sync", "class_depth", "func_depth",
    "name", "bool_operands", "n_aliases", "import_roots", "new_import_roots", "is_star",
    "has_docstring", "n_args", "n_annotated",
]
FILE_COLUMNS = ["repo", "path", "total_lines", "blank_lines", "comment_lines", "syntax_error", "error"]

COMMITS = T.StructType([
    T.StructField("repo", T.StringType(), False),
    T.StructField("commit_id", T.StringType(), False),
    T.StructField("message", T.StringType(), True),
    T.StructField("authored_at", T.TimestampType(), True),
    T.StructField("committed_at", T.TimestampType(), True),
    T.StructField("n_parents", T.IntegerType(), True),
])

COMMIT_FILES = T.StructType([
    T.StructField("repo", T.StringType(), False),
    T.StructField("commit_id", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
])

FEATURE_TABLE = T.StructType(
    [T.StructField(f, T.DoubleType(), True) for f in FEATURE_NAMES]
    + [T.StructField("label", T.IntegerType(), True)]
)

REPORT_FEATURES = [f for f in FEATURE_NAMES if f != "syntax_error"]

_RISK = [
    T.StructField("repo", T.StringType(), True),
    T.StructField("file_path", T.StringType(), True),
    T.StructField("risk_score", T.DoubleType(), True),
    T.StructField("risk_level", T.StringType(), True),
    T.StructField("flagged", T.BooleanType(), True),
]

# The nested report
REPORT = T.StructType([
    *_RISK,
    T.StructField("top_factors", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType(), True),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("importance", T.DoubleType(), True),
    ])), True),
    T.StructField("features", T.StructType([T.StructField(f, feature_type(f), True) for f in REPORT_FEATURES]), True),
    T.StructField("error", T.StringType(), True),
])

# Its flat form
FLAT_REPORT = T.StructType([*_RISK, *[T.StructField(f, feature_type(f), True) for f in REPORT_FEATURES]])

# The batch report
BATCH_REPORT = T.StructType([
    T.StructField("repo", T.StringType(), True),
    T.StructField("filename", T.StringType(), True),
    T.StructField("risk_score", T.DoubleType(), True),
    T.StructField("risk_level", T.StringType(), True),
    T.StructField("lines", T.IntegerType(), True),
    T.StructField("complexity", T.IntegerType(), True),
    T.StructField("docstring_cov", T.DoubleType(), True),
])
