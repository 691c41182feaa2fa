"""Projections of the driver's tables into this library's inputs.

The driver tables hold no Python source and no commit history, so these
derive them deterministically with Spark SQL (the oracle computes the same
answers from the base tables):

* T1 ``source_files`` from ``part`` (generated Python modules),
* T2 ``commits`` / ``commit_files`` from ``orders`` and ``lineitem``,
* T4 ``predictions`` from ``part``,
* T5 ``documents`` as raw (non-Python) sources.

All joins against ``nation`` broadcast it: it is a fixed 25-row dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-07-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


# One generated module per part key k with size z.
_T1_SOURCE = """
concat(concat_ws('\\n', flatten(array(
  transform(filter(sequence(0, C), j -> j < C), j -> concat('# note ', j)),
  transform(filter(sequence(0, I), j -> j < I), j -> concat('import mod_', j)),
  CASE WHEN star THEN array('from pkg import *') ELSE CAST(array() AS array<string>) END,
  transform(filter(sequence(0, G), j -> j < G), j -> concat('gvar_', j, ' = ', j)),
  flatten(transform(sequence(0, Fn - 1), j -> flatten(array(
    array('', concat('def func_', j, '(arg_a: int, arg_b):')),
    CASE WHEN (k + j) % 3 = 0 THEN array('    \"\"\"Doc.\"\"\"') ELSE CAST(array() AS array<string>) END,
    transform(filter(sequence(0, D), i -> i < D), i -> concat(repeat(' ', 4 * (i + 1)), 'if arg_a:')),
    array(concat(repeat(' ', 4 * (D + 1)), 'return arg_b'))
  )))),
  CASE WHEN broken THEN array('def (broken:') ELSE CAST(array() AS array<string>) END
))), '\\n')
"""


def source_files_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_files(repo, path, source)``, one module per part.

    The two key columns are spread over the cores *before* the module text
    is generated, so no generated text is shuffled.
    """
    from riskfold.operators.parse import spread_keys

    part = spread_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z")))
    params = part.selectExpr(
        "k", "z",
        "CAST(k % 3 AS INT) AS C", "CAST(k % 5 AS INT) AS I", "CAST(z % 6 AS INT) AS G",
        "CAST(1 + k % 4 AS INT) AS Fn", "CAST(z % 5 AS INT) AS D",
        "k % 11 = 0 AS star", "k % 13 = 0 AS broken",
    )
    with_repo = params.join(_nation(spark, sf_dir), F.col("k") % 25 == F.col("n_nationkey"))
    return with_repo.selectExpr(
        "n_name AS repo",
        "concat('src/p', k, '.py') AS path",
        f"{_T1_SOURCE} AS source",
    )


# Blocks that between them hold every construct the features count.
BLOCKS = {
    "module_doc": '"""Module."""\n',
    "plain_imports": "import os.path, sys\nfrom json import dumps as d\n",
    "star_import": "from math import *\n",
    "class_block": '''class Alpha:  # holder
    """Alpha."""
    size: int = 0

    def first(self, value: int, *rest, key=None):
        if value > 1 and key or rest:
            return value
        elif key:
            return key
        return [x for x in rest if x]

    async def second(self) -> None:
        async for item in self.rows():
            pass

''',
    "function_block": '''def beta(values, *, limit: float):
    """Beta."""
    total = 0  # sum
    for v in values:
        while total < limit:
            total += v
        with open(v) as handle:
            assert handle
    try:
        total = total if total else 1
    except ValueError:
        raise

    def inner(n):
        return n
    return inner(total)

''',
    "async_block": """gamma = lambda q: q or None
delta: int = 3
delta += 1
async def eps(a: int, b: str):
    async with a:
        if b:
            pass
""",
}


def construct_files_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module per part whose blocks are repeated as its key says, so
    that every feature varies."""
    from riskfold.operators.parse import spread_keys

    part = spread_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z")))
    times = {"module_doc": "IF(k % 5 = 0, 1, 0)", "plain_imports": "CAST(z % 3 AS INT)", "star_import": "IF(z % 7 = 0, 1, 0)",
             "class_block": "CAST(k % 3 AS INT)", "function_block": "CAST(k % 4 AS INT)", "async_block": "CAST(z % 5 AS INT)"}
    text = F.concat(*[F.repeat(F.lit(BLOCKS[name]), F.expr(n)) for name, n in times.items()])
    return part.join(_nation(spark, sf_dir), F.col("k") % 25 == F.col("n_nationkey")).select(
        F.col("n_name").alias("repo"), F.concat(F.lit("src/c"), F.col("k"), F.lit(".py")).alias("path"), text.alias("source"))


def source_files_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: every document as a raw source file (none of them parse)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("repo"),
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"),
        F.col("text").alias("source"),
    )


def history_from_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files).

    repo = nation name of l_partkey % 25, commit = order, changed file =
    ``src/p{l_partkey}.py`` (``.md`` when l_partkey % 7 = 0).
    """
    nation = _nation(spark, sf_dir)
    # repo and path are functions of l_partkey, so de-duplicate on the
    # integer keys first and build strings only for distinct rows
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    changed = keys.distinct().join(nation, F.col("l_partkey") % 25 == F.col("n_nationkey"))
    commit_files = changed.select(
        F.col("n_name").alias("repo"),
        F.col("l_orderkey").alias("commit_id"),
        F.concat(F.lit("src/p"), F.col("l_partkey"),
                 F.when(F.col("l_partkey") % 7 == 0, F.lit(".md")).otherwise(F.lit(".py"))).alias("path"),
    )
    per_repo = (keys.select("l_orderkey", (F.col("l_partkey") % 25).alias("rk")).distinct()
                .join(nation, F.col("rk") == F.col("n_nationkey")))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    message = (
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
               & (F.col("o_custkey") % 10 == 0), F.lit("Fix crash in module"))
        .when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "P")
              & (F.col("o_custkey") % 50 == 1), F.lit("prefix cleanup"))
        .otherwise(F.lit("Add feature"))
    )
    commits = (
        per_repo.select(F.col("n_name").alias("repo"), F.col("l_orderkey").alias("commit_id"))
        .join(orders, F.col("commit_id") == F.col("o_orderkey"))
        .select(
            "repo", "commit_id",
            message.alias("message"),
            F.col("o_orderdate").alias("authored_at"),
            F.col("o_orderdate").alias("committed_at"),
            (F.lit(1) + F.when(F.col("o_orderkey") % 17 == 0, 1).otherwise(0)).cast("int").alias("n_parents"),
        )
    )
    return commits, commit_files


def working_tree_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 working tree: every T1 path with its repo (no sources needed)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return (part.join(_nation(spark, sf_dir), F.col("k") % 25 == F.col("n_nationkey"))
            .select(F.col("n_name").alias("repo"), F.concat(F.lit("src/p"), F.col("k"), F.lit(".py")).alias("path")))


def predictions_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: ``predictions(repo, path, label, prediction, score, error)``.

    score = ((k*37) % 1000) / 1000 (scores repeat, so ranks tie);
    label = p_size > 25; prediction = score >= 0.5; k % 101 = 0 is an error
    row with a null score.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    err = F.col("k") % 101 == 0
    score = ((F.col("k") * 37) % 1000) / F.lit(1000.0)
    return part.join(_nation(spark, sf_dir), F.col("k") % 25 == F.col("n_nationkey")).select(
        F.col("n_name").alias("repo"),
        F.concat(F.lit("src/p"), F.col("k"), F.lit(".py")).alias("path"),
        F.when(F.col("z") > 25, 1).otherwise(0).cast("int").alias("label"),
        F.when(err, F.lit(None).cast("int")).otherwise(F.when(score >= 0.5, 1).otherwise(0)).cast("int").alias("prediction"),
        F.when(err, F.lit(None).cast("double")).otherwise(score).alias("score"),
        F.when(err, F.lit("analysis failed")).alias("error"),
        (F.col("k") % 5).cast("int").alias("fold"),
    )


def model_predictions_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 for model comparison: the T4 scores as model 'score_model' and
    1 - score as 'flipped_model' (prediction = score >= 0.5 for each)."""
    base = predictions_from_part(spark, sf_dir)
    a = base.select(F.lit("score_model").alias("model"), F.lit(0).alias("model_pos"), "fold", "path", "label",
                    "prediction", "score")
    flipped = F.lit(1) - F.col("score")
    b = base.select(F.lit("flipped_model").alias("model"), F.lit(1).alias("model_pos"), "fold", "path", "label",
                    F.when(flipped >= 0.5, 1).when(flipped.isNotNull(), 0).cast("int").alias("prediction"),
                    flipped.alias("score"))
    return a.unionByName(b)


# What breaks a parser, one way per file, as bytes (SQL text for each).
BROKEN_FILES = [
    "'x = 1\n'",                                                            # nothing
    "'def f():\n        x = 1\n    y = 2\n'",                               # a dedent to no earlier block
    "concat('x = 1', chr(0), '\ny = 2\n')",                                 # a null byte
    "concat('x = ', repeat('(', 250), '1', repeat(')', 250), '\n')",        # parentheses deeper than the tokenizer goes
    "concat('x = ', repeat('-', 20000), '1\n')",                            # deeper than the parser's stack
    "concat('x = ', repeat('1+', 12000), '1\n')",                           # deeper than the tree builder goes
    "X'" + b"\xef\xbb\xbfx = 1\n".hex() + "'",                               # a byte order mark
    "'# note\nx = \"\"\"\nno end\n'",                                       # an open string
    "''",                                                                   # nothing at all
]
# bytes that are no UTF-8 (a lone surrogate, a stray byte), which are dropped
NO_UTF8 = "X'" + b"s = '\xed\xa0\x80'\n# \xff\n".hex() + "'"


def broken_files_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, path, content)``, one file per part, broken in the way its
    key says (``BROKEN_FILES``, then bytes that are no UTF-8, then no content)."""
    from riskfold.operators.parse import spread_keys

    part = spread_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")))
    ways = [*[f"CAST({text} AS BINARY)" for text in BROKEN_FILES], NO_UTF8]
    cases = " ".join(f"WHEN k % {len(ways) + 1} = {i} THEN {content}" for i, content in enumerate(ways))
    return part.join(_nation(spark, sf_dir), F.col("k") % 25 == F.col("n_nationkey")).select(
        F.col("n_name").alias("repo"), F.concat(F.lit("src/b"), F.col("k"), F.lit(".py")).alias("path"), F.expr(f"CASE {cases} END").alias("content"))


# A feature table that reaches every band and rule; each value is SQL text
# that Spark and the oracle read alike (values not named are zero).
WIDE = {
    "total_lines": "(k * 7) % 900", "cyclomatic_complexity": "(k * 5) % 41", "max_nesting_depth": "k % 9",
    "comment_ratio": "((k * 3) % 400) / 2000.0", "docstring_coverage": "((k * 11) % 201) / 200.0",
    "type_hint_coverage": "((k * 13) % 81) / 80.0", "avg_function_length": "((k * 17) % 240) / 2.0",
    "max_function_length": "(k * 19) % 160", "num_global_variables": "k % 13", "num_nested_functions": "k % 8",
    "uses_star_import": "CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END", "num_loops": "k % 23", "num_branches": "(k * 3) % 61",
    "num_imports": "k % 37", "num_unique_imports": "k % 31", "num_functions": "k % 43", "num_classes": "k % 11",
    "avg_nesting_depth": "((k * 7) % 28) / 4.0", "avg_identifier_length": "((k * 29) % 100) / 4.0", "num_try_except": "k % 10",
    "num_lambda_functions": "k % 12", "num_return_statements": "k % 19", "code_lines": "(k * 5) % 700",
}


def wide_features_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, path, <30 features>)``, one row per part."""
    from riskfold.schema import FEATURE_NAMES, feature_type

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    values = [F.expr(WIDE.get(f, "0")).cast(feature_type(f)).alias(f) for f in FEATURE_NAMES]
    return part.join(_nation(spark, sf_dir), F.col("k") % 25 == F.col("n_nationkey")).select(
        F.col("n_name").alias("repo"), F.concat(F.lit("src/w"), F.col("k"), F.lit(".py")).alias("path"), *values)
