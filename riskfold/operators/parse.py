"""parse source files into the syntax-node relation and per-file line
statistics, in one distributed Arrow pass.

The pass emits a tagged stream (``kind`` = 'file' | 'node'): one 'file' row
per input file (line counts, syntax/error flags) and one 'node' row per
syntax node.  Every file gets its 'file' row even when it has no nodes, so
downstream aggregates never lose empty or unparsable files and need no join
back to the file list.  ``parse_sums`` is the stream that features need: the
nodes of a file come added up, one row a file instead of hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.schema import (
    FILE_COLUMNS, FUNCTION_NODES, GLOBAL_ASSIGN_NODES, NODE_COLUMNS, NODE_COUNTS, NODE_MAXIMA, NODE_SUMS, PARSED, SUMMED)
from riskfold.session import ship_package

# Output rows per Arrow batch handed back to the JVM.  Node rows are small;
# this keeps each Python->JVM batch a few MB regardless of file size.
_OUTPUT_BATCH_ROWS = 32_768
# Source bytes that are Python objects at once, whatever an input batch holds.
_INPUT_BYTES = 4 << 20


def _slices(batch):
    """Pieces of a batch with at most ``_INPUT_BYTES`` of source each (one
    longer file stands alone)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("source")), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > _INPUT_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def _parsed_files(batches, nodes_of=None):
    """(repo, path, file_id, file row, nodes) of every file.

    Trees hold no cycles and are freed as they are left, so the collector,
    which would walk each of them over and over, runs once a slice instead.
    """
    import gc

    from riskfold.functions.pysyntax import NO_SOURCE, decode_source, parse_file

    was_on = gc.isenabled()
    gc.disable()
    try:
        for batch in batches:
            for part in _slices(batch):
                for repo, path, raw, file_id in zip(*(part.column(c).to_pylist() for c in ("repo", "path", "source", "file_id"))):
                    file_row, nodes = (NO_SOURCE, ()) if raw is None else parse_file(decode_source(raw), nodes_of)
                    yield repo, path, file_id, file_row, nodes
                gc.collect()
    finally:
        if was_on:
            gc.enable()


def _parse_batches(batches):
    import pyarrow as pa

    names = [f.name for f in PARSED.fields]
    arrow_schema = pa.schema([
        pa.field("repo", pa.string()), pa.field("path", pa.string()),
        pa.field("kind", pa.string(), nullable=False),
        pa.field("node_id", pa.int32()), pa.field("parent_id", pa.int32()),
        pa.field("node_type", pa.string()), pa.field("lineno", pa.int32()),
        pa.field("end_lineno", pa.int32()), pa.field("at_module_level", pa.bool_()),
        pa.field("block_depth", pa.int32()), pa.field("block_depth_sync", pa.int32()),
        pa.field("class_depth", pa.int32()), pa.field("func_depth", pa.int32()),
        pa.field("name", pa.string()), pa.field("bool_operands", pa.int32()),
        pa.field("n_aliases", pa.int32()), pa.field("import_roots", pa.list_(pa.string())),
        pa.field("new_import_roots", pa.int32()), pa.field("is_star", pa.bool_()),
        pa.field("has_docstring", pa.bool_()), pa.field("n_args", pa.int32()),
        pa.field("n_annotated", pa.int32()),
        pa.field("total_lines", pa.int32()), pa.field("blank_lines", pa.int32()),
        pa.field("comment_lines", pa.int32()), pa.field("syntax_error", pa.int32()),
        pa.field("error", pa.string()), pa.field("file_id", pa.int64()),
    ])
    assert arrow_schema.names == names
    n_node_cols = 19
    n_file_cols = 5

    def flush(files, nodes):
        """Columns of one output batch: file rows first, then node rows
        (built by transposing row tuples, not cell by cell)."""
        nf, nn = len(files), len(nodes)
        fcols = list(zip(*files)) if nf else [()] * (3 + n_file_cols)
        ncols = list(zip(*nodes)) if nn else [()] * (3 + n_node_cols)
        data = {"repo": [*fcols[0], *ncols[0]], "path": [*fcols[1], *ncols[1]],
                "kind": ["file"] * nf + ["node"] * nn}
        for i, n in enumerate(names[3:3 + n_node_cols]):
            data[n] = [None] * nf + list(ncols[2 + i])
        data["file_id"] = [*fcols[-1], *ncols[-1]]
        for j, n in enumerate(names[3 + n_node_cols:-1]):
            data[n] = list(fcols[2 + j]) + [None] * nn
        return pa.RecordBatch.from_pydict(data, schema=arrow_schema)

    files: list[tuple] = []
    nodes: list[tuple] = []
    for repo, path, file_id, file_row, node_list in _parsed_files(batches):
        files.append((repo, path, *file_row, file_id))
        for row in node_list:
            nodes.append((repo, path, *row, file_id))
            # flush inside a file too: one huge module still yields
            # batches of bounded size
            if len(files) + len(nodes) >= _OUTPUT_BATCH_ROWS:
                yield flush(files, nodes)
                files, nodes = [], []
        if len(files) + len(nodes) >= _OUTPUT_BATCH_ROWS:
            yield flush(files, nodes)
            files, nodes = [], []
    if files or nodes:
        yield flush(files, nodes)


def _sum_batches(batches):
    import pyarrow as pa

    from riskfold.functions.pysyntax import node_sums

    places = (*NODE_SUMS, *NODE_MAXIMA)
    schema = pa.schema([("repo", pa.string()), ("path", pa.string()), ("file_id", pa.int64()), *((c, pa.int64()) for c in places),
                        *((c, pa.int32()) for c in ("total_lines", "blank_lines", "comment_lines", "syntax_error")), ("error", pa.string())])
    nothing = [0] * len(places)
    rows: list[tuple] = []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for repo, path, file_id, file_row, sums in _parsed_files(batches, node_sums):
        rows.append((repo, path, file_id, *(sums or nothing), *file_row))
        if len(rows) >= _OUTPUT_BATCH_ROWS:
            yield flush()
            rows = []
    if rows:
        yield flush()


def spread_keys(df: DataFrame) -> DataFrame:
    """Deals a narrow table that sources are made of over more tasks than
    cores: its splits say nothing of how its rows lie in them (a file of one
    row group is read by one task, whatever its splits)."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def spread_for_cpu(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Make sure a CPU-heavy per-row pass gets at least the cluster's
    parallelism in tasks.

    Parsing costs far more per byte than reading, so a small input that
    arrives in one or two splits would otherwise be parsed by one core.
    Large inputs already have many more splits than cores and pass through
    unchanged (no shuffle is added at scale).
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    # An input that already comes out of a shuffle has shuffle-partition
    # many splits; counting them would execute that shuffle, so leave it.
    plan = df._jdf.queryExecution().executedPlan().toString()
    if any(m in plan for m in _SHUFFLE_MARKERS):
        return df
    if df.rdd.getNumPartitions() >= want:  # scans only: no job runs
        return df
    return df.repartition(want)


_SHUFFLE_MARKERS = ("Exchange hashpartitioning", "Exchange RoundRobinPartitioning", "Exchange rangepartitioning",
                    "Exchange SinglePartition")


def _numbered(sources: DataFrame, source_col: str) -> DataFrame:
    cols = sources.columns
    repo = F.col("repo") if "repo" in cols else F.lit(None).cast("string")
    return sources.select(repo.alias("repo"), F.col("path"), F.col(source_col).alias("source"),
                          F.monotonically_increasing_id().alias("file_id"))


def parse_sources(sources: DataFrame, source_col: str = "source", min_partitions: int | None = None) -> DataFrame:
    """Tagged parse stream for ``sources(repo, path, <source_col>)``.

    ``source_col`` may be STRING or BINARY (raw file bytes, decoded as UTF-8
    dropping bad bytes).  Filters on ``sources`` should be applied before
    this call: the Python pass is opaque to the optimizer.
    """
    ship_package(sources.sparkSession)
    return spread_for_cpu(_numbered(sources, source_col), min_partitions).mapInArrow(_parse_batches, PARSED)


def parse_sums(sources: DataFrame, source_col: str = "source", min_partitions: int | None = None) -> DataFrame:
    """The parse stream as far as features read it: one row per file, its
    nodes added up in the parse task."""
    ship_package(sources.sparkSession)
    return spread_for_cpu(_numbered(sources, source_col), min_partitions).mapInArrow(_sum_batches, SUMMED)


def sums_of(parsed: DataFrame) -> DataFrame:
    """The rows of ``parse_sources`` in the form of ``parse_sums``: each node
    is a sum of its own."""
    t = F.col("node_type")
    func = t.isin(FUNCTION_NODES)
    named = F.length("name") > 1
    lines = F.col("end_lineno") - F.col("lineno")

    def one(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    values = {c: one(t.isin(types)) for c, types in NODE_COUNTS.items()} | {
        "decisions": one(t.isin(NODE_COUNTS["decisions"])) + F.when(t == "BoolOp", F.col("bool_operands") - 1).otherwise(0),
        "num_methods": one(func & (F.col("class_depth") > 0)), "sum_fn_len": F.when(func, lines),
        "num_imports": F.when(t == "Import", F.col("n_aliases")).when(t == "ImportFrom", 1), "num_unique_imports": F.col("new_import_roots"),
        "sum_sync_depth": F.when(t.isin(NODE_COUNTS["n_sync_blocks"]), F.col("block_depth_sync")),
        "module_doc": one((t == "Module") & F.col("has_docstring")), "funcs_with_doc": one(func & F.col("has_docstring")),
        "n_args": F.col("n_args"), "n_annotated": F.col("n_annotated"), "sum_ident_len": F.when(named, F.length("name")), "n_idents": one(named),
        "num_global_variables": one(F.col("at_module_level") & t.isin(GLOBAL_ASSIGN_NODES)), "num_nested_functions": F.when(func, F.col("func_depth")),
        "max_fn_len": F.when(func, lines), "max_depth": F.col("block_depth"), "uses_star_import": one(F.col("is_star")),
    }
    return parsed.select("repo", "path", "file_id", *[F.coalesce(values[c], F.lit(0)).cast("long").alias(c) for c in (*NODE_SUMS, *NODE_MAXIMA)],
                         "total_lines", "blank_lines", "comment_lines", "syntax_error", "error")


def ast_nodes(parsed: DataFrame) -> DataFrame:
    """The public node relation (one row per syntax node)."""
    return parsed.where(F.col("kind") == "node").select(*NODE_COLUMNS)


def line_stats(parsed: DataFrame) -> DataFrame:
    """One row per file: line counts, syntax flag and error message."""
    return parsed.where(F.col("kind") == "file").select(*FILE_COLUMNS)


LINE_SCHEMA = "repo string, path string, total_lines int, blank_lines int, comment_lines int, error string"


def _line_batches(batches):
    import pyarrow as pa

    from riskfold.functions.pysyntax import NO_SOURCE, decode_source, line_counts

    schema = pa.schema([pa.field("repo", pa.string()), pa.field("path", pa.string()),
                        pa.field("total_lines", pa.int32()), pa.field("blank_lines", pa.int32()),
                        pa.field("comment_lines", pa.int32()), pa.field("error", pa.string())])
    for batch in (part for whole in batches for part in _slices(whole)):
        repos = batch.column("repo").to_pylist()
        paths = batch.column("path").to_pylist()
        rows = [NO_SOURCE if raw is None else line_counts(decode_source(raw)) for raw in batch.column("source").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "repo": repos, "path": paths,
            "total_lines": [r[0] for r in rows], "blank_lines": [r[1] for r in rows],
            "comment_lines": [r[2] for r in rows], "error": [r[4] for r in rows],
        }, schema=schema)


def scan_lines(sources: DataFrame, source_col: str = "source", min_partitions: int | None = None) -> DataFrame:
    """Line statistics only (no syntax tree): one row per file straight out
    of the Arrow pass, so nothing is aggregated or shuffled."""
    cols = sources.columns
    repo = F.col("repo") if "repo" in cols else F.lit(None).cast("string")
    inp = sources.select(repo.alias("repo"), F.col("path"), F.col(source_col).alias("source"))
    ship_package(sources.sparkSession)
    return spread_for_cpu(inp, min_partitions).mapInArrow(_line_batches, LINE_SCHEMA)
