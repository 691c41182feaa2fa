"""Source files and commit history as tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.schema import COMMIT_FILES, COMMITS, SOURCE_FILES
from riskfold.session import ship_package

#: Tasks per core for a scan of many small files, which come a few to a split.
SCAN_TASKS = 12


def relative_path(path: Column, root: str) -> Column:
    """``path`` after ``root`` (which ends with a slash), whatever signs the
    root holds; a path outside the root stays whole."""
    at = F.locate(root, path)
    return F.when(at > 0, F.substr(path, at + F.lit(len(root)))).otherwise(path)


def scan_source_files(spark: SparkSession, root: str, repo: str | None = None,
                      pattern: str = "*.py", by_folder: bool = False) -> DataFrame:
    """Every ``pattern`` file under ``root`` (recursive) as
    ``(repo, path, content BINARY)``; ``path`` is relative to ``root``.
    With ``by_folder`` every folder directly under ``root`` is a repo of its
    own, and ``path`` is relative to that.

    Bytes are decoded (UTF-8, dropping bad bytes) inside the parse pass, so
    the scan itself never materialises text.  The glob filter is applied by
    the file listing, before any file is opened.

    Tasks list the folders and read the files, so no list of files is ever on
    the driver.  In a store that Arrow cannot open, and for a root that is a
    glob or no folder, Spark's own reader lists them there.
    """
    if not re.search(r"[*?{\[\\]", root) and _is_folder(root):
        found = _listed_files(spark, root, pattern)
        if by_folder:
            return found.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("repo"),
                                F.substr("path", F.instr("path", "/") + 1).alias("path"), F.col("content"))
    else:
        found = None
    scheme = re.match("[A-Za-z][A-Za-z0-9+.-]*:", root)
    root_uri = root if scheme else "file://" + os.path.abspath(root)
    name = repo if repo is not None else os.path.basename(os.path.abspath(root).rstrip("/"))
    if found is not None:
        return found.select(F.lit(name).alias("repo"), F.col("path"), F.col("content"))
    # listed paths keep the root but may spell the scheme differently
    # (file:/x vs file:///x), so locate the root by its path part
    key = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//)?", "", root_uri).rstrip("/") + "/"
    df = (spark.read.format("binaryFile")
          .option("recursiveFileLookup", "true")
          .option("pathGlobFilter", pattern)
          .load(root_uri))
    # a split holds 32 files at most, so a tree of a million small ones would
    # be tens of thousands of tasks; a task reads many splits, row by row
    most = _scan_tasks(spark)
    if df.rdd.getNumPartitions() > most:  # a scan only: no job runs
        df = df.coalesce(most)
    rel = relative_path(F.col("path"), key)
    if by_folder:
        return df.select(F.split_part(rel, F.lit("/"), F.lit(1)).alias("repo"),
                         F.substr(rel, F.instr(rel, "/") + 1).alias("path"), F.col("content"))
    return df.select(F.lit(name).alias("repo"), rel.alias("path"), F.col("content"))


def _scan_tasks(spark: SparkSession) -> int:
    return max(1, int(SCAN_TASKS * spark.sparkContext.defaultParallelism))


def _is_folder(root: str) -> bool:
    """Whether Arrow opens the store of ``root`` and finds a folder there."""
    import pyarrow as pa
    from pyarrow import fs

    try:
        files, base = _file_system(root)
        return files.get_file_info(base or "/").type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


def glob_pattern(pattern: str) -> re.Pattern:
    """A file name glob as Spark's readers take it: ``*``, ``?``, sets,
    ``{a,b}`` and escapes."""
    out, i, open_braces = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c in "*?":
            out += ".*" if c == "*" else "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1:end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("[", "\\[") + "]"
            i = end
        elif c == "{":
            out, open_braces = out + "(?:", open_braces + 1
        elif c == "}" and open_braces:
            out, open_braces = out + ")", open_braces - 1
        else:
            out += "|" if c == "," and open_braces else re.escape(c)
        i += 1
    return re.compile(out, re.DOTALL)


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _entries(files, folder: str, sized: bool = True) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what a folder holds, without hidden
    folders, hidden files and files of no bytes (of no files, if not
    ``sized``); a local one is streamed."""
    from pyarrow import fs

    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(folder or "/") as found:
            for x in found:
                try:
                    x.name.encode()  # a name that is no text cannot be opened by its path
                    is_folder = x.is_dir()
                    known = is_folder or (sized and x.is_file() and x.stat().st_size > 0)
                except (OSError, UnicodeEncodeError):  # gone, or a link to nothing
                    continue
                if known and (not _hidden(x.name) or (is_folder and x.name.startswith(("_metadata", "_common_metadata")))):
                    yield x.name, is_folder
        return
    for x in files.get_file_info(fs.FileSelector(folder or "/")):
        is_folder = x.type == fs.FileType.Directory
        if (is_folder or (x.type == fs.FileType.File and x.size != 0)) and (
                not _hidden(x.base_name) or (is_folder and x.base_name.startswith(("_metadata", "_common_metadata")))):
            yield x.base_name, is_folder


#: Rows of paths, and bytes of content, that a listing or reading task hands over at once.
_LISTED_ROWS, _READ_BYTES = 2_000, 16 << 20
#: Folders that the driver knows, and levels that it goes down, at most while
#: it looks for enough folders to list apart.
_MOST_FOLDERS, _MOST_LEVELS = 10_000, 6


def _listed_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``(path, content)`` of the files under a folder; paths are relative."""
    ship_package(spark)
    wanted, tasks = glob_pattern(pattern), _scan_tasks(spark)

    def listed(batches):
        import pyarrow as pa

        files, base = _file_system(root)
        rows: list[str] = []
        for batch in batches:
            for top, whole in zip(*(batch.column(i).to_pylist() for i in range(2))):
                folders = [top]
                while folders:
                    folder = folders.pop()
                    for name, is_folder in _entries(files, f"{base}/{folder}".rstrip("/")):
                        path = f"{folder}/{name}" if folder else name
                        if is_folder:
                            if whole:
                                folders.append(path)
                        elif wanted.fullmatch(name):
                            rows.append(path)
                            if len(rows) >= _LISTED_ROWS:
                                yield pa.RecordBatch.from_pydict({"path": pa.array(rows, pa.string())})
                                rows = []
        yield pa.RecordBatch.from_pydict({"path": pa.array(rows, pa.string())})

    def below(batches):
        import pyarrow as pa

        files, base = _file_system(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                names = [x for x, is_folder in _entries(files, f"{base}/{folder}".rstrip("/"), sized=False) if is_folder]
                yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{x}" if folder else x for x in names], pa.string())})

    def read(batches):
        import pyarrow as pa

        files, base = _file_system(root)
        paths, contents, held = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{path}") as f:
                    content = f.read()
                paths.append(path)
                contents.append(content)
                held += len(content)
                if held >= _READ_BYTES or len(paths) >= _LISTED_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                    paths, contents, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    # folders to list with all below them, and those that were opened already
    tops, opened = [""], []
    for _ in range(_MOST_LEVELS):
        if not 0 < len(tops) < tasks or len(opened) > _MOST_FOLDERS:
            break
        frame = spark.createDataFrame([(x,) for x in tops], "path string").repartition(min(len(tops), tasks))
        found = [r.path for r in frame.mapInArrow(below, "path string").limit(_MOST_FOLDERS + 1).collect()]
        if len(found) > _MOST_FOLDERS:
            break
        opened += tops
        tops = found
    folders = [(x, True) for x in tops] + [(x, False) for x in opened]
    frame = spark.createDataFrame(folders, "path string, whole boolean").repartition(min(len(folders), tasks))
    return frame.mapInArrow(listed, "path string").repartition(tasks, "path").mapInArrow(read, "path string, content binary")


def write_source_files(sources: DataFrame, root: str) -> int:
    """``sources(repo, path, source)`` as a tree, every row a file of its own
    under ``root/repo/path``; the number of files.

    Each task writes the files of its rows where they belong.  Spark's own
    writer would give every file a folder and move them all, one after the
    other, when the job commits.  A task that is tried again writes the same
    files once more.
    """
    ship_package(sources.sparkSession)

    def run(batches):
        import pyarrow as pa

        files, base = _file_system(root)
        made: set[str] = set()
        for batch in batches:
            for repo, path, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at = f"{base}/{repo}/{path}"
                folder = at.rpartition("/")[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(at) as out:
                    out.write(source)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows = sources.select(F.col("repo").cast("string"), F.col("path").cast("string"), F.coalesce(F.col("source").cast("binary"), F.lit(b"")))
    return rows.toDF("repo", "path", "source").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _file_system(root: str):
    """The Arrow file system of a folder, and the folder's path there."""
    from pyarrow import fs

    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", root) and not root.startswith("file:"):
        found, base = fs.FileSystem.from_uri(root)
    else:
        found, base = fs.LocalFileSystem(), os.path.abspath(re.sub("^file:/*", "/", root))
    return found, base.rstrip("/")


def source_table(df: DataFrame, path_col: str = "path", source_col: str = "source",
                 repo_col: str | None = "repo", repo: str | None = None) -> DataFrame:
    """Any table of (name, content) as ``(repo, path, source)``."""
    if repo_col and repo_col in df.columns:
        r = F.col(repo_col).cast("string")
    else:
        r = F.lit(repo).cast("string")
    return df.select(r.alias("repo"), F.col(path_col).cast("string").alias("path"), F.col(source_col).alias("source"))


#: What the ``error`` column says of a record that does not parse.
MALFORMED = "malformed record"
_CORRUPT = "_corrupt_record"


def write_by_repo(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Sources, commits or changed files in a folder for each repo, so that
    readers of some repos open no other folder.  Each task writes what it has
    of a repo: nothing is shuffled, and no task gets a repo whole."""
    df.write.mode(mode).partitionBy("repo").format(fmt).save(path)


def _declared(spark: SparkSession, path: str, fmt: str, schema: T.StructType, repos: Sequence[str] | None, **options) -> DataFrame:
    """The columns of ``schema`` and ``error``.  A JSON or CSV record that
    does not fit the schema becomes a row with nothing but its repo and error.
    With ``repos`` only these are read: of tables written by repo, only their
    folders are listed."""
    reader = spark.read.options(**options)
    if fmt in ("json", "csv"):
        fields = list(schema.fields)
        if fmt == "csv":
            reader = reader.options(header=True, multiLine=True, quote='"', escape='"')
            declared = {f.name: f for f in fields}  # cells go by place: the header says which is which
            fields = [declared.get(c, T.StructField(c, T.StringType())) for c in reader.csv(path).columns]
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
        df = reader.schema(T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])).format(fmt).load(path)
        bad = F.col(_CORRUPT).isNotNull()
    else:
        df = reader.format(fmt).load(path)
        bad = F.lit(False)
    if repos is not None:
        df = df.where(F.col("repo").cast("string").isin(*repos))
    columns = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType) for f in schema.fields]
    kept = [c.alias(f.name) if f.name == "repo" else F.when(~bad, c).alias(f.name) for c, f in zip(columns, schema.fields)]
    return df.select(*kept, F.when(bad, MALFORMED).alias("error"))


def read_sources(spark: SparkSession, path: str, fmt: str = "parquet", repos: Sequence[str] | None = None,
                 repo: str | None = None, **options) -> DataFrame:
    """S2 readers: parquet, JSON or CSV tables of (repo?, path, source) as
    (repo, path, source, error), or ``text`` (one file = one source).  ``repo``
    names the rows of a table that has no repo."""
    if fmt == "text":
        df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))
        return source_table(df, repo=repo).withColumn("error", F.lit(None).cast("string"))
    df = _declared(spark, path, fmt, SOURCE_FILES, repos, **options)
    return df if repo is None else df.withColumn("repo", F.coalesce("repo", F.lit(repo)))


def read_commits(spark: SparkSession, path: str, fmt: str = "parquet", repos: Sequence[str] | None = None) -> DataFrame:
    """Commits with the declared schema (no inference) and ``error``."""
    return _declared(spark, path, fmt, COMMITS, repos)


def read_commit_files(spark: SparkSession, path: str, fmt: str = "parquet", repos: Sequence[str] | None = None) -> DataFrame:
    """Changed files of commits with the declared schema and ``error``."""
    return _declared(spark, path, fmt, COMMIT_FILES, repos)
