"""Sources and sinks: directory scan, feature-table CSV round trip, report sinks."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.operators.features import extract_features
from riskfold.schema import FEATURE_NAMES, FLAT_REPORT
from riskfold.sources.files import MALFORMED, read_commit_files, read_commits, read_sources, scan_source_files, source_table, write_by_repo
from riskfold.sources.tables import (
    read_feature_table, read_feature_tables, read_report_csv, report_order, write_feature_table, write_report_csv, write_report_json)


def _write(root, rel, data: bytes):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as fh:
        fh.write(data)


def test_scan_directory(spark, scratch):
    root = os.path.join(scratch, "proj")
    _write(root, "a.py", b"def f(x):\n    return x\n")
    _write(root, "pkg/b.py", b"x = 1\n# c\n")
    _write(root, "pkg/deep/c.py", b"y = '\xff\xfe'\n")  # undecodable bytes are dropped
    _write(root, "notes.txt", b"not python")
    files = scan_source_files(spark, root)
    got = {r["path"]: r for r in extract_features(files, "content").collect()}
    assert set(got) == {"a.py", "pkg/b.py", "pkg/deep/c.py"}
    assert got["a.py"]["num_functions"] == 1 and got["a.py"]["repo"] == "proj"
    assert got["pkg/b.py"]["comment_lines"] == 1
    assert got["pkg/deep/c.py"]["syntax_error"] == 0 and got["pkg/deep/c.py"]["num_global_variables"] == 1


def test_source_table_from_any_frame(spark):
    df = spark.createDataFrame([("up/x.py", "x = 1\n")], "name string, content string")
    t = source_table(df, "name", "content", repo="batch")
    assert t.columns == ["repo", "path", "source"] and t.first()["repo"] == "batch"


def test_feature_table_round_trip(spark, scratch):
    rows = [tuple(float(i + j) for j in range(30)) + (i % 2,) for i in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURE_NAMES) + ", label int")
    out = os.path.join(scratch, "ds_csv")
    write_feature_table(df, out)
    back = read_feature_table(spark, out)
    assert back.columns == FEATURE_NAMES + ["label"]
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    # a missing column is zero-filled
    partial = os.path.join(scratch, "partial")
    df.drop("num_loops").write.option("header", "true").csv(partial)
    r = read_feature_table(spark, partial)
    assert r.agg(F.max("num_loops")).first()[0] == 0.0


def test_missing_dataset_raises(spark, scratch):
    import pytest

    with pytest.raises(FileNotFoundError):
        read_feature_table(spark, os.path.join(scratch, "absent"))


def test_json_report_keeps_nesting(spark, scratch):
    df = spark.createDataFrame(
        [("a.py", 0.7, [("cyclomatic_complexity", 12.0, 0.3)])],
        "file_path string, risk_score double, top_factors array<struct<feature:string,value:double,importance:double>>")
    out = os.path.join(scratch, "report_json")
    write_report_json(df, out)
    back = spark.read.json(out).first()
    assert back["top_factors"][0]["feature"] == "cyclomatic_complexity"


def test_scan_of_a_quoted_root_with_a_repo_per_folder(spark, scratch):
    import os

    from riskfold.sources.files import scan_source_files

    root = os.path.join(scratch, "o'brien")
    for repo, name in (("one", "a.py"), ("one", "pkg/b.py"), ("two", "a.py")):
        os.makedirs(os.path.dirname(os.path.join(root, repo, name)), exist_ok=True)
        with open(os.path.join(root, repo, name), "w") as f:
            f.write("x = 1\n")
    got = sorted((r.repo, r.path) for r in scan_source_files(spark, root, by_folder=True).collect())
    assert got == [("one", "a.py"), ("one", "pkg/b.py"), ("two", "a.py")]
    assert sorted(r.path for r in scan_source_files(spark, root).collect()) == ["one/a.py", "one/pkg/b.py", "two/a.py"]


def test_scan_of_a_root_with_a_scheme(spark, scratch):
    _write(scratch, "tree/one/a.py", b"x = 1\n")
    for root in (f"file:{scratch}/tree", f"file://{scratch}/tree/"):
        assert [(r.repo, r.path) for r in scan_source_files(spark, root, by_folder=True).collect()] == [("one", "a.py")]


def test_readers_of_sources_by_repo(spark, scratch):
    rows = [("a", "x.py", "x = 1\n"), ("a", "y.py", 'say = "hi, \\ there"\n# é\n'), ("b", "x.py", ""), ("7", "z.py", None)]
    df = spark.createDataFrame(rows, "repo string, path string, source string")
    key = lambda r: (r[0], r[1] or "")
    for fmt in ("parquet", "json"):
        out = os.path.join(scratch, fmt)
        write_by_repo(df, out, fmt)
        got = [tuple(r) for r in read_sources(spark, out, fmt).collect()]
        assert sorted(got, key=key) == sorted([(*r, None) for r in rows], key=key)  # a repo named 7 stays text
        some = read_sources(spark, out, fmt, repos=["b"])
        assert [tuple(r) for r in some.collect()] == [("b", "x.py", "", None)]
        scan = next(x for x in some._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
        assert "PartitionFilters: []" not in scan and "PartitionFilters: [" in scan  # other folders are not read
    # a CSV with line breaks in its cells, and a table without repos
    flat = os.path.join(scratch, "flat")
    df.where("repo = 'a'").drop("repo").write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(flat)
    got = [tuple(r) for r in read_sources(spark, flat, "csv", repo="up").collect()]
    assert sorted(got) == [("up", "x.py", "x = 1\n", None), ("up", "y.py", rows[1][2], None)]
    text = os.path.join(scratch, "text")
    _write(text, "m.py", b"a = 1\nb = 2\n")
    (one,) = read_sources(spark, text, "text", repo="up").collect()
    assert one.repo == "up" and one.path.endswith("/m.py") and one.source == "a = 1\nb = 2\n"


def test_malformed_records_are_error_rows(spark, scratch):
    _write(scratch, "s/repo=r/a.json", b'{"path": "a.py", "source": "x = 1"}\n{"path": "b.py", "sou\nnot json\n{"path": "c.py", "source": "y = 2"}\n')
    rows = read_sources(spark, os.path.join(scratch, "s"), "json").collect()
    assert sorted((r.repo, r.path or "", r.error or "") for r in rows) == [
        ("r", "", MALFORMED), ("r", "", MALFORMED), ("r", "a.py", ""), ("r", "c.py", "")]
    found = extract_features(read_sources(spark, os.path.join(scratch, "s"), "json")).collect()
    assert len(found) == 4 and sum(r.error is not None for r in found) == 2
    # a value of the wrong type makes its record malformed, not the job fail
    _write(scratch, "c/x.json", b'{"repo": "r", "commit_id": "1", "message": "fix", "n_parents": "many"}\n{"repo": "r", "commit_id": "2", "n_parents": 1}\n')
    commits = {r.commit_id: r for r in read_commits(spark, os.path.join(scratch, "c"), "json").collect()}
    assert commits["2"].error is None and commits["2"].n_parents == 1 and commits[None].error == MALFORMED
    _write(scratch, "f/x.csv", b"repo,commit_id,path\nr,1,a.py\n")
    assert [tuple(r) for r in read_commit_files(spark, os.path.join(scratch, "f"), "csv").collect()] == [("r", "1", "a.py", None)]


def test_csv_report_keeps_blanks_and_order(spark, scratch):
    rows = [("r", f"p{i}.py", None if i % 7 == 0 else (i * 37 % 50) / 50, ["Low", "", " x ", 'say "hi"\nthere', None][i % 5], None if i % 3 == 0 else i % 2 == 0)
            for i in range(200)]
    schema = T.StructType(FLAT_REPORT.fields[:5])
    df = spark.createDataFrame(rows, schema)
    out = os.path.join(scratch, "csv")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_report_csv(df, out, report_order("risk_score", "file_path"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(f for f in os.listdir(out) if f.endswith(".csv"))
    assert len(files) > 2
    got = [tuple(r) for r in read_report_csv(spark, out, schema, "position").orderBy("position").collect()]
    want = sorted(rows, key=lambda r: (-(r[2] or 0.0), r[1]))
    assert got == [(*r, i) for i, r in enumerate(want, 1)]


def test_feature_tables_with_other_columns(spark, scratch):
    full = spark.createDataFrame([("a", "x.py", *[float(i) for i in range(30)], 1)], "repo string, path string, " + ", ".join(f"{f} double" for f in FEATURE_NAMES) + ", label int")
    full.write.parquet(f"{scratch}/one")
    full.withColumn("repo", F.lit("b")).drop("num_loops", "label").withColumn("owner", F.lit("me")).write.parquet(f"{scratch}/two")
    full.where("false").write.parquet(f"{scratch}/none")
    os.makedirs(f"{scratch}/bare")
    paths = [f"{scratch}/{n}" for n in ("one", "two", "none", "bare", "missing")]
    rows = {r.repo: r for r in read_feature_tables(spark, paths).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].num_loops == FEATURE_NAMES.index("num_loops") and rows["b"].num_loops == 0.0
    assert rows["a"].label == 1 and rows["b"].label == 0 and "owner" not in rows["a"].asDict()
    with pytest.raises(FileNotFoundError):
        read_feature_tables(spark, paths[3:])


def test_half_even_text(spark):
    from riskfold.functions.columns import half_even_text

    values = [0.0, 0.5, 1.5, 2.5, 0.05, 0.25, 0.75, 6.25, 99.95, 1234.5678, 0.04]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", half_even_text(F.col("v")).alias("a"), half_even_text(F.col("v"), 1).alias("b"))
    for r in df.collect():
        assert r.a == f"{r.v:.0f}"
        assert r.b == f"{round(r.v * 10) / 10:.1f}"


def test_a_tree_is_written_by_its_tasks_and_scanned_in_few(spark, scratch, monkeypatch):
    """a file for every row, no folder for each, and no task for a few files."""
    from riskfold.sources import files

    root = os.path.join(scratch, "a tree")
    rows = [(f"r{i % 3}", f"src/deep/p{i}.py", f"x = {i}\nä") for i in range(300)]
    df = spark.createDataFrame(rows, "repo string, path string, source string").repartition(5)
    assert files.write_source_files(df, root) == 300
    assert files.write_source_files(df, "file:" + root) == 300  # again, as a task that is tried twice
    assert sorted(os.listdir(root)) == ["r0", "r1", "r2"] and os.listdir(f"{root}/r1") == ["src"]
    monkeypatch.setattr(files, "SCAN_TASKS", 0.5)
    found = scan_source_files(spark, root, by_folder=True)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = sorted((r.repo, r.path, bytes(r.content).decode()) for r in found.collect())
    assert got == sorted(rows)


def test_a_tree_is_listed_by_tasks_as_spark_lists_it(spark, scratch, monkeypatch):
    """the driver holds no list of files."""
    from riskfold.sources import files

    root = os.path.join(scratch, "tree")
    names = ["a.py", "pkg/b.py", "pkg/__init__.py", "pkg/_x=1.py", "pkg/.c.py", "_priv/d.py", ".git/e.py", "_metadata_of/f.py", "_k=v/g.py", "one two/h'\u00e4%20.py",
             "deep/1/2/3/4/5/6/7/8/i.py", "notes.txt", "pkg/b.pyc", "k.py._COPYING_", "pkg/l.PY", "dir.py/m.py"]
    for name in names:
        _write(root, name, name.encode() + b"\xff")
    _write(root, "pkg/empty.py", b"")
    _write(scratch, "elsewhere/n.py", b"n")
    os.symlink(os.path.join(scratch, "elsewhere"), os.path.join(root, "link"))
    os.symlink(os.path.join(root, "a.py"), os.path.join(root, "pkg", "o.py"))
    os.symlink(os.path.join(root, "nothing"), os.path.join(root, "pkg", "p.py"))
    os.mkdir(os.path.join(root, "bare"))

    def plain(pattern):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).collect()
        return sorted((r.path.partition("/tree/")[2], bytes(r.content)) for r in found)

    for pattern in ("*.py", "*.{py,txt}", "[a-c].py", "?.py", "[!a]*", "b.py*"):
        found = scan_source_files(spark, root, pattern=pattern)
        assert sorted((r.path, bytes(r.content)) for r in found.collect()) == plain(pattern) != [], pattern
    assert len(plain("*.py")) == 10
    assert not found.inputFiles() and "FileScan" not in found._jdf.queryExecution().toString()  # the driver has listed no file
    want = sorted(path for path, _ in plain("*.py"))
    for levels, folders in ((0, 10), (1, 10), (6, 3), (20, 10_000)):  # however the folders are dealt
        monkeypatch.setattr(files, "_MOST_LEVELS", levels)
        monkeypatch.setattr(files, "_MOST_FOLDERS", folders)
        monkeypatch.setattr(files, "_LISTED_ROWS", 2)
        assert sorted(r.path for r in scan_source_files(spark, root).collect()) == want
    # globs and missing folders are Spark's
    assert scan_source_files(spark, os.path.join(scratch, "tre*")).count() == 10
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_source_files(spark, os.path.join(scratch, "absent"))
    assert scan_source_files(spark, os.path.join(root, "bare")).count() == 0
