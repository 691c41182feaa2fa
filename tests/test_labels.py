"""Labelling on a hand-made history: substring matches, merges, caps,
recent and never-committed files."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from riskfold.operators import labels as lab


def _ts(d):
    return dt.datetime(2024, 1, d)


def _history(spark):
    commits = spark.createDataFrame([
        ("r", "c1", "Fix crash", _ts(1), _ts(1), 1),
        ("r", "c2", "prefix cleanup", _ts(2), _ts(2), 1),       # 'fix' as a substring
        ("r", "c3", "Merge fix branch", _ts(3), _ts(3), 2),      # merge: lists no files
        ("r", "c4", "add feature", _ts(30), _ts(30), 1),         # recent change
        ("r", "c5", "HOTFIX again", _ts(4), _ts(4), 1),
    ], "repo string, commit_id string, message string, authored_at timestamp, committed_at timestamp, n_parents int")
    files = spark.createDataFrame([
        ("r", "c1", "a.py"), ("r", "c1", "README.md"), ("r", "c2", "b.py"), ("r", "c3", "c.py"),
        ("r", "c4", "d.py"), ("r", "c4", "e.py"), ("r", "c5", "e.py"), ("r", "c3", "f.py"), ("r", "c1", "f.py"),
    ], "repo string, commit_id string, path string")
    tree = spark.createDataFrame([("r", p) for p in ["a.py", "b.py", "c.py", "d.py", "e.py", "f.py", "g.py"]],
                                 "repo string, path string")
    return commits, files, tree


def test_bug_fix_filter(spark):
    commits, _, _ = _history(spark)
    ids = {r["commit_id"] for r in lab.bug_fix_commits(commits).collect()}
    assert ids == {"c1", "c2", "c3", "c5"}


def test_labels(spark):
    commits, files, tree = _history(spark)
    got = {r["path"]: r["label"] for r in lab.label_files(tree, commits, files, "2024-02-10 00:00:00").collect()}
    # a, b, e, f touched by bug fixes (c via a merge only); d recent; c, g never (non-merge) committed
    assert got == {"a.py": 1, "b.py": 1, "e.py": 1, "f.py": 1}
    later = {r["path"]: r["label"] for r in lab.label_files(tree, commits, files, "2024-03-30 00:00:00").collect()}
    assert later == {"a.py": 1, "b.py": 1, "e.py": 1, "f.py": 1, "d.py": 0}


def test_caps(spark):
    commits, files, tree = _history(spark)
    newest = [r["commit_id"] for r in lab.newest_bug_fixes(commits, 2).orderBy("committed_at").collect()]
    assert newest == ["c3", "c5"]
    assert {r["path"] for r in lab.buggy_paths(commits, files, 2).collect()} == {"e.py"}
    assert [r["path"] for r in lab.cap_files(tree, 3).orderBy("path").collect()] == ["a.py", "b.py", "c.py"]
    counts = lab.label_counts(lab.label_files(tree, commits, files, "2024-03-30 00:00:00")).first()
    assert (counts["n_files"], counts["n_buggy"], counts["n_clean"]) == (5, 4, 1)


def test_last_modified(spark):
    commits, files, _ = _history(spark)
    got = {r["path"]: r["last_modified"] for r in lab.last_modified(commits, files).collect()}
    assert got["e.py"] == _ts(30) and got["f.py"] == _ts(1) and "c.py" not in got


def test_large_cap_uses_sliced_positions(spark):
    # caps above the window group-limit threshold take the range-sliced path
    rows = [("hot" if i % 3 else f"r{i % 5}", f"p{i:04d}.py") for i in range(600)]
    files = spark.createDataFrame(rows, "repo string, path string")
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    try:
        got = {(r["repo"], r["path"]) for r in lab.cap_files(files, 150).collect()}
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)
    want = set()
    for repo in {r for r, _ in rows}:
        want |= {(repo, p) for p in sorted(p for r, p in rows if r == repo)[:150]}
    assert got == want


def test_mining_flow(spark):
    from riskfold.plans import jobs

    commits, files, tree = _history(spark)
    sources = tree.withColumn("source", F.lit("def f(x):\n    return x\n"))
    data = jobs.mine_dataset(sources, commits, files, "2024-03-30 00:00:00")
    got = {r["path"]: (r["label"], r["num_functions"]) for r in data.collect()}
    assert got == {"a.py": (1, 1.0), "b.py": (1, 1.0), "e.py": (1, 1.0), "f.py": (1, 1.0), "d.py": (0, 1.0)}


def test_history_sorts_by_a_hash_of_its_names_first(spark):
    # names share their first bytes, so sorting by them compares whole rows
    commits = spark.createDataFrame(
        [("r", 1, "Fix crash", 1), ("r", 1, "Add", 1), ("r", 2, "Add", 1), (None, 3, "Fix", 1), ("r", 4, "Fix", 2)],
        "repo string, commit_id long, message string, n_parents int").selectExpr(
        "*", "timestamp '2001-01-01' + make_interval(0, 0, 0, CAST(commit_id AS INT)) AS authored_at", "timestamp '2001-01-01' AS committed_at")
    files = spark.createDataFrame(
        [("r", 1, "a.py"), ("r", 2, "a.py"), ("r", 2, "b.py"), (None, 3, "c.py"), ("r", 4, "d.py"), ("r", 2, "e.md")],
        "repo string, commit_id long, path string")
    history = lab.file_history(commits, files)
    found = sorted((r["path"], r["last_modified"].day, r["buggy"]) for r in history.select("path", "last_modified", "buggy").collect())
    assert found == [("a.py", 3, 1), ("b.py", 3, 0)]
    assert history.columns == ["repo", "path", "last_modified", "buggy"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lab.file_history(commits, files)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    sorts = re.findall(r"Sort \[(\w+)#", plan)
    assert sorts and set(sorts) <= {"_commit", "_file"}
