"""Label files from commit history with joins and windows.

Tables: ``commits(repo, commit_id, message, authored_at, committed_at,
n_parents)`` and ``commit_files(repo, commit_id, path)``; the working tree
is ``files(repo, path)``.

No cap is applied unless it is asked for: files, fixes and history are used
whole.  A cap that is asked for takes exact positions from a range
partitioning of (repo, order), the same way at every size, so a repo holding
a third of all commits is spread over many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.functions.ordering import running_sums

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results).
# Words marking a bug-fix commit (case-insensitive substring match).
BUG_FIX_WORDS = [
    "fix", "bug", "patch", "error", "issue", "crash",
    "resolve", "hotfix", "repair", "workaround", "incorrect",
]
STABLE_DAYS = 30            # a file untouched this long is clean
# ---------------------------------------------------------------------------


def bug_fix_pattern(words: list[str] = BUG_FIX_WORDS) -> str:
    return "(?i)(" + "|".join(re.escape(w) for w in words) + ")"


def _newest_first() -> list[Column]:
    return [F.col("committed_at").desc(), F.col("commit_id").asc()]


def cap_per_repo(df: DataFrame, n: int | None, order: list[Column]) -> DataFrame:
    """Keep the first ``n`` rows of each repo in ``order`` (None = all).

    ``order`` must be a total order within a repo.
    """
    if n is None:
        return df
    pos = running_sums(df.withColumn("_one", F.lit(1)), ["repo"], order, ["_one"], inclusive=True)
    return pos.where(F.col("cum__one") <= n).drop("_one", "cum__one")


def cap_files(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """S3: at most ``max_files`` files per repo, in path order."""
    return cap_per_repo(files, max_files, [F.col("path").asc()])


def history_depth(commits: DataFrame, depth: int | None = None) -> DataFrame:
    """L3: only the newest ``depth`` commits of each repo (shallow clone)."""
    return cap_per_repo(commits, depth, _newest_first())


def bug_fix_commits(commits: DataFrame, words: list[str] = BUG_FIX_WORDS) -> DataFrame:
    """L1: commits whose message contains any bug-fix word."""
    return commits.where(F.col("message").rlike(bug_fix_pattern(words)))


def newest_bug_fixes(commits: DataFrame, cap: int | None = None,
                     words: list[str] = BUG_FIX_WORDS) -> DataFrame:
    """L1 + L2: the newest ``cap`` bug-fix commits per repo."""
    return cap_per_repo(bug_fix_commits(commits, words), cap, _newest_first())


def changed_python_files(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """L4: (repo, commit_id, path) of Python files changed by ``commits``.
    Merge commits list no files (a plain tree diff of a merge is empty)."""
    py = commit_files.where(F.col("path").endswith(".py")).select("repo", "commit_id", "path")
    single = commits.where(F.col("n_parents") <= 1).select("repo", "commit_id")
    return py.join(single, ["repo", "commit_id"], "left_semi")


def buggy_paths(commits: DataFrame, commit_files: DataFrame, cap: int | None = None,
                words: list[str] = BUG_FIX_WORDS) -> DataFrame:
    """Distinct (repo, path) touched by the newest bug-fix commits."""
    fixes = newest_bug_fixes(commits, cap, words)
    return changed_python_files(fixes, commit_files).select("repo", "path").distinct()


def last_modified(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Author date of the newest commit touching each (repo, path); of
    commits at one moment the greatest commit_id counts."""
    touched = commit_files.join(
        commits.where(F.col("n_parents") <= 1).select("repo", "commit_id", "authored_at", "committed_at"),
        ["repo", "commit_id"])
    return touched.groupBy("repo", "path").agg(
        F.max_by("authored_at", F.struct("committed_at", "commit_id")).alias("last_modified"))


def file_history(commits: DataFrame, commit_files: DataFrame, cap: int | None = None,
                 words: list[str] = BUG_FIX_WORDS, suffix: str = ".py") -> DataFrame:
    """L5 + L6 in one pass over ``commit_files``: per (repo, path) of a
    ``suffix`` file, the author date of its newest non-merge commit and
    whether one of the newest ``cap`` bug-fix commits changed it.

    commit_files is read and shuffled once: it joins the non-merge commits
    on (repo, commit_id), the newest fixes are joined on the same keys (no
    re-partitioning), and one aggregate by (repo, path) yields both values.
    Both sort by a hash of their keys first: names share their first bytes,
    which are all that Spark compares without going to the rows.
    """
    commit = F.xxhash64("repo", "commit_id").alias("_commit")
    keys = ["_commit", "repo", "commit_id"]
    fixes = newest_bug_fixes(commits, cap, words).select(commit, "repo", "commit_id", F.lit(1).alias("_fix"))
    # flag the fixes on the commit side first (one row per commit), so the
    # big side meets a single shuffle join whose skewed partitions (a
    # commit touching a huge number of files) AQE can split
    single = (commits.where(F.col("n_parents") <= 1).select(commit, "repo", "commit_id", "authored_at", "committed_at")
              .join(fixes, keys, "left"))
    touched = (commit_files.where(F.col("path").endswith(suffix)).select(commit, "repo", "commit_id", "path")
               .join(single, keys).withColumn("_file", F.xxhash64("repo", "path")))
    return touched.groupBy("_file", "repo", "path").agg(
        F.max_by("authored_at", F.struct("committed_at", "commit_id")).alias("last_modified"),
        F.max(F.coalesce(F.col("_fix"), F.lit(0))).alias("buggy")).drop("_file")


def label_files(files: DataFrame, commits: DataFrame, commit_files: DataFrame, as_of: str,
                max_files: int | None = None, cap: int | None = None,
                depth: int | None = None, words: list[str] = BUG_FIX_WORDS,
                stable_days: int = STABLE_DAYS) -> DataFrame:
    """``(repo, path, label)``.

    1 if the file was touched by one of the newest ``cap`` bug-fix commits;
    0 if its last change is older than ``as_of - stable_days``; otherwise
    (recent, or never committed) the file is left out.  ``files`` is the
    working tree of Python files.
    """
    history = history_depth(commits, depth)
    tree = cap_files(files.select("repo", "path"), max_files)
    per_file = file_history(history, commit_files, cap, words)
    ts_type = commits.schema["authored_at"].dataType.simpleString()
    # with a zoned type the moment is UTC, whatever the session's time zone
    moment = F.lit(as_of + "Z" if ts_type == "timestamp" and not re.search(r"(Z|UTC|[+-]\d\d:?\d\d)$", as_of) else as_of)
    cutoff = moment.cast(ts_type) - F.expr(f"INTERVAL {int(stable_days)} DAYS")
    label = (F.when(F.col("buggy") == 1, F.lit(1))
             .when(F.col("last_modified") < cutoff, F.lit(0)))
    return (tree.join(per_file, ["repo", "path"], "inner")
            .select("repo", "path", label.cast("int").alias("label"))
            .where(F.col("label").isNotNull()))


def label_counts(labels: DataFrame) -> DataFrame:
    """Labelled / buggy / clean files per repo."""
    return labels.groupBy("repo").agg(
        F.count(F.lit(1)).cast("long").alias("n_files"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("n_buggy"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("n_clean"),
    )
