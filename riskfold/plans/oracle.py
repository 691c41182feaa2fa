"""DuckDB oracle SQL for every registered query.

Each query's answer is computed independently from the driver's base
tables with closed forms, so the Spark plans (which really parse, join,
window and aggregate) are checked against arithmetic rather than against
themselves.
"""

from __future__ import annotations

from riskfold.schema import DOUBLE_FEATURES, FEATURE_NAMES


def rround(p: str, q: str, digits: int) -> str:
    """SQL for round(p/q, digits) half-to-even on integers (0.0 when q = 0)."""
    s = 10 ** digits
    num = f"(2 * CAST({p} AS BIGINT) * {s} + CAST({q} AS BIGINT))"
    den = f"(2 * CAST({q} AS BIGINT))"
    quot = f"({num} // {den})"
    return (f"(CASE WHEN ({q}) > 0 THEN ({quot} - CASE WHEN {num} % {den} = 0 AND {quot} % 2 = 1 "
            f"THEN 1 ELSE 0 END) / {float(s)} ELSE 0.0 END)")


def r6(expr: str) -> str:
    """The engine-neutral rounding used on both sides (see round_fixed)."""
    return f"(floor(({expr}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE)"


def xmean(col: str) -> str:
    """Mean from an exact decimal sum (see exact_mean)."""
    return f"(CAST(sum(CAST({col} AS DECIMAL(27,10))) AS DOUBLE) / count({col}))"


def _docs(k: str = "k", fn: str = "Fn") -> str:
    return " + ".join(f"(CASE WHEN {fn} > {j} AND ({k} + {j}) % 3 = 0 THEN 1 ELSE 0 END)" for j in range(4))


T1_PARAMS = f"""
t1_p AS (
  SELECT p_partkey AS k, p_size AS z, n_name AS repo, 'src/p' || p_partkey || '.py' AS path,
         CAST(p_partkey % 3 AS BIGINT) AS C, CAST(p_partkey % 5 AS BIGINT) AS I,
         CAST(p_size % 6 AS BIGINT) AS G, CAST(1 + p_partkey % 4 AS BIGINT) AS Fn,
         CAST(p_size % 5 AS BIGINT) AS D,
         CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS s,
         p_partkey % 13 = 0 AS broken
  FROM part JOIN nation ON n_nationkey = p_partkey % 25
), t1_q AS (
  SELECT *, {_docs()} AS docs FROM t1_p
), t1_r AS (
  SELECT *, C + I + s + G + Fn * (3 + D) + docs AS T FROM t1_q
)"""


def _t1_feature_exprs() -> dict[str, str]:
    ok = {
        "total_lines": "T",
        "code_lines": "T - Fn - C",
        "blank_lines": "Fn",
        "comment_lines": "C",
        "comment_ratio": rround("C", "greatest(T, 1)", 4),
        "num_functions": "Fn",
        "num_classes": "0",
        "num_methods": "0",
        "avg_function_length": rround("Fn * (D + 1) + docs", "Fn", 2),
        "max_function_length": "D + 1 + CASE WHEN docs > 0 THEN 1 ELSE 0 END",
        "num_imports": "I + s",
        "num_unique_imports": "I + s",
        "cyclomatic_complexity": "1 + Fn * D",
        "max_nesting_depth": "1 + D",
        "avg_nesting_depth": rround("D + 2", "2", 2),
        "num_branches": "Fn * D",
        "num_loops": "0",
        "num_try_except": "0",
        "num_assertions": "0",
        "num_lambda_functions": "0",
        "has_docstrings": "CASE WHEN docs > 0 THEN 1 ELSE 0 END",
        "docstring_coverage": rround("docs", "Fn", 4),
        "has_type_hints": "1",
        "type_hint_coverage": "0.5",
        "avg_identifier_length": rround("24 * Fn + 5 * D * Fn + 6 * G", "5 * Fn + D * Fn + G", 2),
        "num_global_variables": "G",
        "num_nested_functions": "0",
        "num_return_statements": "Fn",
        "uses_star_import": "s",
        "syntax_error": "0",
    }
    broken = {
        "total_lines": "T + 1",
        "code_lines": "T + 1 - Fn - C",
        "blank_lines": "Fn",
        "comment_lines": "C",
        "comment_ratio": rround("C", "T + 1", 4),
        "cyclomatic_complexity": "1",
        "syntax_error": "1",
    }
    out = {}
    for f in FEATURE_NAMES:
        typ = "DOUBLE" if f in DOUBLE_FEATURES else "INTEGER"
        b = broken.get(f, "0")
        out[f] = f"CAST(CASE WHEN broken THEN {b} ELSE {ok[f]} END AS {typ})"
    return out


T1_FEATURES_CTE = T1_PARAMS + """,
t1_features AS (
  SELECT repo, path, """ + ",\n         ".join(f"{e} AS {f}" for f, e in _t1_feature_exprs().items()) + """
  FROM t1_r
)"""


def features_t1() -> str:
    cols = ", ".join(FEATURE_NAMES)
    return f"WITH {T1_FEATURES_CTE}\nSELECT repo, path, {cols} FROM t1_features"


# --- T6: modules of repeated blocks ---------------------------------------------

# What one copy of a block adds, counted by hand from its text: a class with
# methods (ca), a function (cb), a lambda with an async function (cc), three
# plain imports (cd), a star import (ce), a module docstring (ch).
T6_COUNTS = {
    #                 ca  cb  cc  cd ce ch
    "lines":         (15, 17, 7, 2, 1, 1),
    "blank":         (3, 2, 0, 0, 0, 0),
    "comments":      (1, 1, 0, 0, 0, 0),
    "functions":     (0, 2, 1, 0, 0, 0),
    "classes":       (1, 0, 0, 0, 0, 0),
    "methods":       (2, 0, 0, 0, 0, 0),
    "length":        (7, 16, 3, 0, 0, 0),
    "imports":       (0, 0, 0, 3, 1, 0),
    "paths":         (5, 6, 2, 0, 0, 0),
    "depth":         (12, 13, 3, 0, 0, 0),
    "nested":        (5, 6, 2, 0, 0, 0),
    "branches":      (2, 0, 1, 0, 0, 0),
    "loops":         (1, 2, 0, 0, 0, 0),
    "tries":         (0, 1, 0, 0, 0, 0),
    "asserts":       (0, 1, 0, 0, 0, 0),
    "lambdas":       (0, 0, 1, 0, 0, 0),
    "documented":    (0, 1, 0, 0, 0, 0),
    "parameters":    (5, 3, 2, 0, 0, 0),
    "typed":         (1, 1, 2, 0, 0, 0),
    "name_chars":    (81, 102, 27, 0, 0, 0),
    "names":         (20, 19, 7, 0, 0, 0),
    "module_values": (0, 0, 3, 0, 0, 0),
    "inside":        (0, 1, 0, 0, 0, 0),
    "returns":       (3, 2, 0, 0, 0, 0),
}


def features_constructs() -> str:
    blocks = ["ca", "cb", "cc", "cd", "ce", "ch"]
    counts = ", ".join(f"({' + '.join(f'{n} * {b}' for n, b in zip(per, blocks, strict=True))}) AS {name}" for name, per in T6_COUNTS.items())
    greatest = lambda a, b, c: f"greatest(CASE WHEN ca > 0 THEN {a} ELSE 0 END, CASE WHEN cb > 0 THEN {b} ELSE 0 END, CASE WHEN cc > 0 THEN {c} ELSE 0 END)"
    every = "(functions + methods)"
    values = {
        "total_lines": "lines", "code_lines": "lines - blank - comments", "blank_lines": "blank", "comment_lines": "comments",
        "comment_ratio": rround("comments", "greatest(lines, 1)", 4), "num_functions": "functions", "num_classes": "classes",
        "num_methods": "methods", "avg_function_length": rround("length", every, 2), "max_function_length": greatest(5, 15, 3),
        "num_imports": "imports", "num_unique_imports": "CASE WHEN cd > 0 THEN 3 ELSE 0 END + ce", "cyclomatic_complexity": "1 + paths",
        "max_nesting_depth": greatest(4, 3, 3), "avg_nesting_depth": rround("depth", "nested", 2), "num_branches": "branches",
        "num_loops": "loops", "num_try_except": "tries", "num_assertions": "asserts", "num_lambda_functions": "lambdas",
        "has_docstrings": "CASE WHEN ch + documented > 0 THEN 1 ELSE 0 END", "docstring_coverage": rround("documented", every, 4),
        "has_type_hints": "CASE WHEN typed > 0 THEN 1 ELSE 0 END", "type_hint_coverage": rround("typed", "parameters", 4),
        "avg_identifier_length": rround("name_chars", "names", 2), "num_global_variables": "module_values",
        "num_nested_functions": "inside", "num_return_statements": "returns", "uses_star_import": "ce", "syntax_error": "0",
    }
    cols = ", ".join(f"CAST({values[f]} AS {'DOUBLE' if f in DOUBLE_FEATURES else 'INTEGER'}) AS {f}" for f in FEATURE_NAMES)
    return f"""WITH t6 AS (
  SELECT n_name AS repo, 'src/c' || p_partkey || '.py' AS path, p_partkey % 3 AS ca, p_partkey % 4 AS cb, p_size % 5 AS cc,
         p_size % 3 AS cd, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS ce, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS ch
  FROM part JOIN nation ON n_nationkey = p_partkey % 25
), sums AS (SELECT *, {counts} FROM t6)
SELECT repo, path, {cols} FROM sums"""


# --- T5: documents as sources -------------------------------------------------

def line_features_documents() -> str:
    return r"""
WITH d AS (
  SELECT source AS repo, 'doc/' || doc_id AS path, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT repo, path, t, string_split(t, chr(10)) AS pieces, CASE WHEN t LIKE '%' || chr(10) THEN 1 ELSE 0 END AS tail
  FROM d
)
SELECT repo, path,
  CAST(CASE WHEN t = '' THEN 0 ELSE len(pieces) - tail END AS INTEGER) AS total_lines,
  CAST(CASE WHEN t = '' THEN 0 ELSE
    len(list_filter(pieces, lambda x: regexp_full_match(x, '[ \t\r\x0B\x0C]*'))) - tail END AS INTEGER) AS blank_lines
FROM s"""


# --- T2: commit history -------------------------------------------------------

T2_CTE = """
t2_li AS (
  SELECT n_name AS repo, l_orderkey AS commit_id, l_partkey FROM lineitem JOIN nation ON n_nationkey = l_partkey % 25
), t2_files AS (
  SELECT DISTINCT repo, commit_id,
         'src/p' || l_partkey || CASE WHEN l_partkey % 7 = 0 THEN '.md' ELSE '.py' END AS path
  FROM t2_li
), t2_commits AS (
  SELECT c.repo, c.commit_id,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_custkey % 10 = 0 THEN 'Fix crash in module'
              WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' AND o_custkey % 50 = 1 THEN 'prefix cleanup'
              ELSE 'Add feature' END AS message,
         o_orderdate AS authored_at, o_orderdate AS committed_at,
         CAST(CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_parents
  FROM (SELECT DISTINCT repo, commit_id FROM t2_li) c JOIN orders ON o_orderkey = c.commit_id
), t2_tree AS (
  SELECT n_name AS repo, 'src/p' || p_partkey || '.py' AS path FROM part JOIN nation ON n_nationkey = p_partkey % 25
)"""

BUG_RE = "(fix|bug|patch|error|issue|crash|resolve|hotfix|repair|workaround|incorrect)"


def _bugfix(cap: int | None, src: str = "t2_commits") -> str:
    fixes = f"SELECT * FROM {src} WHERE regexp_matches(lower(message), '{BUG_RE}')"
    if cap is None:
        return fixes
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY committed_at DESC, commit_id) AS rn "
            f"FROM ({fixes})) WHERE rn <= {cap}")


def _depth(depth: int | None) -> str:
    if depth is None:
        return "SELECT * FROM t2_commits"
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY committed_at DESC, commit_id) AS rn "
            f"FROM t2_commits) WHERE rn <= {depth}")


def file_cap(n: int) -> str:
    return f"""WITH {T2_CTE}
SELECT repo, path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn FROM t2_tree) WHERE rn <= {n}"""


def bug_fix_commits() -> str:
    return f"WITH {T2_CTE}\nSELECT repo, commit_id, message FROM ({_bugfix(None)})"


def newest_bug_fixes(cap: int) -> str:
    return f"WITH {T2_CTE}\nSELECT repo, commit_id FROM ({_bugfix(cap)})"


def history_depth(depth: int) -> str:
    return f"WITH {T2_CTE}\nSELECT repo, commit_id FROM ({_depth(depth)})"


def changed_py_files() -> str:
    return f"""WITH {T2_CTE}
SELECT f.repo, f.commit_id, f.path FROM t2_files f JOIN t2_commits c USING (repo, commit_id)
WHERE f.path LIKE '%.py' AND c.n_parents <= 1"""


def _buggy(cap, src="t2_commits") -> str:
    return f"""SELECT DISTINCT f.repo, f.path FROM t2_files f
  JOIN ({_bugfix(cap, src)}) b USING (repo, commit_id)
  WHERE f.path LIKE '%.py' AND b.n_parents <= 1"""


def buggy_paths(cap: int | None) -> str:
    return f"WITH {T2_CTE}\n{_buggy(cap)}"


def _last_mod(src="t2_commits") -> str:
    return f"""SELECT f.repo, f.path, arg_max(c.authored_at, {{'at': c.committed_at, 'id': c.commit_id}}) AS last_modified
  FROM t2_files f JOIN {src} c USING (repo, commit_id) WHERE c.n_parents <= 1 GROUP BY f.repo, f.path"""


def last_modified() -> str:
    return f"WITH {T2_CTE}\n{_last_mod()}"


AS_OF_SQL = "TIMESTAMP '2001-07-31 00:00:00'"


def labels_cte(max_files: int | None, cap: int | None, depth: int | None = None) -> str:
    tree = "t2_tree" if max_files is None else (
        f"(SELECT repo, path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn FROM t2_tree) "
        f"WHERE rn <= {max_files})")
    return f"""{T2_CTE},
hist AS ({_depth(depth)}),
buggy AS ({_buggy(cap, 'hist')}),
lastmod AS ({_last_mod('hist')}),
labels AS (
  SELECT * FROM (
    SELECT t.repo, t.path,
           CAST(CASE WHEN b.path IS NOT NULL THEN 1
                     WHEN l.last_modified < {AS_OF_SQL} - INTERVAL 30 DAYS THEN 0 END AS INTEGER) AS label
    FROM {tree} t
    LEFT JOIN buggy b ON b.repo = t.repo AND b.path = t.path
    LEFT JOIN lastmod l ON l.repo = t.repo AND l.path = t.path
  ) WHERE label IS NOT NULL
)"""


def file_labels(max_files: int | None, cap: int | None, depth: int | None = None) -> str:
    return f"WITH {labels_cte(max_files, cap, depth)}\nSELECT repo, path, label FROM labels"


def label_counts(max_files: int | None, cap: int | None) -> str:
    return f"""WITH {labels_cte(max_files, cap)}
SELECT repo, CAST(count(*) AS BIGINT) AS n_files,
       CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_buggy,
       CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_clean
FROM labels GROUP BY repo"""


# --- T3: labelled feature table -------------------------------------------------

def t3_cte() -> str:
    cols = ", ".join(f"CAST(f.{c} AS DOUBLE) AS {c}" for c in FEATURE_NAMES)
    return f"""{T1_FEATURES_CTE},
{labels_cte(None, None).lstrip()},
t3 AS (SELECT f.repo, f.path, {cols}, l.label FROM t1_features f JOIN labels l ON l.repo = f.repo AND l.path = f.path)"""


def dataset_rows() -> str:
    return f"WITH {t3_cte()}\nSELECT * FROM t3"


def class_balance() -> str:
    return f"""WITH {t3_cte()}
SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(sum(label) AS BIGINT) AS n_buggy,
       {r6("100.0 * sum(label) / greatest(count(*), 1)")} AS pct_buggy,
       CAST(count(*) - sum(label) AS BIGINT) AS n_clean,
       {r6("100.0 * (count(*) - sum(label)) / greatest(count(*), 1)")} AS pct_clean
FROM t3"""


def feature_ranges() -> str:
    parts = [f"SELECT '{f}' AS feature, CAST(min({f}) AS DOUBLE) AS min, {r6(xmean(f))} AS mean, "
             f"CAST(max({f}) AS DOUBLE) AS max FROM t3" for f in FEATURE_NAMES]
    return f"WITH {t3_cte()}\n" + "\nUNION ALL ".join(parts)


def feature_profile() -> str:
    parts = [f"""SELECT '{f}' AS feature, {i} AS idx, CAST(count({f}) AS BIGINT) AS count, {r6(xmean(f))} AS mean,
       {r6(f"stddev_samp({f})")} AS std, CAST(min({f}) AS DOUBLE) AS min,
       {r6(f"quantile_cont({f}, 0.25)")} AS p25, {r6(f"quantile_cont({f}, 0.5)")} AS p50,
       {r6(f"quantile_cont({f}, 0.75)")} AS p75, CAST(max({f}) AS DOUBLE) AS max FROM t3"""
             for i, f in enumerate(FEATURE_NAMES)]
    return f"WITH {t3_cte()}\n" + "\nUNION ALL ".join(parts)


def class_distribution() -> str:
    return f"""WITH {t3_cte()}
SELECT label, CAST(count(*) AS BIGINT) AS n, {r6("count(*) / sum(count(*)) OVER ()")} AS share FROM t3 GROUP BY label"""


def class_histogram(feature: str, bins: int = 30) -> str:
    return f"""WITH {t3_cte()},
rng AS (
  SELECT label, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
         CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
  FROM (SELECT label, CAST({feature} AS DOUBLE) AS v FROM t3) GROUP BY label
), binned AS (
  SELECT t.label, CAST(least(floor({float(bins)} * (CAST(t.{feature} AS DOUBLE) - r.lo) / (r.hi - r.lo)), {bins - 1}) AS INTEGER) AS bin
  FROM t3 t JOIN rng r USING (label)
), counts AS (SELECT label, bin, count(*) AS n FROM binned GROUP BY label, bin),
grid AS (SELECT label, lo, hi, CAST(b AS INTEGER) AS bin FROM rng, range(0, {bins}) AS g(b))
SELECT g.label, g.bin,
       {r6(f"g.lo + g.bin * ((g.hi - g.lo) / {float(bins)})")} AS bin_lo,
       {r6(f"g.lo + (g.bin + 1) * ((g.hi - g.lo) / {float(bins)})")} AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN counts c ON c.label = g.label AND c.bin = g.bin"""


def _corr_sql(a: str, b: str) -> str:
    return (f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 0 "
            f"THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")


def _label_corr_parts() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, {i} AS idx, {r6(_corr_sql(f'CAST({f} AS DOUBLE)', 'CAST(label AS DOUBLE)'))} AS corr FROM t3"
        for i, f in enumerate(FEATURE_NAMES))


def label_correlation() -> str:
    return f"WITH {t3_cte()}\n{_label_corr_parts()}"


def correlation_matrix(k: int = 12) -> str:
    cols = ", ".join(FEATURE_NAMES)
    return f"""WITH {t3_cte()},
lc AS ({_label_corr_parts()}),
top AS (SELECT feature FROM lc ORDER BY abs(corr) DESC NULLS LAST, idx LIMIT {k}),
wide AS (SELECT row_number() OVER () AS rid, {cols} FROM t3),
long AS (UNPIVOT wide ON {cols} INTO NAME feature VALUE value),
lt AS (SELECT rid, feature, CAST(value AS DOUBLE) AS value FROM long WHERE feature IN (SELECT feature FROM top))
SELECT a.feature AS f1, b.feature AS f2, {r6(_corr_sql('a.value', 'b.value'))} AS r
FROM lt a JOIN lt b ON a.rid = b.rid GROUP BY a.feature, b.feature"""


def class_weights() -> str:
    return f"""WITH {t3_cte()}
SELECT label, CAST(count(*) AS BIGINT) AS n,
       sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
FROM t3 GROUP BY label"""


def _md5_key(col: str, seed: str = "42") -> str:
    return f"CAST(('0x' || substr(md5({col} || '-{seed}'), 1, 8)) AS BIGINT)"


def stratified_split(test_size: float = 0.2) -> str:
    return f"""WITH {t3_cte()},
r AS (SELECT repo, path, label,
        row_number() OVER (PARTITION BY label ORDER BY {_md5_key("repo || '/' || path")}, repo, path) AS rk,
        count(*) OVER (PARTITION BY label) AS n_label FROM t3)
SELECT repo, path, label, CASE WHEN rk <= round({test_size} * n_label) THEN 'test' ELSE 'train' END AS split FROM r"""


def stratified_folds(k: int = 5) -> str:
    return f"""WITH {t3_cte()},
r AS (SELECT repo, path, label,
        row_number() OVER (PARTITION BY label ORDER BY {_md5_key("repo || '/' || path")}, repo, path) AS rk FROM t3)
SELECT repo, path, label, CAST((rk - 1) % {k} AS INTEGER) AS fold FROM r"""


# --- T4: predictions ----------------------------------------------------------------

T4_CTE = """
t4 AS (
  SELECT 'src/p' || p_partkey || '.py' AS path, CAST(CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS INTEGER) AS label,
         CASE WHEN p_partkey % 101 = 0 THEN NULL ELSE CAST((p_partkey * 37) % 1000 AS DOUBLE) / 1000.0 END AS score,
         CAST(p_partkey % 5 AS INTEGER) AS fold
  FROM part
), t4p AS (
  SELECT *, CAST(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM t4 WHERE score IS NOT NULL
), t4m AS (
  SELECT 'score_model' AS model, 0 AS model_pos, fold, path, label, prediction, score FROM t4p
  UNION ALL
  SELECT 'flipped_model' AS model, 1 AS model_pos, fold, path, label,
         CAST(CASE WHEN 1 - score >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction, 1 - score AS score FROM t4p
)"""


def _gsel(by: list[str]) -> str:
    return "".join(f"{b}, " for b in by)


def _cm(src: str, by: list[str]) -> str:
    g = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""SELECT {_gsel(by)}
    CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM {src} {g}"""


def _r(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END)"


def _metrics_cte(src: str, by: list[str]) -> str:
    """cm -> cs (per class) -> mt (all metrics) for groups ``by``."""
    return f"""cm AS ({_cm(src, by)}),
cs AS (
  SELECT *,
    {_r('tn', 'tn + fn')} AS precision_clean, {_r('tn', 'tn + fp')} AS recall_clean,
    {_r('2 * tn', '2 * tn + fn + fp')} AS f1_clean, tn + fp AS support_clean,
    {_r('tp', 'tp + fp')} AS precision_buggy, {_r('tp', 'tp + fn')} AS recall_buggy,
    {_r('2 * tp', '2 * tp + fp + fn')} AS f1_buggy, tp + fn AS support_buggy,
    tn + fp + fn + tp AS n, (tn + fp + fn) > 0 AS has_clean, (tp + fp + fn) > 0 AS has_buggy,
    NOT ((tn + fp + fn) > 0 AND (tp + fp + fn) > 0) AS one_class
  FROM cm
), mt AS (
  SELECT *,
    {_r('tn + tp', 'n')} AS accuracy,
    {_r('precision_clean * support_clean + precision_buggy * support_buggy', 'n')} AS precision_weighted,
    {_r('recall_clean * support_clean + recall_buggy * support_buggy', 'n')} AS recall_weighted,
    {_r('f1_clean * support_clean + f1_buggy * support_buggy', 'n')} AS f1_weighted,
    {_r('(CASE WHEN has_clean THEN precision_clean ELSE 0.0 END) + (CASE WHEN has_buggy THEN precision_buggy ELSE 0.0 END)', 'CAST(has_clean AS INTEGER) + CAST(has_buggy AS INTEGER)')} AS precision_macro,
    {_r('(CASE WHEN has_clean THEN recall_clean ELSE 0.0 END) + (CASE WHEN has_buggy THEN recall_buggy ELSE 0.0 END)', 'CAST(has_clean AS INTEGER) + CAST(has_buggy AS INTEGER)')} AS recall_macro,
    {_r('(CASE WHEN has_clean THEN f1_clean ELSE 0.0 END) + (CASE WHEN has_buggy THEN f1_buggy ELSE 0.0 END)', 'CAST(has_clean AS INTEGER) + CAST(has_buggy AS INTEGER)')} AS f1_macro,
    CASE WHEN one_class THEN 0 ELSE tn END AS true_negatives,
    CASE WHEN one_class THEN 0 ELSE fp END AS false_positives,
    CASE WHEN one_class THEN 0 ELSE fn END AS false_negatives,
    CASE WHEN one_class THEN 0 ELSE tp END AS true_positives
  FROM cs
)"""


def _auc_cte(src: str, by: list[str]) -> str:
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    g = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""sc AS (
  SELECT {_gsel(by)} score, sum(label) AS n_pos, sum(1 - label) AS n_neg FROM {src} GROUP BY {_gsel(by)} score
), cu AS (
  SELECT *, coalesce(sum(n_neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM sc
), auc AS (
  SELECT {_gsel(by)} CASE WHEN sum(n_pos) > 0 AND sum(n_neg) > 0 THEN
      CAST(sum(n_pos * (neg_below + n_neg * 0.5::DOUBLE)) AS DOUBLE) / CAST(sum(n_pos) * sum(n_neg) AS DOUBLE) END AS roc_auc
  FROM cu {g}
)"""


def confusion_counts() -> str:
    return f"""WITH {T4_CTE}, {_metrics_cte('t4p', [])}
SELECT tn, fp, fn, tp, one_class, true_negatives, false_positives, false_negatives, true_positives FROM mt"""


def normalized_confusion() -> str:
    return f"""WITH {T4_CTE}, cm AS ({_cm('t4p', [])})
SELECT 0 AS actual, 0 AS predicted, tn AS n, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS share FROM cm
UNION ALL SELECT 0, 1, fp, CASE WHEN tn + fp > 0 THEN fp / (tn + fp) END FROM cm
UNION ALL SELECT 1, 0, fn, CASE WHEN fn + tp > 0 THEN fn / (fn + tp) END FROM cm
UNION ALL SELECT 1, 1, tp, CASE WHEN fn + tp > 0 THEN tp / (fn + tp) END FROM cm"""


CLASS_METRIC_COLS = ("accuracy, precision_clean, recall_clean, f1_clean, support_clean, precision_buggy, recall_buggy, "
                     "f1_buggy, support_buggy, precision_weighted, recall_weighted, f1_weighted, precision_macro, "
                     "recall_macro, f1_macro, true_negatives, false_positives, false_negatives, true_positives")


def class_metrics() -> str:
    return f"WITH {T4_CTE}, {_metrics_cte('t4p', [])}\nSELECT {CLASS_METRIC_COLS} FROM mt"


def classification_report() -> str:
    return f"""WITH {T4_CTE}, {_metrics_cte('t4p', [])}
SELECT 'clean' AS class, precision_clean AS precision, recall_clean AS recall, f1_clean AS f1, CAST(support_clean AS BIGINT) AS support FROM mt
UNION ALL SELECT 'buggy', precision_buggy, recall_buggy, f1_buggy, CAST(support_buggy AS BIGINT) FROM mt
UNION ALL SELECT 'accuracy', NULL, NULL, accuracy, CAST(n AS BIGINT) FROM mt
UNION ALL SELECT 'macro avg', precision_macro, recall_macro, f1_macro, CAST(n AS BIGINT) FROM mt
UNION ALL SELECT 'weighted avg', precision_weighted, recall_weighted, f1_weighted, CAST(n AS BIGINT) FROM mt"""


def roc_auc() -> str:
    return f"WITH {T4_CTE}, {_auc_cte('t4p', [])}\nSELECT roc_auc FROM auc"


def roc_curve() -> str:
    return f"""WITH {T4_CTE},
sc AS (SELECT score, sum(label) AS n_pos, sum(1 - label) AS n_neg FROM t4p GROUP BY score),
tot AS (SELECT sum(n_pos) AS P, sum(n_neg) AS N FROM sc),
cu AS (SELECT score, sum(n_pos) OVER (ORDER BY score DESC) AS cp, sum(n_neg) OVER (ORDER BY score DESC) AS cn FROM sc)
SELECT 'Infinity'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT score, CASE WHEN N > 0 THEN cn / N END, CASE WHEN P > 0 THEN cp / P END FROM cu, tot"""


FOLD_COLS = ("accuracy, f1_weighted AS f1, f1_weighted, f1_macro, f1_buggy, precision_weighted, recall_weighted, "
             "roc_auc, true_negatives, false_positives, false_negatives, true_positives")
FOLD_METRICS = ["accuracy", "f1", "f1_weighted", "f1_macro", "f1_buggy", "precision_weighted", "recall_weighted",
                "roc_auc", "true_negatives", "false_positives", "false_negatives", "true_positives"]


def fold_metrics() -> str:
    by = ["model", "fold"]
    return f"""WITH {T4_CTE}, {_metrics_cte('t4m', by)}, {_auc_cte('t4m', by)}
SELECT mt.model, mt.fold, {FOLD_COLS} FROM mt JOIN auc ON auc.model = mt.model AND auc.fold = mt.fold"""


def cv_summary() -> str:
    by = ["model", "fold"]
    unions = "\nUNION ALL ".join(f"SELECT model, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM fm" for m in FOLD_METRICS)
    return f"""WITH {T4_CTE}, {_metrics_cte('t4m', by)}, {_auc_cte('t4m', by)},
fm AS (SELECT mt.model, mt.fold, {FOLD_COLS} FROM mt JOIN auc ON auc.model = mt.model AND auc.fold = mt.fold),
lg AS ({unions})
SELECT model, metric, {r6(xmean("value"))} AS mean, {r6("stddev_pop(value)")} AS std, CAST(count(*) AS BIGINT) AS n_folds
FROM lg GROUP BY model, metric"""


def model_comparison() -> str:
    by = ["model"]
    return f"""WITH {T4_CTE}, {_metrics_cte('t4m', by)}, {_auc_cte('t4m', by)}
SELECT mt.model, accuracy, f1_weighted, roc_auc, precision_weighted, recall_weighted
FROM mt JOIN auc ON auc.model = mt.model"""


def select_best() -> str:
    by = ["model", "model_pos"]
    return f"""WITH {T4_CTE}, {_metrics_cte('t4m', by)}
SELECT model, f1_weighted AS best_f1 FROM mt ORDER BY f1_weighted DESC NULLS LAST, model_pos LIMIT 1"""


# --- P2-P10, S8, S9: scored report (T1 features + T4 scores) --------------------

def scored_cte() -> str:
    return f"""{T1_FEATURES_CTE}, {T4_CTE[1:]},
scored AS (
  SELECT f.*, t.score, CASE WHEN t.score IS NULL THEN 'analysis failed' END AS error
  FROM t1_features f JOIN t4 t ON t.path = f.path
)"""


def _level(s: str = "score") -> str:
    return (f"CASE WHEN {s} IS NULL THEN 'Error' WHEN {s} < 0.3 THEN 'Low' WHEN {s} < 0.6 THEN 'Medium' "
            f"WHEN {s} < 0.8 THEN 'High' ELSE 'Critical' END")


def risk_report() -> str:
    return f"""WITH {scored_cte()}
SELECT repo, path AS file_path, round_even(score, 4) AS risk_score, {_level()} AS risk_level,
       CASE WHEN score IS NULL THEN NULL ELSE score >= 0.6 END AS flagged, error FROM scored"""


def ranked_report() -> str:
    return f"""WITH {scored_cte()}
SELECT repo, path, score, CAST(row_number() OVER (ORDER BY coalesce(score, 0.0) DESC, repo, path) AS BIGINT) AS rank FROM scored"""


def top_risk(k: int) -> str:
    return f"""WITH {scored_cte()}
SELECT repo, path, score FROM scored ORDER BY coalesce(score, 0.0) DESC, repo, path LIMIT {k}"""


def report_footer() -> str:
    return f"""WITH {scored_cte()}
SELECT CAST(count(*) AS BIGINT) AS n_files, CAST(sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged FROM scored"""


def batch_summary() -> str:
    return f"""WITH {scored_cte()}
SELECT CAST(count(*) AS BIGINT) AS n_valid, {r6(xmean("score"))} AS mean_score,
       CAST(sum(CASE WHEN {_level()} IN ('High', 'Critical') THEN 1 ELSE 0 END) AS BIGINT) AS n_high_critical,
       CAST(sum(CASE WHEN {_level()} = 'Low' THEN 1 ELSE 0 END) AS BIGINT) AS n_low
FROM scored WHERE score IS NOT NULL"""


def _batch_select() -> str:
    return f"""SELECT repo, path AS filename, score AS risk_score, {_level()} AS risk_level,
       CAST(CASE WHEN score IS NULL THEN 0 ELSE total_lines END AS INTEGER) AS lines,
       CAST(CASE WHEN score IS NULL THEN 0 ELSE cyclomatic_complexity END AS INTEGER) AS complexity,
       CAST(CASE WHEN score IS NULL THEN 0.0 ELSE docstring_coverage END AS DOUBLE) AS docstring_cov"""


def batch_rows() -> str:
    return f"WITH {scored_cte()}\n{_batch_select()}, error FROM scored"


def batch_csv_rows() -> str:
    return f"WITH {scored_cte()}\n{_batch_select()} FROM scored WHERE score IS NOT NULL"


def report_table() -> str:
    feats = ", ".join(f for f in FEATURE_NAMES if f != "syntax_error")
    return f"""WITH {scored_cte()}
SELECT repo, path AS file_path, round_even(score, 4) AS risk_score, {_level()} AS risk_level,
       CASE WHEN score IS NULL THEN NULL ELSE score >= 0.6 END AS flagged, {feats} FROM scored"""


def risk_histogram(bins: int = 30) -> str:
    return f"""WITH {scored_cte()},
v AS (SELECT score AS v FROM scored WHERE score IS NOT NULL),
rng AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
               CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
counts AS (SELECT CAST(least(floor({float(bins)} * (v - lo) / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
           FROM v, rng GROUP BY 1),
grid AS (SELECT CAST(b AS INTEGER) AS bin, lo, hi, lo + CAST(b AS INTEGER) * ((hi - lo) / {float(bins)}) AS lft
         FROM rng, range(0, {bins}) AS g(b))
SELECT g.bin, {r6("lft")} AS bin_lo, {r6(f"lo + (g.bin + 1) * ((hi - lo) / {float(bins)})")} AS bin_hi,
       CASE WHEN lft < 0.3 THEN 'Low' WHEN lft < 0.6 THEN 'Medium' WHEN lft < 0.8 THEN 'High' ELSE 'Critical' END AS zone,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN counts c ON c.bin = g.bin"""


# --- X1-X6: explanations over T1 features ------------------------------------------

def _values(rows: list[tuple]) -> str:
    def lit(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, (int, float)):
            return repr(float(x))
        return "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


def feature_status() -> str:
    from riskfold.operators.explain import FEATURE_LABELS, STATUS_THRESHOLDS
    feats = [f for f in FEATURE_NAMES if f != "syntax_error"]
    long = "\nUNION ALL ".join(f"SELECT repo, path, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM t1_features" for f in feats)
    th = _values([(f, w, d, h) for f, (w, d, h) in STATUS_THRESHOLDS.items()])
    lb = _values(list(FEATURE_LABELS.items()))
    return f"""WITH {T1_FEATURES_CTE},
lg AS ({long}),
th(feature, warn, danger, hiw) AS (VALUES {th}),
lb(feature, label) AS (VALUES {lb})
SELECT lg.repo, lg.path, lg.feature, lb.label, lg.value,
  CASE WHEN th.warn IS NULL THEN '—'
       WHEN th.hiw THEN CASE WHEN lg.value <= th.warn THEN 'Healthy' WHEN lg.value <= th.danger THEN 'Warning' ELSE 'Danger' END
       ELSE CASE WHEN lg.value >= th.warn THEN 'Healthy' WHEN lg.value >= th.danger THEN 'Warning' ELSE 'Danger' END END AS status
FROM lg JOIN lb ON lb.feature = lg.feature LEFT JOIN th ON th.feature = lg.feature"""


# the advice limits, written out apart from the engine's own table
_RULES = {
    "cyclomatic_complexity": "> 15.0", "max_nesting_depth": "> 4.0", "docstring_coverage": "< 0.5", "comment_ratio": "< 0.08",
    "type_hint_coverage": "< 0.4", "uses_star_import": ">= 1.0", "avg_function_length": "> 30.0", "num_global_variables": "> 4.0",
    "num_nested_functions": "> 3.0",
}


def _rule_cases() -> list[tuple[str, str]]:
    return [(rule, f"coalesce(CAST({rule} AS DOUBLE), 0.0) {test}") for rule, test in _RULES.items()]


def recommendations() -> str:
    parts = ", ".join(f"CASE WHEN {cond} THEN '{rule}' END" for rule, cond in _rule_cases())
    n = " + ".join(f"(CASE WHEN {cond} THEN 1 ELSE 0 END)" for _, cond in _rule_cases())
    return f"""WITH {T1_FEATURES_CTE}
SELECT repo, path, concat_ws(',', {parts}) AS rule_ids, CAST({n} AS INTEGER) AS n_rules FROM t1_features"""


def recommendation_counts() -> str:
    unions = "\nUNION ALL ".join(f"SELECT '{rule}' AS rule_id FROM t1_features WHERE {cond}" for rule, cond in _rule_cases())
    return f"""WITH {T1_FEATURES_CTE}
SELECT rule_id, CAST(count(*) AS BIGINT) AS n_files FROM ({unions}) GROUP BY rule_id"""


def radar_values() -> str:
    # axis, the upper end of its danger band (None: open), and whether high is good
    axes = [("cyclomatic_complexity", None, False), ("max_nesting_depth", None, False), ("comment_ratio", 0.05, True),
            ("docstring_coverage", 0.3, True), ("type_hint_coverage", 0.3, True), ("avg_function_length", None, False),
            ("num_global_variables", None, False), ("uses_star_import", 1.0, False)]
    parts = []
    for i, (f, hi, good) in enumerate(axes):
        v = f"CAST({f} AS DOUBLE)"
        top = f"{hi}" if hi is not None else f"greatest({v} * 2, 1.0)"
        norm = f"least(greatest({v} / greatest({top}, 1e-9), 0.0), 1.0)"
        if good:
            norm = f"1.0 - {norm}"
        parts.append(f"SELECT repo, path, '{f}' AS feature, {i} AS axis, {r6(norm)} AS radar_value FROM t1_features")
    return f"WITH {T1_FEATURES_CTE}\n" + "\nUNION ALL ".join(parts)


# --- S12: generator ------------------------------------------------------------------

def _dbl(x) -> str:
    return f"{float(x)!r}::DOUBLE"


def synthetic_dataset(seed: str = "42", ratio: float = 0.35) -> str:
    import math

    from riskfold.sources.generate import DISTRIBUTIONS, NORMAL_COLUMNS

    def u(name):
        return f"(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '-{seed}-{name}'), 1, 8)) AS BIGINT) / 4294967296.0)"

    def val(spec, name, cls):
        k = spec[0]
        if k == "int":
            return f"CAST({_dbl(spec[1])} + floor({u(name)} * {spec[2] - spec[1]!r}) AS DOUBLE)"
        if k == "uni":
            return f"({_dbl(spec[1])} + {u(name)} * {_dbl(spec[2] - spec[1])})"
        if k == "times":
            base = DISTRIBUTIONS[spec[1]][cls]
            return f"({val(base, spec[1], cls)} * ({_dbl(spec[2])} + {u(name)} * {_dbl(spec[3] - spec[2])}))"
        if k == "ratio":
            return (f"({val(DISTRIBUTIONS[spec[1]][cls], spec[1], cls)} / "
                    f"{val(DISTRIBUTIONS[spec[2]][cls], spec[2], cls)})")
        if k == "bern":
            return f"(CASE WHEN {u(name)} < {_dbl(spec[1])} THEN 1.0 ELSE 0.0 END)"
        if k == "norm":
            mu, sd, lo, hi = spec[1:]
            z = f"(sqrt(-2.0 * ln(1.0 - {u(name + '-a')})) * cos({_dbl(2 * math.pi)} * {u(name + '-b')}))"
            return f"least(greatest({_dbl(mu)} + {_dbl(sd)} * {z}, {_dbl(lo)}), {_dbl(hi)})"
        if k == "const":
            return _dbl(spec[1])
        raise ValueError(k)

    cols = []
    for name in FEATURE_NAMES:
        clean, buggy = DISTRIBUTIONS[name]
        e = f"CAST(CASE WHEN label = 1 THEN {val(buggy, name, 1)} ELSE {val(clean, name, 0)} END AS DOUBLE)"
        if name in NORMAL_COLUMNS:
            e = r6(e)
        cols.append(f"{e} AS {name}")
    key = f"CAST(('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || '-{seed}-class'), 1, 8)) AS BIGINT)"
    return f"""WITH r AS (
  SELECT p_partkey AS id, row_number() OVER (ORDER BY {key}, p_partkey) AS rk, count(*) OVER () AS n FROM part
), l AS (SELECT id, CAST(CASE WHEN rk <= floor(n * {ratio!r}) THEN 1 ELSE 0 END AS INTEGER) AS label FROM r)
SELECT id, {', '.join(cols)}, label FROM l"""


def roc_trapezoid_auc() -> str:
    return f"""WITH {T4_CTE},
sc AS (SELECT score, sum(label) AS n_pos, sum(1 - label) AS n_neg FROM t4p GROUP BY score),
tot AS (SELECT sum(n_pos) AS P, sum(n_neg) AS N FROM sc),
cu AS (SELECT score, sum(n_pos) OVER (ORDER BY score DESC) AS cp, sum(n_neg) OVER (ORDER BY score DESC) AS cn FROM sc),
pts AS (SELECT score, cn / N AS fpr, cp / P AS tpr FROM cu, tot),
seg AS (SELECT fpr, tpr, lag(fpr, 1, 0.0) OVER (ORDER BY score DESC) AS f0, lag(tpr, 1, 0.0) OVER (ORDER BY score DESC) AS t0 FROM pts)
SELECT {r6("sum((fpr - f0) * (tpr + t0) / 2)")} AS auc FROM seg"""


def model_save_load() -> str:
    return f"WITH {T1_PARAMS}\nSELECT repo, path, true AS same_score FROM t1_r"


def feature_table_csv() -> str:
    return f"WITH {t3_cte()}\nSELECT {', '.join(FEATURE_NAMES)}, label FROM t3"


def ast_node_counts() -> str:
    counts = {
        "Module": "1", "Import": "I", "ImportFrom": "s", "Assign": "G",
        "Name": "G + Fn * (D + 2)", "Constant": "G + docs", "FunctionDef": "Fn", "arg": "2 * Fn",
        "Expr": "docs", "If": "Fn * D", "Return": "Fn",
    }
    parts = "\nUNION ALL ".join(f"SELECT repo, path, '{t}' AS node_type, CAST({e} AS INTEGER) AS n FROM t1_r WHERE NOT broken"
                                for t, e in counts.items())
    return f"WITH {T1_PARAMS}\nSELECT * FROM ({parts}) WHERE n > 0"


def hash_split(test_size: float = 0.2) -> str:
    return f"""WITH {t3_cte()}
SELECT repo, path, label,
       CASE WHEN {_md5_key("repo || '/' || path")} / 4294967296.0 < {test_size!r} THEN 'test' ELSE 'train' END AS split FROM t3"""


def mined_dataset() -> str:
    cols = ", ".join(f"CAST(f.{c} AS DOUBLE) AS {c}" for c in FEATURE_NAMES)
    lc = labels_cte(None, None).lstrip()
    return f"""WITH {T1_FEATURES_CTE},
{lc}
SELECT f.repo, f.path, {cols}, l.label FROM t1_features f JOIN labels l ON l.repo = f.repo AND l.path = f.path"""


# --- T7: a label that the features decide -------------------------------------
# A learner that has learned it says the label itself, with the greater score
# for the greater label, so every metric of it follows from the rows alone.

def _t7_cte(test_size: float = 0.2, folds: int | None = None, of_train: bool = True) -> str:
    rank = f"row_number() OVER (PARTITION BY label ORDER BY {_md5_key("repo || '/' || path")}, repo, path)"
    folded = ""
    if folds:
        rows = "t7s WHERE split = 'train'" if of_train else "t7"
        folded = f""",
t7f AS (SELECT repo, path, label, label AS prediction, CAST(label AS DOUBLE) AS score, CAST(({rank} - 1) % {folds} AS INTEGER) AS fold FROM {rows})"""
    return f"""{T1_PARAMS},
t7 AS (SELECT repo, path, CAST(NOT broken AND G >= 3 AS INTEGER) AS label FROM t1_r),
t7r AS (SELECT *, {rank} AS rk, count(*) OVER (PARTITION BY label) AS n_label FROM t7),
t7s AS (SELECT repo, path, label, CASE WHEN rk <= round({test_size} * n_label) THEN 'test' ELSE 'train' END AS split FROM t7r),
t7t AS (SELECT repo, path, label, label AS prediction, CAST(label AS DOUBLE) AS score FROM t7s WHERE split = 'test'){folded}"""


def known_cv_summary(folds: int) -> str:
    unions = "\nUNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM fm" for m in FOLD_METRICS)
    return f"""WITH {_t7_cte(folds=folds)}, {_metrics_cte('t7f', ['fold'])}, {_auc_cte('t7f', ['fold'])},
fm AS (SELECT mt.fold, {FOLD_COLS} FROM mt JOIN auc ON auc.fold = mt.fold),
lg AS ({unions})
SELECT metric, {r6(xmean("value"))} AS mean, {r6("stddev_pop(value)")} AS std, CAST(count(*) AS BIGINT) AS n_folds FROM lg GROUP BY metric"""


def known_out_of_fold(folds: int) -> str:
    return f"""WITH {_t7_cte(folds=folds, of_train=False)}
SELECT 'random_forest' AS model, repo, path, label, fold, prediction, true AS is_share, CAST(1 AS BIGINT) AS times FROM t7f"""


def known_test_metrics(models: list[str]) -> str:
    rows = "\nUNION ALL ".join(f"SELECT '{name}' AS model, {pos} AS model_pos, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM fm"
                               for pos, name in enumerate(models) for m in FOLD_METRICS)
    return f"""WITH {_t7_cte()}, {_metrics_cte('t7t', [])}, {_auc_cte('t7t', [])},
fm AS (SELECT {FOLD_COLS} FROM mt, auc)
SELECT model, CAST(model_pos AS INTEGER) AS model_pos, metric, value FROM ({rows})"""


def known_first_feature(feature: str, listed: int) -> str:
    return f"""SELECT '{feature}' AS feature, {listed} AS n_listed, true AS sums_to_one, true AS leads, CAST(30 AS BIGINT) AS n_features"""


def known_grid(folds: int) -> str:
    """All points learn the label, so the ranking is the order of the points."""
    points = [(d, m, n) for d in (10, 15) for m in (5, 10) for n in (100, 200)]
    rows = ", ".join(f"""({i}, '{{"max_depth": {d}, "min_samples_split": {m}, "n_estimators": {n}}}')""" for i, (d, m, n) in enumerate(points))
    return f"""SELECT CAST(i AS INTEGER) AS point, params, 1.0::DOUBLE AS mean_f1, 0.0::DOUBLE AS std_f1, CAST(i + 1 AS INTEGER) AS rank,
       CASE WHEN i = 0 THEN 1.0::DOUBLE END AS test_accuracy, CASE WHEN i = 0 THEN 1.0::DOUBLE END AS test_f1,
       CASE WHEN i = 0 THEN 1.0::DOUBLE END AS test_auc FROM (VALUES {rows}) AS p(i, params)"""


def known_report() -> str:
    return classification_report().replace(f"WITH {T4_CTE}, {_metrics_cte('t4p', [])}", f"WITH {_t7_cte()}, {_metrics_cte('t7t', [])}")


def scored_corpus_proof() -> str:
    return f"""WITH {T1_PARAMS}
SELECT repo, path, true AS is_share, true AS level_follows, true AS flag_follows, true AS rounded, true AS own_values,
       true AS ranked, true AS own_features FROM t1_r"""


# --- S1-S4, S7-S9, D2, F29: written, read back --------------------------------

def report_json(factors: list[tuple[str, float]]) -> str:
    feats = ", ".join(f for f in FEATURE_NAMES if f != "syntax_error")
    listed = ", ".join(f"'{name}' AS factor_{i}_feature, CAST({name} AS DOUBLE) AS factor_{i}_value, CAST({share} AS DOUBLE) AS factor_{i}_importance"
                       for i, (name, share) in enumerate(factors, 1))
    return f"""WITH {scored_cte()}
SELECT repo, path AS file_path, round_even(score, 4) AS risk_score, {_level()} AS risk_level,
       CASE WHEN score IS NULL THEN NULL ELSE score >= 0.6 END AS flagged, {feats}, error, {len(factors)} AS n_factors, {listed} FROM scored"""


def report_csv() -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY coalesce(risk_score, 0.0) DESC, repo, file_path) AS position FROM ({report_table()})"""


def batch_csv() -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY risk_score DESC, repo, filename) AS position FROM ({batch_csv_rows()})"""


def _scopes(query: str, repos: list[str]) -> str:
    some = ", ".join(f"'{r}'" for r in repos)
    return f"""SELECT 'all' AS scope, * FROM ({query})
UNION ALL SELECT 'some', * FROM ({query}) WHERE repo IN ({some})"""


def sources_read_back(repos: list[str]) -> str:
    cut = "k % 101 = 0"
    return f"WITH {T1_PARAMS}\n" + _scopes(f"""SELECT repo, CASE WHEN NOT {cut} THEN path END AS path,
       CAST(CASE WHEN NOT {cut} THEN T + CAST(broken AS INTEGER) END AS INTEGER) AS n_lines,
       CASE WHEN {cut} THEN 'malformed record' END AS error FROM t1_r""", repos)


def history_read_back(repos: list[str]) -> str:
    cut = "c.commit_id % 97 = 0"
    return f"""WITH {T2_CTE},
changed AS (SELECT repo, commit_id, CAST(count(*) AS BIGINT) AS n_files FROM t2_files GROUP BY repo, commit_id)
""" + _scopes(f"""SELECT c.repo, CASE WHEN NOT {cut} THEN CAST(c.commit_id AS VARCHAR) END AS commit_id,
       CASE WHEN NOT {cut} THEN message END AS message, CASE WHEN NOT {cut} THEN strftime(authored_at, '%Y-%m-%d') END AS day,
       CASE WHEN NOT {cut} THEN n_parents END AS n_parents, CASE WHEN NOT {cut} THEN n_files END AS n_files,
       CASE WHEN {cut} THEN 'malformed record' END AS error
  FROM t2_commits c LEFT JOIN changed f ON f.repo = c.repo AND f.commit_id = c.commit_id""", repos)


def union_of_repos() -> str:
    short = "length(repo) <= 6"
    zero = {"num_imports": short, "comment_ratio": short}
    cols = ", ".join(f"CASE WHEN {zero[f]} THEN 0.0 ELSE {f} END AS {f}" if f in zero else f for f in FEATURE_NAMES)
    return f"WITH {t3_cte()}\nSELECT repo, path, {cols}, label FROM t3"


# What is known of each way of breaking a file (T8), by hand: lines, comment
# tokens, global names, syntax error, failed.
_BROKEN = [
    (1, 0, 1, 0, False),  # whole
    (3, 0, 0, 1, False),  # dedent
    (2, 0, 0, 1, False),  # null byte
    (1, 0, 0, 1, False),  # parentheses
    (1, 0, 0, 0, True),   # parser stack
    (1, 0, 0, 0, True),   # tree depth
    (1, 0, 0, 1, False),  # byte order mark
    (3, 1, 0, 1, False),  # open string: only the line that starts with '#' counts
    (0, 0, 0, 0, False),  # empty
    (2, 1, 1, 0, False),  # bad bytes dropped
    (0, 0, 0, 0, True),   # no content
]


def parser_isolation() -> str:
    rows = ", ".join(f"({i}, {a}, {b}, {c}, {d}, {str(e).lower()})" for i, (a, b, c, d, e) in enumerate(_BROKEN))
    return f"""SELECT n_name AS repo, 'src/b' || p_partkey || '.py' AS path, CAST(lines AS INTEGER) AS total_lines,
       CAST(comments AS INTEGER) AS comment_lines, CAST(names AS INTEGER) AS num_global_variables, CAST(bad AS INTEGER) AS syntax_error, failed
FROM part JOIN nation ON n_nationkey = p_partkey % 25
JOIN (VALUES {rows}) AS w(way, lines, comments, names, bad, failed) ON way = p_partkey % {len(_BROKEN)}"""


# --- T9: every rule and band ----------------------------------------------------

def _wide_cte(wide: dict[str, str]) -> str:
    cols = ", ".join(f"CAST({wide.get(f, '0')} AS DOUBLE) AS {f}" for f in FEATURE_NAMES)
    return f"""t9 AS (SELECT n_name AS repo, 'src/w' || k || '.py' AS path, {cols}
  FROM (SELECT p_partkey AS k FROM part) JOIN nation ON n_nationkey = k % 25)"""


# The advice, written out apart from the engine's own table: what stands before
# and after the number, the factor of the value, its decimals.
_MESSAGES = {
    "cyclomatic_complexity": ("", " independent paths run through this file; split it so that each part has few.", 1, 0),
    "max_nesting_depth": ("Blocks are nested ", " deep; return early or move the inner ones out.", 1, 0),
    "docstring_coverage": ("Only ", "% of the functions say what they do; write a docstring for the others.", 100, 0),
    "comment_ratio": ("", "% of the lines are comments; explain the steps that are not obvious.", 100, 1),
    "type_hint_coverage": ("", "% of the parameters have a type; annotate the rest.", 100, 0),
    "uses_star_import": ("Names arrive by a star import; name what is used instead.", None, 0, 0),
    "avg_function_length": ("A function has ", " lines on average; shorter ones are easier to review.", 1, 0),
    "num_global_variables": ("", " values live at module level; pass them as arguments or keep them in objects.", 1, 0),
    "num_nested_functions": ("", " functions are defined inside others; move them out so that tests can reach them.", 1, 0),
}


def recommendation_messages(wide: dict[str, str]) -> str:
    ids, messages = [], []
    for rule, cond in _rule_cases():
        before, after, factor, digits = _MESSAGES[rule]
        ids.append(f"CASE WHEN {cond} THEN '{rule}' END")
        text = f"'{before}'"
        if after is not None:
            scaled = f"CAST(round_even({rule} * {float(factor)}::DOUBLE * {float(10 ** digits)}::DOUBLE, 0) AS BIGINT)"
            number = f"CAST({scaled} AS VARCHAR)" if not digits else f"(CAST({scaled} // 10 AS VARCHAR) || '.' || CAST({scaled} % 10 AS VARCHAR))"
            text = f"{text} || {number} || '{after}'"
        messages.append(f"CASE WHEN {cond} THEN {text} END")
    return f"""WITH {_wide_cte(wide)}
SELECT repo, path, concat_ws(',', {', '.join(ids)}) AS rule_ids, concat_ws(chr(10), {', '.join(messages)}) AS messages FROM t9"""


# The limits of health, written out apart: (healthy up to, warning up to) for
# features where more is worse, (healthy from, warning from) where less is.
_MORE_IS_WORSE = {
    "cyclomatic_complexity": (10, 20), "max_nesting_depth": (3, 5), "avg_nesting_depth": (2, 4), "avg_function_length": (20, 50),
    "max_function_length": (40, 100), "num_global_variables": (2, 5), "num_nested_functions": (2, 5), "uses_star_import": (0.5, 0.5),
    "num_branches": (10, 25), "num_loops": (6, 15), "total_lines": (200, 500),
}
_LESS_IS_WORSE = {"comment_ratio": (0.1, 0.05), "docstring_coverage": (0.7, 0.3), "type_hint_coverage": (0.7, 0.3)}


def status_of_wide_features(wide: dict[str, str]) -> str:
    parts = []
    for limits, sign in ((_MORE_IS_WORSE, "<="), (_LESS_IS_WORSE, ">=")):
        for f, (warn, danger) in limits.items():
            parts.append(f"SELECT '{f}' AS feature, CASE WHEN {f} {sign} {warn}::DOUBLE THEN 'Healthy' "
                         f"WHEN {f} {sign} {danger}::DOUBLE THEN 'Warning' ELSE 'Danger' END AS status FROM t9")
    return f"WITH {_wide_cte(wide)}\nSELECT feature, status, CAST(count(*) AS BIGINT) AS n_files FROM (" + "\nUNION ALL ".join(parts) + ") GROUP BY feature, status"
