"""Feature extraction (F0-F29): hand-derived cases, failure isolation, and
the distributed plan against brute-force tree walks on a real corpus."""

from __future__ import annotations

import glob
import os

import pytest

from riskfold.operators.features import extract_features
from riskfold.operators.parse import ast_nodes, line_stats, parse_sources
from riskfold.schema import FEATURE_NAMES
from tests.spec_features import spec


def _features(spark, sources: dict[str, str]):
    rows = [("r", p, s) for p, s in sources.items()]
    df = spark.createDataFrame(rows, "repo string, path string, source string")
    return {r["path"]: r.asDict() for r in extract_features(df).collect()}


CASES = {
    "lines": "x = 1\n# comment\n\ny = 2\n",
    "ratio": "# a\n# b\nx = 1\ny = 2\n",
    "empty": "",
    "broken": "def (broken:",
    "prose": "this is not python !!!",
    "dedent": "if x:\n        a\n    b\n",
    "trailing": "x=1 # c\n# d",
    "bom": "\ufeffx = 1\n",
    "nul": "x = '\x00'\n",
    "methods": "class Foo:\n    def bar(self): pass\n    def baz(self): pass\n",
    "elif": "if a:\n    pass\nelif b:\n    pass\n",
    "async": "async def f():\n    async for x in y:\n        pass\n",
    "nested": "def a():\n    def b():\n        def c():\n            pass\n",
    "inner_method": "class K:\n    def m(self):\n        def inner():\n            pass\n",
    "imports": "import os.path, os\nfrom . import sib\nfrom .pkg import t\nfrom json import *\n",
    "hints": "def f(a: int, /, b, *c: str, d: int = 1, **e) -> int:\n    return a\n",
    "boolops": "x = a and b and c or d\ny = [i for i in z if i for j in i]\nw = 1 if x else 2\n",
}


@pytest.fixture(scope="module")
def case_rows(spark):
    return _features(spark, CASES)


def test_line_counts(case_rows):
    r = case_rows["lines"]
    assert (r["total_lines"], r["blank_lines"], r["comment_lines"], r["code_lines"]) == (4, 1, 1, 2)
    assert r["comment_ratio"] == 0.25
    assert case_rows["ratio"]["comment_ratio"] == 0.5
    e = case_rows["empty"]
    assert e["total_lines"] == 0 and e["comment_ratio"] == 0.0 and e["cyclomatic_complexity"] == 1
    t = case_rows["trailing"]
    assert (t["total_lines"], t["comment_lines"], t["code_lines"]) == (2, 2, 0)


def test_syntax_errors_give_complete_rows(case_rows):
    for name in ("broken", "prose", "dedent", "bom", "nul"):
        r = case_rows[name]
        assert r["syntax_error"] == 1, name
        assert r["error"] is None, name
        assert r["cyclomatic_complexity"] == 1 and r["num_functions"] == 0, name
        assert r["total_lines"] >= 1, name
    assert case_rows["broken"]["comment_lines"] == 0


def test_structure(case_rows):
    m = case_rows["methods"]
    assert (m["num_classes"], m["num_methods"], m["num_functions"]) == (1, 2, 0)
    n = case_rows["nested"]
    assert (n["num_functions"], n["num_nested_functions"], n["max_nesting_depth"]) == (3, 3, 3)
    im = case_rows["inner_method"]
    assert (im["num_methods"], im["num_functions"], im["num_nested_functions"]) == (2, 0, 1)
    i = case_rows["imports"]
    assert (i["num_imports"], i["num_unique_imports"], i["uses_star_import"]) == (5, 3, 1)


def test_nesting_and_complexity(case_rows):
    e = case_rows["elif"]
    assert (e["max_nesting_depth"], e["num_branches"], e["cyclomatic_complexity"]) == (2, 2, 3)
    assert e["avg_nesting_depth"] == 1.5
    a = case_rows["async"]
    assert (a["max_nesting_depth"], a["avg_nesting_depth"], a["num_loops"], a["cyclomatic_complexity"]) == (2, 1.0, 1, 1)
    b = case_rows["boolops"]
    # and/and -> 2, or -> 1, two comprehension clauses, one comprehension if is not a node, IfExp 1
    assert b["cyclomatic_complexity"] == 1 + 3 + 2 + 1


def test_type_hints(case_rows):
    h = case_rows["hints"]
    # a, b, c, d, e: annotated a, c, d -> 3/5
    assert h["type_hint_coverage"] == 0.6 and h["has_type_hints"] == 1
    assert h["num_return_statements"] == 1


def test_failure_isolation(spark):
    rows = _features(spark, {
        "deep": "a" + "+a" * 50000 + "\n",
        "fine": "x = 1\n",
    })
    assert rows["deep"]["error"] is not None and rows["deep"]["total_lines"] == 1
    assert rows["fine"]["error"] is None


def test_surrogate_is_an_error_row():
    # Spark strings are UTF-8 and cannot carry a lone surrogate, so this case
    # only reaches the helper through bytes decoded elsewhere.
    from riskfold.functions.pysyntax import parse_file

    (total, blank, comments, syntax_error, error), nodes = parse_file("x = '\ud800'\n# c\n")
    assert error is not None and total == 2 and not nodes


def test_all_cases_match_spec(case_rows):
    for name, src in CASES.items():
        want = spec(src)
        got = case_rows[name]
        for f in FEATURE_NAMES:
            assert got[f] == want[f], (name, f, got[f], want[f])


def test_node_relation_and_line_stats(spark):
    df = spark.createDataFrame([("r", "a.py", "def f(x):\n    return x\n"), ("r", "b.py", "")],
                               "repo string, path string, source string")
    parsed = parse_sources(df)
    nodes = ast_nodes(parsed).collect()
    assert {n["node_type"] for n in nodes} >= {"Module", "FunctionDef", "arg", "Return", "Name"}
    assert [n["node_type"] for n in nodes if n["path"] == "b.py"] == ["Module"]
    func = [n for n in nodes if n["node_type"] == "FunctionDef"][0]
    assert func["name"] == "f" and func["n_args"] == 1 and func["block_depth"] == 1
    stats = {r["path"]: r for r in line_stats(parsed).collect()}
    assert stats["b.py"]["total_lines"] == 0 and stats["a.py"]["total_lines"] == 2


def _corpus(limit=160):
    root = os.path.dirname(os.__file__)
    files = sorted(glob.glob(os.path.join(root, "*.py")))[:limit]
    out = {}
    for p in files:
        with open(p, "rb") as fh:
            out[os.path.basename(p)] = fh.read().decode("utf-8", "ignore")
    return out


def test_corpus_matches_spec(spark):
    corpus = _corpus()
    got = _features(spark, corpus)
    assert len(got) == len(corpus)
    for path, src in corpus.items():
        want = spec(src)
        for f in FEATURE_NAMES:
            assert got[path][f] == want[f], (path, f, got[path][f], want[f])


def test_huge_file_is_split_into_bounded_batches(spark):
    # ~40k node rows from one file: more than one output batch, same result
    src = "".join(f"v{i} = a{i} + b{i}\n" for i in range(12000))
    got = _features(spark, {"big.py": src})["big.py"]
    want = spec(src)
    for f in FEATURE_NAMES:
        assert got[f] == want[f], f


def test_line_path_equals_full_path(spark):
    rows = [("r", p, s) for p, s in CASES.items()]
    df = spark.createDataFrame(rows, "repo string, path string, source string")
    from riskfold.operators.features import line_features

    full = {r["path"]: r for r in extract_features(df).collect()}
    lines = {r["path"]: r for r in line_features(df).collect()}
    for p in CASES:
        for f in ("total_lines", "code_lines", "blank_lines", "comment_lines", "comment_ratio"):
            assert lines[p][f] == full[p][f], (p, f)


def test_line_path_on_raw_bytes(spark):
    from riskfold.operators.features import line_features

    df = spark.createDataFrame([("r", "a.py", bytearray(b"x = 1  # c\n\n\xff# d\n"))],
                               "repo string, path string, content binary")
    r = line_features(df, "content").first()
    assert (r["total_lines"], r["blank_lines"], r["comment_lines"], r["code_lines"]) == (3, 1, 2, 0)


def test_equal_paths_stay_two_files_and_null_source_is_an_error(spark):
    rows = [("r", "a.py", "x = 1\n"), ("r", "a.py", "def f():\n    return 1\n"), ("r", "a.py", "x = 1\n"), ("r", "b.py", None)]
    df = spark.createDataFrame(rows, "repo string, path string, source string")
    got = sorted((x.path, x.total_lines, x.num_functions, x.error) for x in extract_features(df).collect())
    assert got == [("a.py", 1, 0, None), ("a.py", 1, 0, None), ("a.py", 2, 1, None), ("b.py", 0, 0, "no source")]


def test_construct_modules_vary_in_every_feature(spark):
    from riskfold.plans import catalog
    from riskfold.schema import FEATURE_NAMES
    from tests.conftest import SF_SMALL

    rows = catalog.features_constructs(spark, SF_SMALL).collect()
    constant = [f for f in FEATURE_NAMES if len({r[f] for r in rows}) == 1]
    assert constant == ["syntax_error"]


ODD_MODULE = '''"""Doc."""
import a.b, a.c, d
from . import x
from d.e import *
type Alias[T: int] = list[T]
def f(p, /, q: int = 1, *r, s, **t) -> None:
    global g
    match p:
        case [1, *rest] if q and r or s:
            import a, z
        case {"k": v, **more}:
            try:
                pass
            except* ValueError as e:
                return (lambda y: y if y else None)
    async def inner():
        async with p as q2, r:
            async for i in s:
                class K:
                    """K."""
                    def m(self, m1: str): return {i1: j for i1 in self for j in i1 if j}
    return f"{p!r:>{q}}"
gv: int
gw = gx = 1; gw += 1
'''


def test_sums_of_a_file_are_those_of_its_nodes(spark):
    """F16: features come from one row a file, and are those of the node relation."""
    from riskfold.operators.features import features_from_parsed
    from riskfold.operators.parse import parse_sources, parse_sums
    from riskfold.plans.fixtures import BLOCKS

    sources = [ODD_MODULE, "".join(BLOCKS.values()) * 2, "", "x = (\n# c\n", None, "# only\n", *BLOCKS.values()]
    df = spark.createDataFrame([("r", f"p{i}.py", s) for i, s in enumerate(sources)], "repo string, path string, source string")
    whole = {r["path"]: r for r in features_from_parsed(parse_sources(df)).collect()}
    assert {r["path"]: r for r in extract_features(df).collect()} == whole
    assert parse_sums(df).count() == len(sources)


def test_an_input_batch_is_parsed_in_bounded_pieces(monkeypatch):
    """texts of a large batch become Python objects some at a time."""
    import pyarrow as pa

    from riskfold.operators import parse

    monkeypatch.setattr(parse, "_INPUT_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"source": ["x" * 60, None, "y" * 40, "z" * 500, "", "u"]})
    pieces = [p.column("source").to_pylist() for p in parse._slices(batch)]
    assert pieces == [["x" * 60, None, "y" * 40], ["z" * 500], ["", "u"]]


def test_comments_of_a_parsed_file_need_no_tokenizer(monkeypatch):
    from riskfold.functions import pysyntax

    plain = ["# a\nx = 1  # b\n", 'x = "#"  # \'a\n', '"""Doc # no.\n# no"""\n# yes', "s = '\\'#'\n#\n", "x = 1 + \\\n  2  # a\n", "s = r'\\\\' # '\n"]
    hard = ["s = f'{x # a\n}'\n# b\n", "x = 1 # a\rb\n# c\n", "x = (\n# a\n", "  x = 1\n y = 2 # a\n", "s = '# open\n# b\n"]
    want = [pysyntax.line_counts(s) for s in plain + hard]  # by the tokenizer
    for source, said in zip(plain + hard, want, strict=True):
        total, blank, comments, _, error = pysyntax.parse_file(source)[0]
        assert (total, blank, comments, error) == (*said[:3], said[4]), source

    def no_tokenizer(_):
        raise AssertionError("tokenizer called")
    monkeypatch.setattr(pysyntax, "_count_comments", no_tokenizer)
    assert [pysyntax.parse_file(s)[0] for s in plain] == want[:len(plain)]


def test_broken_files_leave_no_garbage():
    import gc

    from riskfold.functions.pysyntax import node_sums, parse_file

    for source in ("def (broken:\n", "x = 1\0\n", "x = " + "1+" * 12000 + "1\n"):
        parse_file(source, node_sums)
        gc.collect()
        gc.disable()
        try:
            parse_file(source, node_sums)
            assert gc.collect() == 0, source[:10]
        finally:
            gc.enable()


def test_collector_rests_while_files_are_parsed():
    import gc

    import pyarrow as pa

    from riskfold.operators.parse import _parsed_files

    batch = pa.RecordBatch.from_pydict({"repo": ["r"] * 2, "path": ["a", "b"], "source": ["x = 1\n", "def (\n"], "file_id": [0, 1]})
    assert [gc.isenabled() for _ in _parsed_files([batch, batch])] == [False] * 4
    assert gc.isenabled()
