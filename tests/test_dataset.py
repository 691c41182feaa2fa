"""Dataset operators against numpy / plain-window definitions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskfold.operators import dataset as ds
from riskfold.schema import FEATURE_NAMES
from riskfold.sources.generate import generate_dataset


@pytest.fixture(scope="module")
def gen(spark):
    return generate_dataset(spark, 500, 0.3, seed="11").withColumn(
        "path", F.concat(F.lit("p"), F.col("id"))).cache()


def test_bucketed_rank_equals_global_window(spark, gen):
    key = F.conv(F.substring(F.md5(F.concat(F.col("path").cast("string"), F.lit("-42")).cast("binary")), 1, 8), 16, 10).cast("long")
    w = Window.partitionBy("label").orderBy(key, F.col("path"))
    want = {r["path"]: r["rk"] for r in gen.select("path", F.row_number().over(w).alias("rk")).collect()}
    for buckets in (1, 4, 64):
        got = {r["path"]: r["rank"] for r in ds.stratified_rank(gen.select("path", "label"), "path", "42", buckets).collect()}
        assert got == want


def test_split_and_folds_are_stratified(spark, gen):
    s = ds.stratified_split(gen.select("path", "label"), "path", 0.2)
    c = {(r["label"], r["split"]): r["n"] for r in s.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert c[(0, "test")] == 70 and c[(1, "test")] == 30
    f = ds.stratified_folds(gen.select("path", "label"), "path", 5)
    sizes = sorted(r["n"] for r in f.groupBy("fold").agg(F.count("*").alias("n")).collect())
    assert sizes == [100] * 5


def test_profile_matches_numpy(spark, gen):
    prof = {r["feature"]: r for r in ds.feature_profile(gen).collect()}
    pdf = gen.select(*FEATURE_NAMES).toPandas()
    for f in ("total_lines", "comment_ratio", "num_classes", "syntax_error"):
        col = pdf[f].to_numpy()
        for q, name in ((25, "p25"), (50, "p50"), (75, "p75")):
            assert prof[f][name] == pytest.approx(np.percentile(col, q), abs=1e-6), (f, q)
        assert prof[f]["std"] == pytest.approx(col.std(ddof=1), abs=1e-6)


def test_histogram_matches_numpy(spark, gen):
    h = ds.class_histogram(gen, "cyclomatic_complexity").collect()
    pdf = gen.select("label", "cyclomatic_complexity").toPandas()
    for label in (0, 1):
        counts, _ = np.histogram(pdf[pdf.label == label].cyclomatic_complexity, bins=30)
        got = [r["n"] for r in sorted((r for r in h if r["label"] == label), key=lambda r: r["bin"])]
        assert got == counts.tolist()


def test_correlations(spark, gen):
    pdf = gen.select(*FEATURE_NAMES, "label").toPandas()
    corr = {r["feature"]: r["corr"] for r in ds.label_correlation(gen).collect()}
    assert corr["max_nesting_depth"] == pytest.approx(pdf["max_nesting_depth"].corr(pdf["label"]), abs=1e-6)
    top = ds.top_correlated(gen, 12)
    assert len(top) == 12 and "max_nesting_depth" in top
    m = ds.correlation_matrix(gen, top[:3]).collect()
    assert len(m) == 9 and all(r["r"] == pytest.approx(1.0) for r in m if r["f1"] == r["f2"])


def test_weights_align_union(spark):
    a = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 0)], "total_lines double, label int")
    b = spark.createDataFrame([(4.0, None)], "num_loops double, label int")
    empty = spark.createDataFrame([], "total_lines double, label int")
    u = ds.align(ds.union_datasets([a, None, empty, b]))
    assert u.columns == FEATURE_NAMES + ["label"] and u.count() == 4
    assert u.where("num_loops = 4.0").first()["total_lines"] == 0.0
    w = {r["label"]: r["weight"] for r in ds.class_weights(a).collect()}
    assert w == {1: 3 / 2, 0: 3 / 4}


def test_hash_split_is_deterministic_and_near_the_ratio(spark, gen):
    a = {r["path"]: r["split"] for r in ds.hash_split(gen.select("path", "label"), "path", 0.2).collect()}
    b = {r["path"]: r["split"] for r in ds.hash_split(gen.repartition(7).select("path", "label"), "path", 0.2).collect()}
    assert a == b
    share = sum(v == "test" for v in a.values()) / len(a)
    assert 0.14 < share < 0.26


def test_split_of_equal_paths_does_not_depend_on_partitioning(spark):
    """Every repo has one setup.py; the paths alone would all tie."""
    rows = [(f"repo{i}", "setup.py", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "repo string, path string, label int")
    one = {(r.repo, r.split) for r in ds.stratified_split(df.repartition(3), test_size=0.2).collect()}
    two = {(r.repo, r.split) for r in ds.stratified_split(df.repartition(11, "repo"), test_size=0.2).collect()}
    assert one == two and sum(s == "test" for _, s in one) == 80
    folds = ds.stratified_folds(df, k=5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [80] * 5
    hashed = ds.hash_split(df, test_size=0.2).where("split = 'test'").count()
    assert 40 < hashed < 120


def test_top_correlations_equal_single_correlations(spark):
    import random

    r = random.Random(3)
    rows = [(*[float(r.randint(0, 9)) + 1e6 * (i == 0) for i in range(len(FEATURE_NAMES) - 1)], 1.0, r.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, [*FEATURE_NAMES, "label"])
    top = ds.top_correlated(df, 5)
    got = {(x.f1, x.f2): x.r for x in ds.top_correlation_matrix(df, 5).collect()}
    want = {(x.f1, x.f2): x.r for x in ds.correlation_matrix(df, top).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_gram_matrix_is_exact():
    """Sums of products as whole numbers, small, large and negative values."""
    import numpy as np
    import pyarrow as pa

    from riskfold.operators.dataset import _gram

    rng = np.random.default_rng(4)
    for scale in (1.0, 1e4, 1e9):
        x = np.column_stack([np.ones(5000), (rng.normal(size=(5000, 3)) * scale).round(4)])
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], names=list("abcd")) for part in (x[:4900], x[4900:4900], x[4900:])]
        (out,) = list(_gram(b for b in batches if b.num_rows))
        whole = [[int(v) for v in row] for row in np.rint(x * 1e6)]
        for i, j, s in zip(*(out.column(n).to_pylist() for n in "ijs")):
            assert int(s) == sum(row[i] * row[j] for row in whole)
        assert out.num_rows == 10
    assert list(_gram(iter([]))) == []
