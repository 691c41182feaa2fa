"""Explanations at their boundaries; generator bounds and determinism."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskfold.operators import explain as xp
from riskfold.schema import FEATURE_NAMES
from riskfold.sources.generate import DISTRIBUTIONS, generate_dataset


def _feat(spark, **vals):
    row = {f: 0.0 for f in FEATURE_NAMES}
    row.update(vals)
    row["path"] = "x.py"
    return spark.createDataFrame([row])


def test_status_inclusive_boundaries(spark):
    df = _feat(spark, cyclomatic_complexity=10.0, max_nesting_depth=5.0, comment_ratio=0.05, uses_star_import=1.0)
    st = {r["feature"]: r["status"] for r in xp.feature_status(df).collect()}
    assert st["cyclomatic_complexity"] == "Healthy"      # <= warn
    assert st["max_nesting_depth"] == "Warning"          # <= danger
    assert st["comment_ratio"] == "Warning"              # lower is worse, >= danger
    assert st["uses_star_import"] == "Danger"
    assert st["num_imports"] == "—" and "syntax_error" not in st


def test_recommendations(spark):
    df = _feat(spark, cyclomatic_complexity=16.0, docstring_coverage=0.5, comment_ratio=0.02,
               type_hint_coverage=0.9, uses_star_import=1.0, avg_function_length=30.0)
    r = xp.recommendations(df).first()
    assert r["rule_ids"] == ["cyclomatic_complexity", "comment_ratio", "uses_star_import"]
    assert r["messages"][0].startswith("16 independent paths")
    assert "2.0%" in r["messages"][1]
    healthy = xp.recommendations(_feat(spark, docstring_coverage=1.0, comment_ratio=0.5, type_hint_coverage=1.0)).first()
    assert healthy["rule_ids"] == []


def test_radar(spark):
    df = _feat(spark, cyclomatic_complexity=5.0, comment_ratio=0.02, uses_star_import=1.0, docstring_coverage=0.9)
    rv = {r["feature"]: r["radar_value"] for r in xp.radar_values(df).collect()}
    assert rv["cyclomatic_complexity"] == 0.5          # 5 / max(2*5, 1)
    assert rv["comment_ratio"] == pytest.approx(0.6)   # 1 - 0.02/0.05
    assert rv["docstring_coverage"] == 0.0             # clipped then inverted
    assert rv["uses_star_import"] == 1.0 and rv["max_nesting_depth"] == 0.0


def test_generator_bounds_and_determinism(spark):
    a = generate_dataset(spark, 2000, 0.35, seed="3", partitions=1)
    b = generate_dataset(spark, 2000, 0.35, seed="3", partitions=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.where("label = 1").count() == 700
    pdf = a.toPandas()
    for col, specs in DISTRIBUTIONS.items():
        for label, spec in ((0, specs[0]), (1, specs[1])):
            v = pdf[pdf.label == label][col]
            if spec[0] == "int":
                assert v.min() >= spec[1] and v.max() < spec[2] and (v == v.round()).all(), col
            elif spec[0] == "norm":
                assert v.min() >= spec[3] and v.max() <= spec[4], col
                assert abs(v.clip(spec[3], spec[4]).mean() - spec[1]) < 0.25 * spec[2] + 0.1, col
            elif spec[0] == "bern":
                assert set(v.unique()) <= {0.0, 1.0} and abs(v.mean() - spec[1]) < 0.06, col
    # the two classes never overlap in maximum nesting depth
    assert pdf[pdf.label == 0].max_nesting_depth.max() < pdf[pdf.label == 1].max_nesting_depth.min()
