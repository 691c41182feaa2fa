"""Whitening by block matrices against numpy on the whole table."""

from __future__ import annotations

import math

import numpy as np
import pytest

from riskfold.llm import whitening as wh
from riskfold.llm.queries import op13_whitening
from tests.conftest import SF_MID

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, k=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    d = n * x - sums
    y = d.astype(float) / n
    e, vec = np.linalg.eigh(y.T @ y / n)
    e, vec = e[::-1], vec[:, ::-1]
    return n, (d * d).sum(axis=1), y @ vec[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(rows, vectors, k=8):
    """``rows`` of a result in the order of ``vectors``."""
    n, deviation, whitened, explained = brute(vectors, k)
    got = np.array([[r.whitened for r in rows[i * k:(i + 1) * k]] for i in range(n)])
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * sign - whitened).max() < 1e-9
    for i, r in enumerate(rows):
        assert r.component == i % k + 1 and r.n == n and r.deviation == deviation[i // k]
        assert abs(r.explained / explained[i % k] - 1) < 1e-9 and r.identity_error < 1e-9


def test_all_embeddings(spark, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK_BYTES", 8 * 64 * 7)  # many blocks, the last one not full
    monkeypatch.setattr(wh, "MIDDLE", 3)
    vectors = [r.embedding for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").orderBy("vec_id").collect()]
    compare(op13_whitening(spark, SF_MID).orderBy("vec_id", "component").collect(), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [rng.normal(size=10).round(3).tolist() for _ in range(200)] + [[0.5] * 10] * 60 + [[0.0] * 10]
    rows = [(i, v, 0) for i, v in enumerate(good)]
    bad = [(900, None, 0), (901, [None] * 10, 0), (902, [float("nan")] * 10, 0), (903, [float("-inf")] + [0.0] * 9, 0),
           (904, [], 0), (905, [1.0, 2.0], 0), (906, [1e30] * 10, 0)]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "'clash' AS row", "1 AS x", "2 AS part", "3 AS deviation")
    compare(wh.whiten(df).orderBy("vec_id", "component").collect(), good)
    # rows without an id and repeated ids count like any other
    again = spark.createDataFrame([(None, v, 0) for _, v, _ in rows] + [(7, v, 0) for _, v, _ in rows], SCHEMA)
    out = wh.whiten(again).collect()
    assert len(out) == 2 * len(rows) * 8 and sum(r.vec_id is None for r in out) == len(rows) * 8
    assert {r.n for r in out} == {2 * len(rows)}


def test_few_components_and_no_result(spark):
    table = lambda rows: spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], SCHEMA)
    assert wh.whiten(table([])).count() == 0 and wh.whiten(table([None])).count() == 0
    assert wh.whiten(table([[1.0, 2.0]])).count() == 0 and wh.whiten(table([[1.0, 2.0]] * 5)).count() == 0
    line = wh.whiten(table([[0.0, 0.0, 1.0], [1.0, 1.0, 1.0], [2.0, 2.0, 1.0]])).orderBy("vec_id").collect()
    assert [r.component for r in line] == [1, 1, 1]  # one direction varies
    assert np.allclose(sorted(r.whitened for r in line), [-math.sqrt(1.5), 0, math.sqrt(1.5)]) and line[0].explained == pytest.approx(1)


def test_large_components_stay_exact(spark):
    vectors = [[1e8, 1.0], [-1e8, 3.0], [2e8, 7.0]]
    rows = wh.whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA), 1).orderBy("vec_id").collect()
    deviation = brute(vectors, 1)[1]
    assert [r.deviation for r in rows] == [int(d) if d < 1 << 63 else None for d in deviation] and None in [r.deviation for r in rows]
    assert rows[0].identity_error < 1e-9
