"""Exact and approximate search against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.llm import ann, impact_topk
from riskfold.llm.queries import op3_exact_topk, op7_nearest_neighbours
from tests.conftest import SF_MID

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def brute(rows, k, every, score, zero):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and (zero or np.any(v))]
    out = {}
    for q, x in good:
        if q % every == 0:
            found = sorted((-score(x, y), i) for i, y in good if i != q)[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def whole(x, y):
    return int(np.floor(1024 * x) @ np.floor(1024 * y))


def mixed(seed=0, n=700, dims=12):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).round(2).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(120)]                    # one very common vector
    rows += [(2000, None), (2100, [None] * dims), (2200, [float("nan")] * dims), (2300, [float("inf")] + [0.0] * (dims - 1)),
             (2400, [0.0] * dims), (-100, rows[5][1]), (2500, [1.0] * 3), (2600, [50.0] * dims)]
    return rows


def test_exact_on_mixed_rows(spark, monkeypatch):
    rows = mixed()
    monkeypatch.setattr(impact_topk, "SHARD_ROWS", 200)
    monkeypatch.setattr(impact_topk, "QUERY_ROWS", 4)
    df = table(spark, rows).withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    want = brute([r for r in rows if r[0] != 2500], 10, 100, whole, True)
    assert answers(impact_topk.top_k(df)) == want
    few = table(spark, rows[:5])
    assert answers(impact_topk.top_k(few)) == brute(rows[:5], 10, 100, whole, True)
    assert impact_topk.top_k(df.limit(0)).count() == 0


def test_exact_on_all_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    assert answers(op3_exact_topk(spark, SF_MID)) == brute(rows, 10, 100, whole, True)


def test_processing_stops_early_on_proof():
    rng = np.random.default_rng(1)
    rows = (rng.pareto(1.2, size=(4000, 16)) * 100).astype(np.int64)
    index = impact_topk.ImpactIndex(rows)
    members, scores = index.search(rows[0], 10, np.array([0]))
    assert len(members) < 400
    full = rows @ rows[0]
    full[0] = -1
    assert sorted(scores)[-10:] == sorted(full)[-10:]


def test_proof_fires_on_the_embeddings(spark):
    """No structure in the vectors, yet most rows are proven out well before the last round."""
    rows = [r.embedding for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").where("embedding is not null").collect()]
    y = np.floor(1024 * np.array(rows, float)).astype(np.int64)
    index = impact_topk.ImpactIndex(y)
    rounds, members = [], []
    for q in range(0, len(y), 10):
        got, scores = index.search(y[q], 10, np.array([q]))
        full = y @ y[q]
        full[q] = -1 << 60
        assert sorted(scores)[-10:] == sorted(full)[-10:]
        rounds.append(index.rounds)
        members.append(len(got))
    assert np.mean(rounds) <= 0.75 * impact_topk.ROUNDS and np.mean(members) <= impact_topk.ENOUGH * 10


@pytest.mark.parametrize("largest", [1 << 20, 1 << 30, 1 << 45])
def test_large_components_are_exact(largest):
    rng = np.random.default_rng(4)
    rows = rng.integers(-largest, largest, size=(300, 6))
    index = impact_topk.ImpactIndex(rows)
    members, scores = index.search(rows[0], 5, np.array([0]))
    want = sorted(max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(r, rows[0], strict=True)))) for r in rows[1:])
    assert sorted(scores.tolist())[-5:] == want[-5:]


def test_repeated_and_huge_queries(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0]), (100, [1e300, 0.0]), (200, [-1e300, 1e300])]
    got = answers(impact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got[0][0][1:] == (100, (1 << 63) - 1)                          # the greater vector asks
    assert got[100][0][1:] == (0, (1 << 63) - 1) and got[100][-1][1:] == (200, -(1 << 63))
    assert {i for _, i, _ in got[0]} == {1, 2, 100, 200}


def dot(x, y):
    return float((x * y).sum())


def recall(got, want):
    return np.mean([len({i for _, i, _ in got.get(q, [])} & {i for _, i, _ in w}) / len(w) for q, w in want.items() if w])


def test_nearest_on_all_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20, dot, False)
    got = answers(op7_nearest_neighbours(spark, SF_MID))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    vec = dict(rows)
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(i != q for _, i, _ in found)
        order = [(-s, i) for _, i, s in found]
        assert order == sorted(order)
        assert all(abs(s - dot(np.array(vec[q]), np.array(vec[i]))) < 1e-9 for _, i, s in found)


def test_nearest_on_mixed_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_ROWS", 4)
    rows = mixed()
    df = table(spark, rows).withColumn("score", F.lit("clash")).withColumn("list", F.lit(1))
    want = brute([r for r in rows if r[0] != 2500], 20, 20, dot, False)
    got = answers(ann.search(df, probed=1.0))
    assert set(got) == set(want) and recall(got, want) >= 0.97
    few = answers(ann.search(table(spark, rows[:5])))
    assert {q: [i for _, i, _ in v] for q, v in few.items()} == {q: [i for _, i, _ in v] for q, v in brute(rows[:5], 20, 20, dot, False).items()}
    assert ann.search(df.limit(0)).count() == 0


def test_registered_search_abandons_candidates(spark):
    embeddings = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    met, abandoned = ann.scan_counts(embeddings).selectExpr("sum(candidates)", "sum(abandoned)").first()
    assert met > 0 and abandoned >= 0.1 * met                            # 200 rows: 20 neighbours are a tenth of them


def test_lists_beyond_the_bound_are_skipped(spark):
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(12, 8)) * 20
    rows = [(i, (middles[i % 12] + rng.normal(size=8) * 0.1).tolist()) for i in range(1200)]
    want = brute(rows, 20, 20, dot, False)
    assert recall(answers(ann.search(table(spark, rows), probed=1.0)), want) >= 0.97
    met = ann.scan_counts(table(spark, rows), probed=1.0).agg(F.sum("candidates")).first()[0]
    assert (met or 0) < 0.5 * 60 * 1199


@pytest.mark.parametrize("seed", range(5))
def test_scan_abandons_few_true_neighbours(seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(3000, 64)) @ ann.rotation(64)
    queries = rng.normal(size=(3, 64))
    q, r, abandoned = ann.scan(rows, queries, 20, np.zeros((3, 3000), bool), np.full(3, np.inf))
    for n, query in enumerate(queries):
        true = np.argsort(((rows - query) ** 2).sum(1))[:20]
        assert len(set(r[q == n]) & set(true)) >= 18
    assert (abandoned > 300).all()
