"""Quality scores and language labels: held-out accuracy and defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.llm import langid, quality
from riskfold.llm.queries import op1_quality_classifier, op5_language_id
from tests.conftest import SF_MID
from tests.llm.helpers import docs

ODD = [None, "", " ", "\n\n", "12 !!", "a", "x" * 40_000, "same text", "same text", "ß"]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def quality_rows(spark):
    return {r.doc_id: r for r in op1_quality_classifier(spark, SF_MID).collect()}


def test_quality_on_held_out_labels(spark, quality_rows):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    ids = {r.doc_id for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id").collect()}
    assert set(quality_rows) == ids
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
               for i, r in quality_rows.items())
    held = [(quality_rows[i].score, q) for i, q in truth.items() if i in ids and fold(i, 5) == 0]
    pos, neg = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.97
    assert np.mean([s >= 0.3 for s in pos]) > 0.95


def test_quality_ignores_held_out_labels_and_other_columns(spark, quality_rows):
    d = spark.read.parquet(f"{SF_MID}/documents.parquet")
    lab = spark.read.parquet(f"{SF_MID}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = lab.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = d.withColumn("lang", F.lit("zz")).withColumn("score", F.lit("clash")).withColumn("stats", F.lit(1))
    again = {r.doc_id: r.score for r in quality.fit_and_score(other, flipped).collect()}
    assert max(abs(again[i] - r.score) for i, r in quality_rows.items()) < 1e-6


def test_quality_odd_texts_and_empty_tables(spark):
    d = docs(spark, ODD)
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(len(ODD))] + [(0, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.fit_and_score(d, lab).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.fit_and_score(d, lab.limit(0)).collect()} == {0.5}
    assert quality.fit_and_score(d.limit(0), lab).count() == 0


def test_statistics_match_plain_counts():
    texts = ["", "Ab, c!\nAb, c!", "é | x"]
    got = dict(zip(quality.STATISTICS, quality.text_statistics(texts).T, strict=True))
    assert got["log_words"].tolist() == [np.log1p(len(t.split())) for t in texts]
    assert got["distinct_words"][1] == 0.5 and got["distinct_lines"][1] == 0.5
    assert got["exclaims"][1] == 0.5 and got["bars"][2] == 1 / 3 and got["single_words"][2] == 2 / 3


def test_pooling_gives_the_isotonic_fit():
    x, n, ones = np.arange(6.0), np.array([2.0, 1, 3, 1, 1, 2]), np.array([1.0, 1, 0, 1, 0, 2])
    knots, values = quality.pool_adjacent(x, n, ones)
    assert np.all(np.diff(values) > 0) and np.all(np.diff(knots) > 0)
    best = min(((v - np.repeat(ones / n, 1)) ** 2 @ n, tuple(v)) for v in
               (np.array([a, a, a, b, b, c]) for a in np.linspace(0, 1, 13) for b in np.linspace(0, 1, 13) if b >= a
                for c in np.linspace(0, 1, 13) if c >= b))[1]
    assert np.allclose(np.interp(x, knots, values)[[0, 5]], [best[0], best[5]], atol=0.1)


def test_gradients_by_differences():
    net = langid.Network.start(["a", "b", "c"], hidden=3, seed=1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    seq = np.array([[65, 66], [67, 65], [65, 65], [70, 66]], np.uint8)
    labels = np.array([0, 2])
    _, grads = net.gradients(seq, labels)
    rng = np.random.default_rng(0)
    for name in net.params:
        base = net.params[name]
        places = np.argwhere(np.abs(grads[name]) > 0)
        for at in places[rng.integers(0, len(places), 5)]:
            at, values = tuple(at), []
            for step in (1e-4, -1e-4):
                moved = base.copy()
                moved[at] += step
                net.params[name] = moved
                values.append(net.gradients(seq, labels)[0])
            net.params[name] = base
            assert np.isclose((values[0] - values[1]) / 2e-4, grads[name][at], rtol=2e-2, atol=2e-4), name


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    rows = op5_language_id(spark, SF_MID).collect()
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean(held) > 0.97


def test_language_defined_cases(spark):
    texts = [*ODD, *["der die und " + "ung keit " * 4, "the and of ing tion"] * 12]
    langs = [None] * len(ODD) + ["de", "en"] * 12
    d = docs(spark, texts, langs=langs).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(2))
    net = langid.fit(langid.training_rows(d))
    rows = {r.doc_id: r for r in langid.identify(d, net).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(ODD):
        has_letter = any(c.isalpha() for c in t or "")
        assert (rows[i].lang_pred == "und") == (not has_letter) and (has_letter or rows[i].score == 0)
    assert all(rows[len(ODD) + i].lang_pred == ("de", "en")[i % 2] for i in range(24))
    assert rows[7].score == rows[8].score
    assert {r.lang_pred for r in langid.identify(d, langid.fit(d.where("lang = 'zz'"))).collect()} == {"und"}
    assert langid.fit_and_identify(d.limit(0)).count() == 0


def test_cached_labels_equal_the_network():
    net = langid.Network.start(["a", "b"], seed=3)
    texts = ["The tiger ate", "ate x" + "y" * 60, "1 2"]
    labels = langid.WordLabels(net, capacity=2)
    got = np.concatenate([labels.documents([t]) for t in texts])
    for text, row in zip(texts, got, strict=True):
        parts = [p for w in text.lower().split() if langid._LETTER.search(w) for p in langid.stretches(w)]
        if not parts:
            assert not row.any()
            continue
        each = np.concatenate([net.positions(np.frombuffer(p, np.uint8)[:, None])[:, 0] for p in parts])
        assert np.allclose(row, each.mean(0), atol=1e-5)
