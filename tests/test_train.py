"""Model properties (factory, training, importances, persistence) on the
generated, separable feature table."""

from __future__ import annotations

import json

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from riskfold.operators import dataset as ds
from riskfold.operators import evaluate as ev
from riskfold.operators import fits
from riskfold.operators import train as tr
from riskfold.session import cut_lineage
from riskfold.sources.generate import generate_dataset


@pytest.fixture(scope="module")
def data(spark):
    d = generate_dataset(spark, 400, 0.4, seed="7").withColumn("path", F.concat(F.lit("g/"), F.col("id")))
    return d.cache()


def test_factory_defaults_and_overrides(spark):
    rf = tr.get_model("random_forest")
    assert isinstance(rf, RandomForestClassifier)
    assert rf.getNumTrees() == 200 and rf.getMaxDepth() == 15 and rf.getSeed() == 42
    assert rf.getWeightCol() == tr.WEIGHT_COL
    gb = tr.get_model("gradient_boosting", n_estimators=7)
    assert isinstance(gb, GBTClassifier) and gb.getMaxIter() == 7 and gb.getStepSize() == 0.1
    with pytest.raises(ValueError, match="no model is called"):
        tr.get_model("svm")


def test_training_properties(spark, data):
    model = tr.fit(data, "random_forest", n_estimators=50, max_depth=6)
    pred = tr.predict(model, tr._prepare(data))
    rows = pred.select("label", "prediction", "score").collect()
    assert {r["prediction"] for r in rows} <= {0, 1}
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)
    acc = sum(r["label"] == r["prediction"] for r in rows) / len(rows)
    assert acc > 0.55
    probs = model.transform(tr._prepare(data)).select("probability").collect()
    assert all(abs(sum(p["probability"].toArray()) - 1.0) < 1e-9 for p in probs)


def test_importances(spark, data):
    model = tr.fit(data, "random_forest", n_estimators=20, max_depth=5)
    imp = tr.feature_importance(model, spark)
    top = tr.top_features(imp, 10).collect()
    assert len(top) == 10
    vals = [r["importance"] for r in top]
    assert vals == sorted(vals, reverse=True)
    from riskfold.schema import FEATURE_NAMES
    assert all(r["feature"] in FEATURE_NAMES for r in top)


def test_save_load_round_trip(spark, data, scratch):
    model = tr.fit(data, "gradient_boosting", n_estimators=5, max_depth=3)
    tr.save_model(model, scratch, {"f1": 1.0})
    loaded, names, metrics = tr.load_model(scratch)
    assert len(names) == 30 and metrics == {"f1": 1.0}
    a = tr.predict(model, tr._prepare(data)).orderBy("id").select("score").collect()
    b = tr.predict(loaded, tr._prepare(data)).orderBy("id").select("score").collect()
    assert all(abs(x["score"] - y["score"]) < 1e-10 for x, y in zip(a, b))


def test_missing_model_raises(spark, scratch):
    with pytest.raises(Exception):
        tr.load_model(scratch + "/nothing-here")


def test_cross_validation_and_selection(spark, data):
    per_fold, summary = tr.cross_validate(data, "random_forest", 3, id_col="path", n_estimators=10, max_depth=4)
    assert per_fold.count() == 3
    s = {r["metric"]: r for r in summary.collect()}
    assert s["accuracy"]["n_folds"] == 3 and s["accuracy"]["mean"] > 0.9  # separable classes
    res = tr.run_training(data, ["random_forest", "gradient_boosting"], folds=3, id_col="path",
                          overrides={"random_forest": {"n_estimators": 10, "max_depth": 4},
                                     "gradient_boosting": {"n_estimators": 5, "max_depth": 2}})
    assert res["best_model"] in ("random_forest", "gradient_boosting")
    f1s = [res[n]["test_metrics"]["f1"] for n in ("random_forest", "gradient_boosting")]
    # strict '>' keeps the first model on ties
    assert res["best_model"] == ("random_forest" if f1s[0] >= f1s[1] else "gradient_boosting")


def test_top_factors_follow_importance(spark):
    from riskfold.operators import score as sc

    imp = spark.createDataFrame([("a", 0, 0.1), ("b", 1, 0.5), ("c", 2, 0.5), ("d", 3, 0.2)],
                                "feature string, idx int, importance double")
    assert sc.top_factor_names(imp, 3) == [("b", 0.5), ("c", 0.5), ("d", 0.2)]  # ties by feature order
    files = spark.createDataFrame([("x.py", 1.0, 2.0, 3.0, 4.0)], "path string, a double, b double, c double, d double")
    row = files.select(sc.top_factors(sc.top_factor_names(imp, 2)).alias("f")).first()["f"]
    assert [(x["feature"], x["value"], x["importance"]) for x in row] == [("b", 2.0, 0.5), ("c", 3.0, 0.5)]


def noisy(spark, n=240):
    """Rows whose label the features only partly decide, with an odd id."""
    d = generate_dataset(spark, n, 0.4, seed="9").withColumn("path", F.concat(F.lit("g/"), F.col("id")))
    d = d.withColumn("label", F.when(F.col("id") % 5 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    return d.withColumn("repo", F.when(F.col("id") % 3 > 0, F.concat(F.lit("r"), F.col("id") % 3)))


def plain_f1(rows):
    """Weighted F1 of (label, prediction) pairs."""
    total = 0.0
    for c in (0, 1):
        tp = sum(y == p == c for y, p in rows)
        wrong = sum(y != p and c in (y, p) for y, p in rows)
        total += sum(y == c for y, _ in rows) * (2 * tp / (2 * tp + wrong) if tp + wrong else 0.0)
    return total / len(rows)


def test_grid_search_and_held_out_evaluation(spark):
    data = cut_lineage(noisy(spark))
    found = tr.grid_search(data, "random_forest", 2, grid={"n_estimators": [1, 5], "max_depth": [1, 4]})
    results = found.results.collect()
    points = [{"max_depth": d, "n_estimators": n} for d in (1, 4) for n in (1, 5)]
    assert sorted((r.point, r.fold) for r in results) == [(p, k) for p in range(4) for k in range(2)]
    assert all(json.loads(r.params) == points[r.point] for r in results)
    mean = [sum(r.f1 for r in results if r.point == p) / 2 for p in range(4)]
    assert len(set(mean)) > 1  # the points differ, so the choice says something
    order = sorted(range(4), key=lambda p: (-round(mean[p], 12), p))
    ranking = {r.rank: r for r in found.ranking.collect()}
    assert [ranking[i + 1].point for i in range(4)] == order
    assert all(abs(ranking[i + 1].mean_f1 - mean[p]) < 1e-9 for i, p in enumerate(order))
    # the chosen point is the argmax, and what was fitted has its parameters
    assert found.params == points[order[0]]
    forest = found.model.stages[-1]
    assert forest.getNumTrees == found.params["n_estimators"] and forest.getOrDefault("maxDepth") == found.params["max_depth"]
    out = tr.evaluate_model(found.model, data, top_n=5)
    m = out["metrics"].first()
    assert 0.0 <= m["accuracy"] <= 1.0 and m["roc_auc"] is not None
    assert [r["class"] for r in out["report"].collect()] == ["clean", "buggy", "accuracy", "macro avg", "weighted avg"]
    assert out["top_features"].count() == 5 and out["confusion"].count() == 4


def test_equal_points_go_by_their_order(spark):
    rows = [(p, f"p{p}", k, f1) for p, scores in enumerate([(0.5, 0.7), (0.8, 0.4), (0.7, 0.5), (0.9, 0.9)]) for k, f1 in enumerate(scores)]
    ranking = tr.rank_points(spark.createDataFrame(rows, "point int, params string, fold int, f1 double")).orderBy("rank").collect()
    assert [r.point for r in ranking] == [3, 0, 1, 2]
    assert tr.grid_points({"b": [1, 2], "a": ["x", "y"]}) == [{"a": "x", "b": 1}, {"a": "x", "b": 2}, {"a": "y", "b": 1}, {"a": "y", "b": 2}]


def test_out_of_fold_rows_are_scored_once_by_the_model_that_did_not_see_them(spark, monkeypatch):
    data = cut_lineage(noisy(spark))
    fits = []
    whole = tr.fit_all

    def watched(table, todo, parallelism=8):
        for job in todo:
            fits.append((job.key, {tuple(r) for r in table.rows(job.part).select("repo", "path").collect()}))
        return whole(table, todo, parallelism)

    monkeypatch.setattr(tr, "fit_all", watched)
    small = {"n_estimators": 5, "max_depth": 4}
    said = tr.out_of_fold(data, ["random_forest"], 3, overrides={"random_forest": small})
    rows = said.collect()
    files = {(r.repo, r.path): r.label for r in data.collect()}
    assert len(rows) == len(files) and {(r.repo, r.path): r.label for r in rows} == files
    folds = {(r.repo, r.path): r.fold for r in ds.stratified_folds(data, None, 3).collect()}
    seen = {key[1]: rows for key, rows in fits}
    for r in rows:
        assert r.fold == folds[r.repo, r.path] and (r.repo, r.path) not in seen[r.fold]
        assert (r.prediction == 1) == (r.score > 0.5) or r.score == 0.5
    assert all(len(s) == sum(f != k for f in folds.values()) for k, s in seen.items())
    # the metrics of a cross-validation are those of this relation
    per_fold, summary = tr.cross_validate(data, "random_forest", 3, **small)
    f1 = {r.fold: r.f1 for r in per_fold.collect()}
    for k in range(3):
        assert abs(f1[k] - plain_f1([(r.label, r.prediction) for r in rows if r.fold == k])) < 1e-12
    mean = {r.metric: r.mean for r in summary.collect()}
    assert abs(mean["f1"] - sum(f1.values()) / 3) < 1e-6


def test_training_run_on_noisy_labels(spark, scratch):
    data = cut_lineage(noisy(spark))
    small = {"random_forest": {"n_estimators": 5, "max_depth": 4}, "gradient_boosting": {"n_estimators": 3, "max_depth": 2}}
    res = tr.run_training(data, folds=3, overrides=small, model_dir=scratch)
    said = res["predictions"].collect()
    split = {(r.repo, r.path): r.split for r in ds.stratified_split(data, None, 0.2).collect()}
    for name in small:
        mine = [r for r in said if r.model == name]
        assert {(r.repo, r.path): r.split for r in mine} == split and len(mine) == len(split)
        assert all((r.fold is None) == (r.split == "test") for r in mine)
        test = [(r.label, r.prediction) for r in mine if r.split == "test"]
        assert abs(res[name]["test_metrics"]["f1"] - plain_f1(test)) < 1e-12
        assert {r.metric for r in res[name]["cv_summary"].collect()} == set(ev.METRIC_NAMES)
    best = max(small, key=lambda n: (res[n]["test_metrics"]["f1"], n == "random_forest"))
    assert res["best_model"] == best and res["best_model_instance"] is res[best]["model"]
    _, _, metrics = tr.load_model(scratch)
    assert metrics["best_model"] == best and set(metrics["all_models"]) == set(small)
    table = tr.metrics_table(res, spark).collect()
    assert len(table) == 24 and {r.model_pos for r in table} == {0, 1}


def test_training_run_with_grid(spark, monkeypatch):
    monkeypatch.setitem(tr.PARAM_GRIDS, "random_forest", {"n_estimators": [2, 3], "max_depth": [2]})
    res = tr.run_training(cut_lineage(noisy(spark, 120)), ["random_forest"], folds=2, use_grid_search=True,
                          overrides={"random_forest": {"n_estimators": 2, "max_depth": 2}})
    assert res["random_forest"]["grid"].ranking.count() == 2
    assert res["random_forest"]["model"].stages[-1].getNumTrees == res["random_forest"]["grid"].params["n_estimators"]


def test_a_part_has_its_own_balanced_weights_and_tasks(spark):
    data = cut_lineage(noisy(spark))
    table = tr.training_table(data, folds=4, test_size=0.25)
    part = fits.Part("train", but_fold=2)
    want = {r.label: r.weight for r in ds.class_weights(table.rows(part)).collect()}
    got = {(r.label, r.class_weight) for r in table.weighted(part, tr.WEIGHT_COL).select("label", tr.WEIGHT_COL).distinct().collect()}
    assert {y for y, _ in got} == {0, 1} and all(abs(want[y] - w) < 1e-12 for y, w in got)
    assert table.rows(fits.Part("train", fold=2)).count() + table.rows(part).count() == table.rows(fits.Part("train")).count()
    assert sum(table.counts.values()) == table.rows(fits.Part()).count() == 240
    assert [fits.tasks_for(n, 8) for n in (0, 1, 2000, 2001, 10_000, 10**6, 10**7)] == [1, 1, 1, 2, 5, 8, 50]
    one_class = tr.training_table(data.where("label = 1"), folds=2)
    assert one_class.weighted(fits.Part("train"), "w").select("w").distinct().collect()[0].w == 1.0


def test_queries_fit_the_reference_models(spark, monkeypatch):
    """The registered queries cut neither trees, depth, folds nor grid."""
    from riskfold.plans import catalog
    from tests.conftest import SF_SMALL

    class Seen(Exception):
        pass

    def stop(table, todo, parallelism=8):
        raise Seen(todo)

    monkeypatch.setattr(tr, "fit_all", stop)
    features = cut_lineage(catalog.t1_features(spark, SF_SMALL))
    labelled = cut_lineage(features.withColumn("label", F.col("uses_star_import")))
    monkeypatch.setattr(catalog, "t1_features", lambda *_: features)
    monkeypatch.setattr(catalog, "labelled_dataset", lambda *_: labelled)
    rf, gb = "random_forest", "gradient_boosting"
    both = [(gb, None), (rf, None), *[(m, k) for m in (gb, rf) for k in range(5)]]
    wants = {"cv_random_forest": [(rf, k) for k in range(5)], "out_of_fold_predictions": [(rf, k) for k in range(5)],
             "model_test_metrics": both, "feature_importance": [rf], "first_important_feature": [rf],
             "grid_search_random_forest": [(p, k) for p in range(8) for k in range(3)], "evaluate_held_out": [gb],
             "score_corpus": [rf], "scored_corpus_proof": [rf], "model_save_load": [gb]}
    for query, keys in wants.items():
        with pytest.raises(Seen) as seen:
            catalog.QUERIES[query](spark, SF_SMALL)
        todo = seen.value.args[0]
        assert [job.key for job in todo] == keys, query
        if query == "grid_search_random_forest":
            points = [{"max_depth": d, "min_samples_split": m, "n_estimators": n} for d in (10, 15) for m in (5, 10) for n in (100, 200)]
            assert [job.params for job in todo] == [p for p in points for _ in range(3)]
        else:
            assert not any(job.params for job in todo), query
    forest, boosted = tr.MODEL_DEFAULTS[rf], tr.MODEL_DEFAULTS[gb]
    assert (forest["n_estimators"], forest["max_depth"], boosted["n_estimators"], boosted["max_depth"]) == (200, 15, 200, 5)
    assert tr.PARAM_GRIDS[rf] == {"n_estimators": [100, 200], "max_depth": [10, 15], "min_samples_split": [5, 10]}


def test_large_fits_follow_each_other():
    from riskfold.operators.fits import CORE_BYTES, fits_at_once

    assert fits_at_once(10_000, 200, 12, 8) == 8
    assert fits_at_once(100_000_000, 200, 12, 8) == 1
    assert 1 < fits_at_once(780_000, 200, 12, 8) < 8
    for rows in (1, 780_000, 2_000_000):  # what runs at once fits
        assert fits_at_once(rows, 200, 12, 8) * rows * (400 + 8 * 200) <= CORE_BYTES * 12
    assert fits_at_once(780_000, 0, 12, 8) > fits_at_once(780_000, 200, 12, 8)  # boosting holds less


def test_small_fits_do_not_wait_behind_large_ones(spark, monkeypatch):
    """boosting fits run side by side where a forest has no room beside another."""
    import threading
    import time

    data = cut_lineage(noisy(spark))
    table = tr.training_table(data, folds=4)
    lock, now, most, together = threading.Lock(), [], {}, set()

    class Slow:
        def __init__(self, name, **_):
            self.name = name

        def fit(self, rows):
            with lock:
                now.append(self.name)
                together.add(tuple(sorted(set(now))))
                most[self.name] = max(most.get(self.name, 0), now.count(self.name))
            time.sleep(0.4)
            with lock:
                now.remove(self.name)

    monkeypatch.setattr(tr, "get_model", Slow)
    # what two boosting fits need; a forest of 200 trees needs more
    monkeypatch.setattr(tr, "CORE_BYTES", 2 * fits.fit_bytes(180, 0) // spark.sparkContext.defaultParallelism + 1)
    todo = [fits.Fit((name, k), name, {}, fits.Part("train", but_fold=k)) for name in ("random_forest", "gradient_boosting") for k in range(4)]
    assert list(tr.fit_all(table, todo, 8)) == [job.key for job in todo]
    assert most == {"random_forest": 1, "gradient_boosting": 2} and len(together) == 2
    assert [fits.boost_tasks(n, 12) for n in (10, 4_600_000, 50_000_000)] == [12, 12, 50]


def _scores(model, rows):
    said = tr.score_vectors(model, rows.drop("rawPrediction", "probability", "score", "prediction"))
    return {r.path: r.score for r in said.select("path", "score").collect()}


def test_smaller_forests_come_out_of_the_largest(spark):
    """what is cut out of a forest is what a fit of that size grows."""
    data = cut_lineage(noisy(spark))
    table = tr.training_table(data)
    made = tr.fit_all(table, [fits.Fit((n, d), "random_forest", {"n_estimators": n, "max_depth": d}) for n in (3, 6) for d in (2, 4, 9)])
    assert list(made) == [(n, d) for n in (3, 6) for d in (2, 4, 9)]
    rows = table.rows(fits.Part())
    for d in (2, 4, 9):  # the same draws, so the same trees as a fit of that depth
        fitted = tr.fit_all(table, [fits.Fit("one", "random_forest", {"n_estimators": 6, "max_depth": d})])["one"]
        mine = made[6, d]
        assert [t.numNodes for t in mine.stages[-1].trees] == [t.numNodes for t in fitted.stages[-1].trees]
        assert max(t.depth for t in mine.stages[-1].trees) <= d
        a, b = _scores(mine, rows), _scores(fitted, rows)
        assert len(a) == 240 and all(abs(a[k] - b[k]) < 1e-9 for k in b)
        assert abs(mine.stages[-1].featureImportances.toArray() - fitted.stages[-1].featureImportances.toArray()).max() < 1e-9
        first = made[3, d].stages[-1]
        assert first.getNumTrees == 3 and first.getOrDefault("numTrees") == 3 and first.getOrDefault("maxDepth") == d
        assert [t.toDebugString.partition("\n")[2] for t in first.trees] == [t.toDebugString.partition("\n")[2] for t in mine.stages[-1].trees[:3]]
    assert made[6, 2].stages[-1].totalNumNodes < made[6, 9].stages[-1].totalNumNodes


def test_a_grid_fits_the_largest_forests_alone(spark, monkeypatch):
    """points that differ in trees and depth share a fit on each fold."""
    made, whole = [], tr.get_model
    monkeypatch.setattr(tr, "get_model", lambda name, **p: made.append(p) or whole(name, **p))
    grid = {"n_estimators": [2, 4], "max_depth": [2, 5], "min_samples_split": [2, 40]}
    found = tr.grid_search(cut_lineage(noisy(spark)), "random_forest", 2, grid=grid)
    assert found.results.count() == 16 and found.ranking.count() == 8
    assert sorted(p["min_samples_split"] for p in made[:-1]) == [2, 2, 40, 40] and made[-1] == found.params
    assert all((p["n_estimators"], p["max_depth"]) == (4, 5) for p in made[:-1])
    apart = [fits.Fit("a", "random_forest", {"max_depth": 3}), fits.Fit("b", "gradient_boosting", {"max_depth": 3}),
             fits.Fit("c", "gradient_boosting", {"max_depth": 4}), fits.Fit("d", "random_forest", {"max_depth": 3}, fits.Part("train", fold=1)),
             fits.Fit("e", "random_forest", {"min_samples_leaf": 9}), fits.Fit("f", "random_forest", {"n_estimators": 7})]
    assert [[j.key for j in jobs] for jobs in tr.shared_forests(apart)] == [["a", "f"], ["b"], ["c"], ["d"], ["e"]]


def test_save_load_query_parses_its_files_once(spark, monkeypatch):
    from riskfold.plans import catalog

    calls = []
    extract = catalog.feat.extract_features
    monkeypatch.setattr(catalog.feat, "extract_features", lambda *a: calls.append(a) or extract(*a))
    monkeypatch.setattr(catalog.tr, "fit", lambda *a: (_ for _ in ()).throw(StopIteration))  # what comes before the fit
    try:
        catalog.model_save_load(spark, "/root/testdata/sf0.001")
    except StopIteration:
        pass
    assert len(calls) == 1
