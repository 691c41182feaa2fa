"""Tree ensembles with Spark ML.

The learners are ``pyspark.ml`` random forests and gradient-boosted trees;
every fit and transform is distributed.  The folds, models and grid points of
a run (a few dozen fits) share one assembled table, written once, and are
fitted side by side (``riskfold.operators.fits``).  What the models say of
rows they have not seen is written too, each row once, and all metrics are
aggregates over that relation.
"""

from __future__ import annotations

import json
import os
from collections.abc import Hashable, Sequence
from itertools import product
from typing import Any, NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.operators import dataset as ds
from riskfold.operators import evaluate as ev
from riskfold.operators.fits import CORE_BYTES, Fit, Part, Room, TrainingTable, boost_tasks, fit_bytes, side_by_side
from riskfold.schema import FEATURE_NAMES
from riskfold.session import cut_lineage, scratch_path

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's defaults).
MODEL_DEFAULTS: dict[str, dict[str, Any]] = {
    "random_forest": {
        "n_estimators": 200, "max_depth": 15, "min_samples_split": 5, "min_samples_leaf": 2,
        "class_weight": "balanced", "random_state": 42,
    },
    "gradient_boosting": {
        "n_estimators": 200, "max_depth": 5, "learning_rate": 0.1, "subsample": 0.8, "random_state": 42,
    },
}
PARAM_GRIDS: dict[str, dict[str, list]] = {
    "random_forest": {"n_estimators": [100, 200], "max_depth": [10, 15], "min_samples_split": [5, 10]},
    "gradient_boosting": {"n_estimators": [100, 200], "max_depth": [3, 5], "learning_rate": [0.05, 0.1]},
}
# ---------------------------------------------------------------------------

WEIGHT_COL = "class_weight"


def _params(name: str, overrides: dict[str, Any]) -> dict[str, Any]:
    if name not in MODEL_DEFAULTS:
        raise ValueError(f"no model is called {name!r}; there are {', '.join(MODEL_DEFAULTS)}")
    return {**MODEL_DEFAULTS[name], **overrides}


def get_model(name: str, **overrides: Any):
    """M1-M3: a configured Spark ML classifier.

    Hyper-parameters use the reference names; ``min_samples_leaf`` maps to
    ``minInstancesPerNode`` (Spark has no separate minimum split size, so
    ``min_samples_split`` bounds it from below as a leaf-size floor of
    ``min_samples_split // 2``), ``class_weight='balanced'`` to a weight
    column.
    """
    p = _params(name, overrides)
    if name == "random_forest":
        min_leaf = max(int(p.get("min_samples_leaf", 1)), int(p.get("min_samples_split", 2)) // 2)
        rf = RandomForestClassifier(
            featuresCol="features", labelCol="label", numTrees=int(p["n_estimators"]),
            maxDepth=int(p["max_depth"]), minInstancesPerNode=min_leaf,
            featureSubsetStrategy="sqrt", seed=int(p["random_state"]),
            # the node that each row has come to is kept, not found again from the root
            cacheNodeIds=True)
        if p.get("class_weight") == "balanced":
            rf.setWeightCol(WEIGHT_COL)
        return rf
    return GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=int(p["n_estimators"]), maxDepth=int(p["max_depth"]),
        stepSize=float(p["learning_rate"]), subsamplingRate=float(p["subsample"]), seed=int(p["random_state"]))


def assembler(features: list[str] = FEATURE_NAMES) -> VectorAssembler:
    """M5: the feature vector in fixed order (inputs are zero-filled by
    ``dataset.align``)."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def _prepare(df: DataFrame) -> DataFrame:
    """Aligned features + label + balanced class weight (M4)."""
    keep = tuple(c for c in ("repo", "path", "id", "fold", "split") if c in df.columns)
    return ds.with_class_weight(ds.align(df, keep=keep), WEIGHT_COL)


def _size(job: Fit) -> tuple[int, int]:
    """Trees and depth of a forest."""
    p = _params(job.name, job.params)
    return int(p["n_estimators"]), int(p["max_depth"])


def shared_forests(todo: Sequence[Fit]) -> list[list[Fit]]:
    """``todo`` in lists of forests on the same rows that differ in trees and
    depth alone; every other fit is a list of its own."""
    found: dict[Any, list[Fit]] = {}
    for i, job in enumerate(todo):
        other = {k: v for k, v in _params(job.name, job.params).items() if k not in ("n_estimators", "max_depth")}
        found.setdefault((job.part, json.dumps(other, sort_keys=True, default=str)) if job.name == "random_forest" else i, []).append(job)
    return list(found.values())


def _cut_tree(most: int):
    """Nodes of one saved tree (numbered from its root, every node before its
    children) down to depth ``most``.  Where both leaves of a node say the
    same, the node becomes the leaf, as in a fitted tree."""

    def cut(nodes):
        nodes = nodes.sort_values("id", ignore_index=True)
        left, right, says = (nodes[c].tolist() for c in ("leftChild", "rightChild", "prediction"))
        depth = [0] * len(left)
        for i, (a, b) in enumerate(zip(left, right)):
            if a >= 0:
                depth[a] = depth[b] = depth[i] + 1
        for i in reversed(range(len(left))):
            a, b = left[i], right[i]
            if a >= 0 and (depth[i] >= most or (left[a] < 0 and left[b] < 0 and says[a] == says[b])):
                left[i] = right[i] = -1
        place, kept = {0: 0}, []
        for i, (a, b) in enumerate(zip(left, right)):
            if i in place:
                place[i] = len(kept)
                kept.append(i)
                if a >= 0:
                    place[a] = place[b] = -1  # known once they come
        out = nodes.iloc[kept].copy()
        out["id"] = range(len(kept))
        leaf = [left[i] < 0 for i in kept]
        out["leftChild"] = [place.get(left[i], -1) for i in kept]
        out["rightChild"] = [place.get(right[i], -1) for i in kept]
        out["gain"] = [-1.0 if x else g for x, g in zip(leaf, out["gain"])]
        out["featureIndex"] = [-1 if x else f for x, f in zip(leaf, out["featureIndex"])]
        out["leftCategoriesOrThreshold"] = [[] if x else list(t) for x, t in zip(leaf, out["leftCategoriesOrThreshold"])]
        out["numCategories"] = [-1 if x else n for x, n in zip(leaf, out["numCategories"])]
        return out
    return cut


_NODE = ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild")
_SPLIT = ("featureIndex", "leftCategoriesOrThreshold", "numCategories")


def smaller_forests(spark: SparkSession, whole: RandomForestClassificationModel, sizes: Sequence[tuple[int, int]]) -> list[RandomForestClassificationModel]:
    """Forests of fewer trees or less depth out of a fitted one.

    A forest's trees are drawn one by one, and a tree splits level by level
    whatever its last level is, so the first ``n`` trees down to depth ``d``
    are what a fit of that size grows from the same draws.  Made from the
    saved form of the model, tree by tree in tasks.
    """
    most = (whole.getNumTrees, whole.getOrDefault("maxDepth"))
    if all(size == most for size in sizes):
        return [whole for _ in sizes]
    at = scratch_path(spark, "forest")
    whole.write().overwrite().save(at)
    (about,) = (json.loads(r.value) for r in spark.read.text(f"{at}/metadata").collect())
    nodes = spark.read.parquet(f"{at}/data")
    flat = nodes.select("treeID", *[F.col("nodeData")[c].alias(c) for c in _NODE], *[F.col("nodeData.split")[c].alias(c) for c in _SPLIT])
    trees = spark.read.parquet(f"{at}/treesMetadata")  # a row a tree

    def smaller(n: int, depth: int) -> RandomForestClassificationModel:
        to = scratch_path(spark, "forest")
        mine = flat.where(F.col("treeID") < n)
        if depth < most[1]:
            mine = mine.groupBy("treeID").applyInPandas(_cut_tree(depth), mine.schema)
        node = F.struct(*_NODE, F.struct(*_SPLIT).alias("split"))
        mine.select("treeID", node.alias("nodeData")).write.parquet(f"{to}/data")
        said = F.regexp_replace("_2", '"maxDepth":[0-9]+(?=.*"defaultParamMap")', f'"maxDepth":{depth}')
        trees.where(F.col("_1") < n).withColumn("_2", said).write.parquet(f"{to}/treesMetadata")
        params = about["paramMap"] | {"numTrees": n, "maxDepth": depth}
        text = json.dumps(about | {"paramMap": params, "numTrees": n}, separators=(",", ":"))
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{to}/metadata")
        return RandomForestClassificationModel.load(to)

    made = {size: whole if size == most else smaller(*size) for size in dict.fromkeys(sizes)}
    return [made[size] for size in sizes]


def fit_all(table: TrainingTable, todo: Sequence[Fit], parallelism: int = 8) -> dict[Hashable, PipelineModel]:
    """Fits every model of ``todo`` on its part of ``table``, side by side as
    far as their cached rows fit into memory.  Of forests that differ in trees
    and depth alone the largest is fitted and holds the others."""
    spark = table.table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    room = Room(CORE_BYTES * cores)
    lists = shared_forests(todo)

    def one(jobs: list[Fit]) -> dict[Hashable, PipelineModel]:
        job = jobs[0]
        forest = job.name == "random_forest"
        sizes = [_size(j) for j in jobs]
        trees, depth = (max(x) for x in zip(*sizes))
        params = job.params if len(jobs) == 1 else {**job.params, "n_estimators": trees, "max_depth": depth}
        count = sum(table.label_counts(job.part).values())
        # boosting holds no weight and node of a row for each tree
        with room.taken(fit_bytes(count, trees if forest else 0)):
            if len(lists) > 1 < parallelism:  # in a thread of its own
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{job.key}")
            rows = table.weighted(job.part, WEIGHT_COL)
            model = get_model(job.name, **params).fit(rows if forest else rows.coalesce(boost_tasks(count, cores)))
        models = [model] if len(jobs) == 1 else smaller_forests(spark, model, sizes)
        return {j.key: PipelineModel([assembler(), m]) for j, m in zip(jobs, models)}

    made: dict[Hashable, PipelineModel] = {}
    for models in side_by_side(spark, one, lists, parallelism):
        made |= models
    return {job.key: made[job.key] for job in todo}


def training_table(data: DataFrame, **kwargs: Any) -> TrainingTable:
    return TrainingTable(data, assembler().transform, **kwargs)


def fit(train: DataFrame, name: str, **overrides: Any) -> PipelineModel:
    """Fit assembler + classifier on an aligned training table."""
    return fit_all(training_table(train), [Fit(name, name, overrides)])[name]


def score_vectors(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``score`` and ``prediction`` for rows that hold ``features``."""
    out = model.stages[-1].transform(rows)
    return (out.withColumn("score", vector_to_array(F.col("probability"))[1])
            .withColumn("prediction", F.col("prediction").cast("int"))
            .drop("features", "rawPrediction", "probability"))


def held_out(table: TrainingTable, models: dict[tuple, PipelineModel], parts: dict[tuple, Part],
             key_names: Sequence[str]) -> DataFrame:
    """One written relation of what each model says of the rows of its part:
    the key columns, the id, ``split``, ``fold``, ``label``, ``score``,
    ``prediction``."""
    said: DataFrame | None = None
    for key, part in parts.items():
        rows = score_vectors(models[key], table.rows(part))
        rows = rows.select(*[F.lit(k).alias(n) for n, k in zip(key_names, key)], *table.ids, "split", "fold", "label", "score", "prediction")
        said = rows if said is None else said.unionByName(rows)
    return cut_lineage(said, "held-out")


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``score`` = P(buggy) and ``prediction`` (INT)."""
    out = model.transform(df if "features" not in df.columns else df.drop("features"))
    return (out.withColumn("score", vector_to_array(F.col("probability"))[1])
            .withColumn("prediction", F.col("prediction").cast("int"))
            .drop("features", "rawPrediction", "probability"))


def feature_importance(model: PipelineModel, spark: SparkSession,
                       features: list[str] = FEATURE_NAMES) -> DataFrame:
    """M11 source: (feature, idx, importance), one row per feature (<= 30)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, i, float(v)) for i, (f, v) in enumerate(zip(features, imp))],
                                 "feature string, idx int, importance double")


def top_features(importances: DataFrame, n: int = 15) -> DataFrame:
    """Top-n by importance, ties by feature order."""
    w_order = [F.col("importance").desc(), F.col("idx").asc()]
    return importances.orderBy(*w_order).limit(n)


def out_of_fold(data: DataFrame, names: Sequence[str] = ("random_forest",), folds: int = 5, seed: str = "42",
                id_col: str | Sequence[str] | None = None, parallelism: int = 8,
                overrides: dict[str, dict] | None = None) -> DataFrame:
    """M8: every row of ``data`` scored once for each model, by the fit that
    did not see it: (model, id columns, fold, label, score, prediction)."""
    table = training_table(data, folds=folds, seed=seed, id_col=id_col)
    todo = [Fit((name, k), name, (overrides or {}).get(name, {}), Part("train", but_fold=k)) for name in names for k in range(folds)]
    models = fit_all(table, todo, parallelism)
    parts = {(name, k): Part("train", fold=k) for name in names for k in range(folds)}
    return held_out(table, models, parts, ["model"]).drop("split")


def cross_validate(data: DataFrame, name: str, folds: int = 5, seed: str = "42", id_col: str | Sequence[str] | None = None,
                   parallelism: int = 8, **overrides: Any) -> tuple[DataFrame, DataFrame]:
    """M8: stratified k-fold CV.  Returns (per-fold metrics, summary with
    mean and population std of every metric), both aggregates over the
    out-of-fold predictions."""
    said = out_of_fold(data, [name], folds, seed, id_col, parallelism, {name: overrides})
    per_fold = ev.fold_metrics(said, ["fold"])
    return per_fold, ev.cv_summary(ev.metrics_long(per_fold, ["fold"]), [])


def grid_points(grid: dict[str, list]) -> list[dict[str, Any]]:
    """All combinations; parameters in the order of their names, the last one
    varying fastest."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]


class GridSearch(NamedTuple):
    model: PipelineModel        # the best point, fitted on all rows
    params: dict[str, Any]      # its parameters
    results: DataFrame          # (point, params, fold, f1): each point on each fold
    ranking: DataFrame          # (point, params, mean_f1, std_f1, rank): rank 1 is the best


def rank_points(results: DataFrame) -> DataFrame:
    """Points by their mean weighted F1 over the folds, best first; of equal
    means (to twelve digits, so that summing order does not matter) the point
    listed first.  One row a grid point, so the window is small."""
    from pyspark.sql import Window

    mean = results.groupBy("point", "params").agg(F.round(F.avg("f1"), 12).alias("mean_f1"), F.round(F.stddev_pop("f1"), 12).alias("std_f1"))
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_f1"), F.asc("point"))))


def grid_search(train: DataFrame, name: str, folds: int = 3, seed: str = "42", id_col: str | Sequence[str] | None = None,
                grid: dict[str, list] | None = None, parallelism: int = 8) -> GridSearch:
    """M9: every point of the grid (the reference's by default) on stratified
    folds by weighted F1; the best point is fitted on all of ``train``.  What
    each fit says of its left-out fold is one written relation, and results,
    ranking and best point are queries over it."""
    points = grid_points(grid or PARAM_GRIDS[name])
    table = training_table(train, folds=folds, seed=seed, id_col=id_col)
    todo = [Fit((p, k), name, params, Part("train", but_fold=k)) for p, params in enumerate(points) for k in range(folds)]
    models = fit_all(table, todo, parallelism)
    said = held_out(table, models, {(p, k): Part("train", fold=k) for p in range(len(points)) for k in range(folds)}, ["point"])
    spark = train.sparkSession
    named = spark.createDataFrame([(p, json.dumps(params, sort_keys=True)) for p, params in enumerate(points)], "point int, params string")
    # a row for each point and fold
    f1 = ev.class_metrics(said, ["point", "fold"]).select("point", "fold", F.col("f1_weighted").alias("f1"))
    results = cut_lineage(f1.join(F.broadcast(named), "point").select("point", "params", "fold", "f1"), "grid")
    ranking = rank_points(results)
    best = points[ranking.where(F.col("rank") == 1).first()["point"]]
    model = fit_all(table, [Fit("best", name, best, Part("train"))])["best"]
    return GridSearch(model, best, results, ranking)


def evaluate_model(model: PipelineModel, test: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    """Metrics, report, confusion and top-n importances on a held-out table."""
    p = predict(model, _prepare(test))
    return {
        "metrics": ev.fold_metrics(p, []),
        "report": ev.classification_report(p),
        "confusion": ev.normalized_confusion(p),
        "top_features": top_features(feature_importance(model, test.sparkSession), top_n),
    }


def run_training(data: DataFrame, model_names: list[str] | None = None, folds: int = 5, test_size: float = 0.2,
                 seed: str = "42", id_col: str | Sequence[str] | None = None, use_grid_search: bool = False,
                 overrides: dict[str, dict] | None = None, model_dir: str | None = None,
                 parallelism: int = 12) -> dict[str, Any]:
    """Split, cross-validate, fit and test every model; the best test
    weighted F1 wins (strictly greater, so the first listed wins ties).  All
    fits run side by side.  ``predictions`` of the result is the written
    relation of out-of-fold and test predictions that every metric is an
    aggregate of.  With ``model_dir`` the winner is saved there with its
    feature order, its test and cross-validation metrics and the test metrics
    of every model."""
    names = model_names or ["random_forest", "gradient_boosting"]
    overrides = overrides or {}
    table = training_table(data, folds=folds, test_size=test_size, seed=seed, id_col=id_col)
    cv = {(name, k): Part("train", fold=k) for name in names for k in range(folds)}
    # the longest fits first; all folds and final models in one go
    todo = [] if use_grid_search else [Fit((name, None), name, overrides.get(name, {}), Part("train")) for name in reversed(names)]
    todo += [Fit((name, k), name, overrides.get(name, {}), Part("train", but_fold=k)) for name in reversed(names) for k in range(folds)]
    models = fit_all(table, todo, parallelism)
    results: dict[str, Any] = {}
    if use_grid_search:
        train = table.rows(Part("train"))
        plain = train.select(*table.ids, "label", *[vector_to_array("features")[i].alias(f) for i, f in enumerate(FEATURE_NAMES)])
        for name in names:
            results[name] = {"grid": grid_search(plain, name, 3, seed, id_col, parallelism=parallelism)}
            models[name, None] = results[name]["grid"].model
    parts = {**cv, **{(name, None): Part("test") for name in names}}
    said = held_out(table, models, parts, ["model"])
    per_fold = ev.fold_metrics(said.where(F.col("split") == "train"), ["model", "fold"])
    summary = cut_lineage(ev.cv_summary(ev.metrics_long(per_fold, ["model", "fold"]), ["model"]), "cv")
    tested = {r["model"]: r.asDict() for r in ev.fold_metrics(said.where(F.col("split") == "test"), ["model"]).collect()}  # a row a model
    best_name, best_f1 = None, -1.0
    for name in names:
        row = {m: v for m, v in tested.get(name, dict.fromkeys(ev.METRIC_NAMES)).items() if m != "model"}
        results[name] = results.get(name, {}) | {
            "cv_summary": summary.where(F.col("model") == name).drop("model"), "test_metrics": row, "model": models[name, None]}
        if (row["f1"] or 0.0) > best_f1:
            best_name, best_f1 = name, row["f1"] or 0.0
    best_model = models[best_name, None]
    results |= {"best_model": best_name, "best_model_instance": best_model, "predictions": said}
    if model_dir is not None:
        cv_rows = [r.asDict() for r in results[best_name]["cv_summary"].collect()]  # a row per metric
        save_model(best_model, model_dir, {
            "best_model": best_name, "test": results[best_name]["test_metrics"], "cross_validation": cv_rows,
            "all_models": {n: results[n]["test_metrics"] for n in names}})
    return results


def metrics_table(results: dict[str, Any], spark: SparkSession) -> DataFrame:
    """Long test-metric table (model, model_pos, metric, value) of a
    training run (a few dozen rows)."""
    rows = []
    names = [n for n in results if isinstance(results[n], dict)]
    for pos, n in enumerate(names):
        for m, v in results[n]["test_metrics"].items():
            rows.append((n, pos, m, None if v is None else float(v)))
    return spark.createDataFrame(rows, "model string, model_pos int, metric string, value double")


def save_model(model: PipelineModel, model_dir: str, metrics: dict[str, Any] | None = None,
               features: list[str] = FEATURE_NAMES) -> None:
    """Model, feature order and metrics side by side."""
    model.write().overwrite().save(os.path.join(model_dir, "model"))
    spark = SparkSession.getActiveSession()
    meta = spark.createDataFrame([(json.dumps(list(features)), json.dumps(metrics or {}, default=float))],
                                 "feature_names string, metrics string")
    meta.coalesce(1).write.mode("overwrite").json(os.path.join(model_dir, "meta"))


def load_model(model_dir: str) -> tuple[PipelineModel, list[str], dict[str, Any]]:
    """(model, feature names, metrics); a missing model is an error,
    missing metadata gives empty names and metrics."""
    path = os.path.join(model_dir, "model")
    model = PipelineModel.load(path)
    spark = SparkSession.getActiveSession()
    try:
        meta = spark.read.schema("feature_names string, metrics string").json(os.path.join(model_dir, "meta"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return model, [], {}
    row = meta.first()
    return model, json.loads(row["feature_names"]), json.loads(row["metrics"])


def score_files(model: PipelineModel, features: DataFrame) -> DataFrame:
    """P(buggy) for every file of a feature table ``(repo, path,
    <30 features>, error)``; files that failed analysis get a null score."""
    aligned = ds.align(features, keep=tuple(c for c in ("repo", "path", "error") if c in features.columns))
    scored = predict(model, aligned)
    if "error" in scored.columns:
        scored = scored.withColumn("score", F.when(F.col("error").isNull(), F.col("score")))
    return scored
