"""The composed public API end to end on a small project directory."""

from __future__ import annotations

import datetime as dt
import os

from riskfold.plans import jobs
from riskfold.sources.files import scan_source_files


def test_scan_extract_train_score_report(spark, scratch):
    root = os.path.join(scratch, "proj")
    os.makedirs(os.path.join(root, "pkg"))
    for i in range(6):
        body = "".join(f"    if x > {j}:\n        x -= 1\n" for j in range(i))
        with open(os.path.join(root, "pkg", f"m{i}.py"), "w") as fh:
            fh.write(f'"""Module {i}."""\n\ndef f{i}(x: int) -> int:\n{body}    return x\n')
    files = scan_source_files(spark, root)
    features = jobs.extract_features(files, source_col="content")
    assert features.count() == 6

    commits = spark.createDataFrame(
        [("proj", "c1", "fix crash", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), 1),
         ("proj", "c2", "add docs", dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 1), 1)],
        "repo string, commit_id string, message string, authored_at timestamp, committed_at timestamp, n_parents int")
    changed = spark.createDataFrame([("proj", "c1", f"pkg/m{i}.py") for i in range(3)]
                                    + [("proj", "c2", f"pkg/m{i}.py") for i in range(3, 6)],
                                    "repo string, commit_id string, path string")
    labels = jobs.label_files(files.select("repo", "path"), commits, changed, "2024-06-01 00:00:00")
    assert sorted((r["path"], r["label"]) for r in labels.collect()) == \
        [(f"pkg/m{i}.py", 1 if i < 3 else 0) for i in range(6)]
    mined = jobs.build_dataset(spark, features, labels)
    assert mined.count() == 6 and "path" in mined.columns

    # with no labelled rows the build falls back to the generated table
    empty = labels.where("false")
    generated = jobs.build_dataset(spark, features, empty, n_synthetic=300)
    assert generated.count() == 300

    run = jobs.train(generated, ["random_forest"], folds=2,
                     overrides={"random_forest": {"n_estimators": 5, "max_depth": 3}})
    model = run["best_model_instance"]
    scored = jobs.score(files, model, source_col="content")
    out = jobs.report(scored, model)
    assert out["report"].count() == 6 and out["ranked"].count() == 6
    assert out["footer"].first()["n_files"] == 6 and out["histogram"].count() == 30
    expl = jobs.explain(features)
    assert expl["status"].count() == 6 * 29 and expl["radar"].count() == 6 * 8
    prof = jobs.profile(generated)
    assert prof["describe"].count() == 30 and prof["balance"].first()["n_total"] == 300
