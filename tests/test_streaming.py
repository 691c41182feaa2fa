"""Incremental scoring: files arriving between runs are scored once."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from riskfold.operators import train as tr
from riskfold.sources.generate import generate_dataset
from riskfold.streaming.incremental import score_new_files


def test_new_files_are_scored_once(spark, scratch):
    data = generate_dataset(spark, 200, 0.4, seed="5").withColumn("path", F.concat(F.lit("g/"), F.col("id")))
    model = tr.fit(data, "random_forest", n_estimators=5, max_depth=3)
    src = os.path.join(scratch, "incoming")
    os.makedirs(src)
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    for i in range(2):
        with open(os.path.join(src, f"m{i}.py"), "w") as fh:
            fh.write(f"def f{i}(x):\n    if x:\n        return x\n")
    score_new_files(spark, src, model, out, ckpt).awaitTermination()
    first = spark.read.parquet(out)
    assert first.count() == 2
    with open(os.path.join(src, "broken.py"), "w") as fh:
        fh.write("def (broken:\n")
    score_new_files(spark, src, model, out, ckpt).awaitTermination()
    rows = {r["file_path"]: r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {"m0.py", "m1.py", "broken.py"}
    assert rows["m0.py"]["num_functions"] == 1 and rows["m0.py"]["risk_level"] in ("Low", "Medium", "High", "Critical")
