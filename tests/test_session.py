"""Lineage cuts land under the session's checkpoint directory."""

from __future__ import annotations

import os

from riskfold.session import cut_lineage, ensure_checkpoint_dir


def test_cut_lineage_writes_under_checkpoint_dir(spark):
    base = ensure_checkpoint_dir(spark)
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    cut = cut_lineage(df, "probe")
    assert sorted(map(tuple, cut.collect())) == [(i, 2 * i) for i in range(100)]
    files = cut.inputFiles()
    assert files and all(base.rstrip("/").replace("file:", "") in f.replace("file:", "") for f in files)
    assert "LogicalRDD" not in cut._jdf.queryExecution().optimizedPlan().toString()
    local = base.replace("file:", "")
    assert any(name.startswith("riskfold-probe-") for name in os.listdir(local))


def test_intermediate_tables_can_be_dropped(spark):
    from riskfold.session import cut_lineage, drop_intermediate

    drop_intermediate(spark)
    table = cut_lineage(spark.range(5), "drop-me")
    files = table.inputFiles()
    assert table.count() == 5 and files
    assert drop_intermediate(spark) == 1
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
