"""Exact global positions and running sums under heavy ties."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from riskfold.functions.ordering import global_positions, running_sums


def test_positions_with_a_hot_score(spark):
    rnd = random.Random(3)
    rows = [(f"p{i:05d}", 0.0 if i % 3 == 0 else round(rnd.random(), 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "path string, score double")
    got = {r["path"]: r["rank"] for r in
           global_positions(df, [F.col("score").desc(), F.col("path").asc()], "rank", slices=7).collect()}
    want = {p: i + 1 for i, (p, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want
    # the hot value is split across several slices (sizes stay balanced)
    sl = df.repartitionByRange(7, F.col("score").desc(), F.col("path")).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in sl.collect()) < 1000


def test_running_sums_per_group(spark):
    rnd = random.Random(4)
    rows = [(g, float(s), rnd.randint(0, 5)) for g in ("a", "b") for s in range(400)]
    df = spark.createDataFrame(rows, "g string, score double, n long")
    got = {(r["g"], r["score"]): r["cum_n"] for r in
           running_sums(df, ["g"], [F.col("score").asc()], ["n"], inclusive=False, slices=6).collect()}
    for g in ("a", "b"):
        acc = 0
        for _, s, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert got[(g, s)] == acc
            acc += n
