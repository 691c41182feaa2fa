"""Connected components by contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import Tables, cut_lineage


def _jump(parents: DataFrame, tables: Tables) -> DataFrame:
    """Follow parent pointers until every node points at its root.  Pointers
    only go to smaller nodes, so each step halves the longest chain."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        stepped = tables.write(parents.join(up, "parent", "left").select(
            "node", F.coalesce("next", "parent").alias("parent"), (F.col("next") < F.col("parent")).alias("moved")), "pointers")
        parents = stepped.select("node", "parent")
        if stepped.where("moved").limit(1).count() == 0:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the least
    node of its component.  Each round lets every node point at its least
    neighbour, contracts, and goes on with the edges between different roots,
    so at least half of the nodes with an edge disappear per round.  A node
    with very many neighbours is pre-aggregated (a minimum), never gathered.
    Null ends and loops are ignored; without edges the result is empty."""
    tables = Tables(edges.sparkSession)
    edges = edges.select("a", "b").where("a <> b").distinct()
    labels: DataFrame | None = None
    while True:
        edges = tables.write(edges, "edges")
        if labels is not None and edges.limit(1).count() == 0:
            kept = cut_lineage(labels, "components")
            tables.drop()
            return kept
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = _jump(tables.write(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("parent")), "parents"), tables)
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("root"))
        else:
            onto = parents.select(F.col("node").alias("root"), "parent")
            labels = labels.join(onto, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        labels = tables.write(labels, "labels")
        for end in ("a", "b"):
            onto = parents.select(F.col("node").alias(end), F.col("parent").alias("to"))
            edges = edges.join(onto, end).drop(end).withColumnRenamed("to", end)
        edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
