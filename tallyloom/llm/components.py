"""Connected components of an edge table, by hooking roots and jumping pointers; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.storage import materialise


def components(edges: DataFrame, name: str) -> DataFrame:
    """node and component (its smallest node) for every node of edges (a, b).

    Each round hooks every root to its smallest neighbour and contracts the edges, so at least half of
    the roots with neighbours go; a round's tables are written to the shared folder.  Repeated edges and
    edges from a node to itself do no harm.  No edges give no rows.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-edges")
    found = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        # written, so that both sides of the joins on it come straight from a shuffle and a hot root's rows can be split
        parents = _flat(materialise(parents, f"{name}-parents-{turn}"), f"{name}-{turn}")
        found = found.join(parents.withColumnRenamed("node", "_n"), F.col("component") == F.col("_n"), "left")
        found = materialise(found.select("node", F.coalesce("parent", "component").alias("component")), f"{name}-found-{turn}")
        for c in ("a", "b"):
            edges = edges.join(parents.select(F.col("node").alias(c), F.col("parent").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
        edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-edges-{turn}")
        turn += 1
    return found


def _flat(parents: DataFrame, name: str) -> DataFrame:
    """Every node's root; parents never stand above their nodes, so there are no cycles."""
    turn = 0
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_up"))
        jumped = parents.join(up, F.col("parent") == F.col("_n"), "left")
        jumped = materialise(jumped.select("node", F.coalesce("_up", "parent").alias("parent"), (F.coalesce("_up", "parent") != F.col("parent")).alias("moved")), f"{name}-jump-{turn}")
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents
        turn += 1
