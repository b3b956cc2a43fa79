"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvatlas.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component for each node of ``edges`` (a, b); a component is named by its smallest node.

    Each round every node moves to its smallest neighbour, edges move along, and loops go; the smallest node of
    a component never moves. Rounds are written to the shared folder, so no round's loss repeats another. Hubs
    are met by minima that are combined before the shuffle, and by joins of plain tables, which Spark can split.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        move = stored(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "moves")
        moves.append(move)
        edges = (
            edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct()
        )
        edges = stored(edges, "edges")
    found = nodes.withColumn("component", F.col("node"))
    for move in moves:
        found = found.join(move.select(F.col("node").alias("component"), "to"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")
        )
    return stored(found, "components")
