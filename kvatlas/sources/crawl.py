"""Following links: which pages can be reached from some, and in what order they are first seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvatlas.sources.files import kept


def walk(links: DataFrame, starts: DataFrame) -> DataFrame:
    """node, round, place: all nodes that ``links`` (src, pos, dst) lead to from ``starts`` (node, pos), each once.

    A round follows the links of the nodes that the round before saw first; it ends when nothing new comes, so
    cycles are no matter. ``place`` grows in order of first sight within a round: by the place of the page that has the link, then
    by the link's position (ties by name). Rounds are written, so none is computed twice.
    """
    sight = F.struct("from", "pos", "node")
    found = starts.where("node is not null").select("node", F.lit(0).cast("long").alias("from"), F.col("pos").cast("long").alias("pos"))
    edges = links.where("src is not null and dst is not null").select("src", F.col("pos").cast("long").alias("pos"), F.col("dst").alias("node"))
    visited, number = None, 0
    while True:
        first = found.groupBy("node").agg(F.min(sight).alias("sight"))
        if visited is not None:
            first = first.join(visited.select("node"), "node", "left_anti")
        # ids that grow along the sorted rows: an order without numbering all of them in one task
        new = kept(first.orderBy("sight").select("node", F.lit(number).alias("round"), F.monotonically_increasing_id().alias("place")), "round")
        if new.isEmpty():
            return new if visited is None else visited
        visited = new if visited is None else visited.unionByName(new)
        if number % 8 == 7:
            visited = kept(visited, "visited")  # one table in place of eight
        found = new.join(edges, new["node"] == edges["src"]).select(edges["node"], F.col("place").alias("from"), "pos")
        number += 1
