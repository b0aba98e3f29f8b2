"""Connected components of an undirected graph, by contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexflow.llm.common import Workspace


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b), component being its smallest reachable node.

    Each round points every node at the smallest of itself and its neighbours, follows the pointers
    to their roots, then contracts the edges to roots. Smallest ids always win, so the last root of a node
    is the smallest id of its component. Rows with a null end and loops link nothing. Rounds grow with the
    logarithm of the longest path. Minima are combined before each shuffle, so a node with very many
    links costs one row a task; every round is a written table in the shared folder.
    """
    edges = ws.save(links.where("a < b").select("a", "b").unionByName(links.where("b < a").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = ws.save(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")), "points")
        while True:
            up = points.select(F.col("node").alias("to"), F.col("to").alias("up"))
            jumped = ws.save(points.join(up, "to").select("node", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")), "jump")
            points = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = points.select("node", F.col("to").alias("component"))
        else:
            hop = points.select(F.col("node").alias("component"), "to")
            labels = ws.save(labels.join(hop, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        end = lambda c: points.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        rest = edges.join(end("a"), "a").join(end("b"), "b").where("to_a != to_b")
        edges = ws.save(rest.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if labels is None else labels
