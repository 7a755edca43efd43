"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, look_up
from quarry.scale import gathered


def _follow(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """Each node's root replaced by that root's own root, where it has one."""
    up = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
    return look_up(labels, up, "root").select("node", F.coalesce("_up", "root").alias("root"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long).

    Contraction rounds: each node hooks to its smallest neighbour, pointers are
    doubled until all show to roots, and the edges are rewritten to roots. The
    number of nodes at least halves in a round. Nothing but emptiness tests comes
    to the driver. Every round is cut by checkpoint(), so a lost executor costs
    one step. An empty table gives an empty result.
    """
    pair = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = checkpoint(pair(edges))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
        while True:
            doubled = checkpoint(
                gathered(look_up(parents, parents.select(F.col("node").alias("root"), F.col("root").alias("_up")), "root"))
                .select("node", F.coalesce("_up", "root").alias("root"), (F.col("_up") < F.col("root")).alias("moved"))
            )
            parents = doubled.drop("moved")
            if doubled.filter("moved").isEmpty():
                break
        rounds.append(parents)
        a, b = parents.toDF("a", "ra"), parents.toDF("b", "rb")
        edges = checkpoint(pair(edges.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = rounds[0]
    for parents in rounds[1:]:
        labels = _follow(labels, parents)
    return labels
