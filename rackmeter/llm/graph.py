"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackmeter.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Each round gives every node the first of itself and its neighbours as parent and replaces both ends of
    all links by their parents, until no link is left. Rounds take turns in the order of nodes, by which
    stars around their smallest node vanish at once, and a scrambled order, by which long chains shrink by
    a constant share. Links and parents of each round are written tables; the driver only learns
    whether links are left.
    """
    edge = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = stored(links.where("a != b").select(*edge).distinct(), "links")
    parents: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(parents)
        order = (lambda c: F.xxhash64(c, F.lit(turn))) if turn % 2 else F.col
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.least(F.min(F.struct(order("b").alias("o"), F.col("b").alias("n"))), F.struct(order("a").alias("o"), F.col("a").alias("n")))
        parents.append(stored(both.groupBy("a").agg(first["n"].alias("parent")).withColumnRenamed("a", "node"), "parents"))
        ends = [parents[-1].select(F.col("node").alias(e), F.col("parent").alias(f"p{e}")) for e in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = stored(moved.where("a != b").select(*edge).distinct(), "links")
    if not parents:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    nodes = parents[0].select("node", F.col("parent").alias("label"))
    for parent in parents[1:]:
        step = parent.select(F.col("node").alias("label"), "parent")
        nodes = nodes.join(step, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
    least = nodes.groupBy("label").agg(F.min("node").alias("component"))
    return stored(nodes.join(least, "label").select("node", "component"), "components")
