"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.lineage import cut, parts_for


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of ``edges(a, b)``.

    Each round hooks every node to its smallest neighbour, follows the hooks to their end by pointer doubling, and contracts the edges to what is
    left between different roots. A node with very many edges is reduced by the partial minimum before the shuffle; joins that meet many rows of
    one root are ordinary equi-joins, which adaptive execution splits. No table grows beyond edges plus nodes.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct())
    n = edges.count()
    parts = parts_for(n)  # no later table has more rows than twice the edges
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), parts)
        while True:
            far = hook.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            moved = hook.join(far, "root").select("node", "root", "beyond")
            step = cut(moved, parts)
            hook = step.select("node", F.col("beyond").alias("root"))
            if step.filter("root <> beyond").isEmpty():
                break
        roots = hook if roots is None else cut(_follow(roots, hook), parts)
        ends = edges.join(hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(hook.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = cut(ends.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), parts)
        if edges.isEmpty():
            return roots


def _follow(roots: DataFrame, hook: DataFrame) -> DataFrame:
    onward = hook.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
    return roots.join(onward, "root", "left").select("node", F.coalesce("beyond", "root").alias("root"))
