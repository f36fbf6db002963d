"""Connected components by repeated contraction, for graphs of any size.

In each round every node points to the least of itself and its neighbours, in an
order that a hash draws anew each round; the graph of the nodes pointed to is what is
left. Pointers are then followed back from the last round to the first. Rounds grow
with the logarithm of the nodes. Every round is checkpointed; no part of
the graph reaches the driver but the number of edges left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.scale import stable


def _pointers(edges: DataFrame, turn: int) -> DataFrame:
    """(node, to): the least of a node and its neighbours in this round's order."""
    def drawn(name: str):
        return F.struct(F.xxhash64(F.lit(turn), F.col(name)).alias("draw"), F.col(name).alias("node"))

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min(drawn("b")).alias("near"))
    return near.select(F.col("a").alias("node"), F.least(drawn("a"), F.col("near"))["node"].alias("to"))


def _distinct_edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return (
        pairs.where(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable. Only nodes with an edge to another have a row."""
    left = stable(_distinct_edges(edges, a, b))
    rounds: list[DataFrame] = []
    while left.take(1):
        pointers = stable(_pointers(left, len(rounds)))
        rounds.append(pointers)
        ends = left.join(pointers.select(F.col("node").alias("a"), F.col("to").alias("pa")), "a")
        ends = ends.join(pointers.select(F.col("node").alias("b"), F.col("to").alias("pb")), "b")
        left = stable(_distinct_edges(ends, "pa", "pb"))
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = rounds[-1]
    for pointers in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = stable(pointers.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("to")))
    least = roots.groupBy("to").agg(F.least(F.min("node"), F.min("to")).alias("component"))
    return stable(roots.join(least, "to").select("node", "component"))
