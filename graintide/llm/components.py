"""Connected components of a distributed edge list by contraction.

In each round every node takes the smallest of itself and its neighbours, and then what that one took. Edges between
what their ends took are the next round's, so that the nodes at least halve and the edges shrink with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graintide.session import staged


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component) for every id of edges (u, v), component being the smallest id reachable; every round is written out.

    Joins come right after their shuffles, so that an id with very many edges is split. Null ends are ignored."""
    tidy = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    left = staged(tidy(edges), "edges")
    labels = None
    for _ in range(rounds):
        ends = left.union(left.select("v", "u"))
        taken = staged(ends.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component")), "taken")
        root = taken.select(F.col("id").alias("component"), F.col("component").alias("root"))
        taken = staged(taken.join(root, "component").select("id", F.col("root").alias("component")), "taken")
        if labels is None:
            labels = taken
        else:
            later = taken.select(F.col("id").alias("component"), F.col("component").alias("root"))
            labels = staged(labels.join(later, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
        if left.isEmpty():
            return labels
        for end in ("u", "v"):
            moved = taken.select(F.col("id").alias(end), F.col("component").alias("to"))
            left = left.join(moved, end).select(F.col("to").alias(end), "v" if end == "u" else "u")
        left = staged(tidy(left), "edges")
        if left.isEmpty():
            return labels
    raise RuntimeError(f"components didn't settle within {rounds} rounds")
