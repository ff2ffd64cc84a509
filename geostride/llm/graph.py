"""Connected components of a distributed graph, and of a small one in a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostride.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), of any orderable type. Returns (node, component): the smallest node of its component, for every
    node of an edge.

    Each round points every node at its smallest neighbour (a grouped minimum, combined before the exchange, so that a
    node with a third of all edges is no hot spot), shortens the pointers by joining them with themselves, and contracts
    the edges. A round at least halves the nodes of every component, and rounds end when no edge is left. Every round is
    written to the shared folder, which cuts the lineage, and the round before it is deleted; nothing is collected."""
    edges = materialize(edges.filter("a <> b").distinct(), "cc-edges")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        pointers = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to")), "cc-pointers")
        moved = True
        while moved:
            following = pointers.select(F.col("node").alias("n2"), F.col("to").alias("to2"))
            joined = materialize(pointers.join(following, F.col("to") == F.col("n2")).select("node", F.col("to2").alias("to"), (F.col("to") != F.col("to2")).alias("moved")), "cc-pointers")
            discard(pointers)
            pointers, moved = joined, not joined.filter("moved").isEmpty()
        step = pointers.select(F.col("node").alias("n2"), "to")
        if labels is None:
            shorter = pointers.select("node", F.col("to").alias("component"))
        else:
            shorter = labels.join(step, F.col("component") == F.col("n2"), "left").select("node", F.coalesce("to", "component").alias("component"))
        shorter = materialize(shorter, "cc-labels")
        left = edges.join(step, F.col("a") == F.col("n2")).select(F.col("to").alias("a"), "b")
        left = left.join(step, F.col("b") == F.col("n2")).select("a", F.col("to").alias("b"))
        left = materialize(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        discard(edges, labels, pointers)
        edges, labels = left, shorter
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    discard(edges)
    return labels


class UnionFind:
    """Components of 0 .. n-1; a root is the smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                return p
            p = self.parent = q
