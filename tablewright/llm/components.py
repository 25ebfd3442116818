"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that its links reach, itself included.

    Links with a null end or from a node to itself say nothing and are left out; repeated links count once. Each round hangs the
    neighbours of a node on the smallest of them, first the larger then the smaller ones, until the links are stars around their
    smallest nodes; rounds grow with the logarithm of a component's size. Smallest neighbours are combined before the shuffle,
    and a node with very many links is a skewed join key that adaptive execution splits. Each round is a written table.
    """
    now = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        large = _star(now, above=True)
        now = written(_star(large, above=False), "links")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _star(edges: DataFrame, above: bool) -> DataFrame:
    """Links (a, b), a > b, hung on the smallest neighbour (or itself) of each node."""
    if above:
        both = _both(edges)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(least, "a").select(F.inline(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m")))).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.where("a > b").distinct()


class Forest:
    """Links inside one task: joins that tell something new are kept, at most one less than there are rows."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.parts = n
        self.kept: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.parts -= 1
            self.kept.append((a, b))

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            self.join(x, y)
