"""Connected components of a graph of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, written


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges that join what the pairs of numbers below n join, without cycles."""
    root, edges = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for one, other in pairs:
        for a, b in zip(one.tolist(), other.tolist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((a, b))
    return edges


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours are linked to the least of the node and all its neighbours. Edges come with u > v.

    The least neighbours are a written table, returned besides: so both sides of the join are plain exchanges, and the
    rows of a node with very many neighbours can be split over tasks.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "n"), "least")
    return edges.join(least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v")).filter("u != v").distinct(), least


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u")
        .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .filter("u != v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link; root is the least node that can be reached.

    edges: columns u and v of one ordered type, in any direction, repeats and loops allowed. Each round is cut off by a
    written table, so a lost executor costs no more than the round. Ends when a round changes nothing: the rounds grow as
    the square of the logarithm of the nodes at most.
    """
    held = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    before, after = None, _digest(held)
    while after != before:
        step, least = _large_star(held)
        new = written(_small_star(step), "edges")
        drop_table(held)
        drop_table(least)
        held, before, after = new, after, _digest(new)
    return held.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, whatever their order."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
