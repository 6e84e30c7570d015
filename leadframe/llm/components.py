"""Connected components of a list of edges of any size.

Tasks of up to FEW edges first replace them by a spanning forest, in bounded memory and without a shuffle. If there is one
such task, or at most FEW edges are left in all, which one task unites, that is the result. If more are left, alternating
large-star and small-star steps go on with them, which spread any component over all tasks. All ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable, gathered

#: Edges that one task unites: 16 MB of them, and about six times that while it works.
FEW = 1 << 20


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of the edges but those smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            break
        x, y = low[apart], high[apart]
        np.minimum.at(parent, y, x)
        while True:  # halve the paths until all are of length one
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        x, y = parent[x], parent[y]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


class Forest:
    """Edges of one task, replaced by their spanning forest whenever there are `limit` of them.

    `add` gives back edges that have to be sent on because the forest itself has outgrown half the limit."""

    def __init__(self, limit: int = FEW):
        self.limit, self.held, self.size = limit, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        if len(a):
            self.held.append((a, b))
            self.size += len(a)
        if self.size < self.limit:
            return None
        forest = self.take()
        if len(forest[0]) > self.limit // 2:
            return forest
        self.held, self.size = [forest], len(forest[0])
        return None

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        held, self.held, self.size = self.held, [], 0
        return spanning(*(np.concatenate([none, *(h[k] for h in held)]) for k in (0, 1)))


def forests(edges: DataFrame, limit: int = FEW) -> DataFrame:
    """(u, v): edges with the same components as `edges`, a forest for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(limit)

        def out(found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

        for batch in batches:
            full = forest.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if full is not None:
                yield out(full)
        yield out(forest.take())

    return edges.mapInArrow(run, "u long, v long")


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) as `components` gives them, for (u, v) edges of any number.

    Alternates large-star and small-star until nothing changes; a round takes four shuffles of the edges, and the
    number of rounds grows with the logarithm of the longest chain."""
    u, v = F.col("u"), F.col("v")

    def facing(x: Column, y: Column) -> list[Column]:
        return [F.greatest(x, y).alias("u"), F.least(x, y).alias("v")]

    now = durable(edges.select(*facing(u, v)).where(u != v).distinct())
    seen = None
    while True:
        # The sum may be of any size, so it is taken as a decimal.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The smallest neighbours are written down first, so that a node with very many edges can be split in the join.
        least = durable(both.groupBy("u").agg(F.min(F.least(u, v)).alias("m")))
        large = durable(both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct())
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        now = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(u, v): every node u of the edges (two columns of longs) with the smallest node v of its component, v itself left out.

    `edges` is durable. An edge from a node to itself is ignored; no edges give an empty result."""
    rows = edges.count()
    now = durable(forests(gathered(edges, rows, few)))
    if rows <= few:
        return now
    rows = now.count()
    return durable(forests(gathered(now, rows, few))) if rows <= few else stars(now)
