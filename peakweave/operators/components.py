"""Connected components of an edge list by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from peakweave.operators.hubs import HUB_ROWS, hub_join
from peakweave.session import ship, written

#: Contracted edges up to which the last ones are joined in one task, in some 100 bytes each.
FEW = 1_000_000


def _shuffled(x: Column, n: int) -> Column:
    """Another order of whole numbers, a different one each round: shifts that can be undone, so no two numbers meet."""
    for left, right in ((21, 35), (13, 7), (17, 29)):
        x = x.bitwiseXOR(F.lit(0x5DEECE66D + 0x9E3779B97F * n))
        x = x.bitwiseXOR(F.shiftleft(x, left))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, right))
    return x


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of the component of each)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    p = np.arange(len(nodes))
    while True:
        x, y = p[a], p[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[p]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
        while (p[p] != p).any():
            p = p[p]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node, root of a few edges (u, v)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if ends:
            nodes, roots = joined(np.concatenate([u for u, _ in ends]), np.concatenate([v for _, v in ends]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200, hub_rows: int = HUB_ROWS, few: int = FEW) -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node. Nodes are whole numbers.

    In each round a node takes the name of the first of itself and its neighbours, in an order that changes with the round, and edges
    go on between names. So a round leaves some half of the nodes, whatever the shape, and all rounds together cost about two of the
    first; the last ``few`` edges are joined in one task. Names are then handed back round by round. The edges of a hub (a node with
    very many) meet its name where they are instead of in one task. Self-loops count as nodes; null ends are dropped.
    """
    kind = edges.schema[a].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"nodes are whole numbers, not {kind.simpleString()}")
    ship(edges.sparkSession)
    ends = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    now, names = nodes.filter("u <> v"), []
    first = size = nodes.count()
    while size > few:
        if len(names) == max_rounds:
            raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
        mixed = lambda c, n=len(names): _shuffled(F.col(c), n)
        both = now.union(now.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min(mixed("v")), mixed("u")).alias("name"), F.count(F.lit(1)).alias("n")), "components")
        for end in ("u", "v"):
            now = hub_join(now, least.withColumnRenamed("u", end), end, "n", size, hub_rows).drop(end).withColumnRenamed("name", end)
        now = now.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = written(now, "components")
        names.append(least.select(F.col("u").alias("node"), F.col("name").alias("root")))
        size = now.count()
    roots = _in_one_task(now)
    for level in reversed(names):
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = level.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    if first > few:
        roots = written(roots, "components")
    least = roots.groupBy("root").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("n"))
    named = hub_join(roots, least, "root", "n", 2 * first, hub_rows).select("node", F.col("m").alias("component"))
    alone = nodes.filter("u = v").select(F.col("u").alias("node")).join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    return named.union(alone).select(*[F.col(c).cast(kind).alias(c) for c in ("node", "component")])
