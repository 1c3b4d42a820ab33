"""Connected components of an edge table, by alternating stars.

Each round links every node to the smallest neighbour it knows (large star over both directions, then small star over
the smaller side). Before the rounds each task replaces its own edges by stars. Rounds are stored in the shared folder,
so lineage stays short and a lost executor costs one round at most.

The centre of a large component is a node with very many edges; such nodes are joined apart (see ``skew``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .skew import join_counted

CHUNK = 1 << 21  # edges that a task holds at once


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the roots, with its component's smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:  # the smaller label spreads over edges; jumping halves the way
        a, b = root[i], root[j]
        new = root.copy()
        np.minimum.at(new, a, b)
        np.minimum.at(new, b, a)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _contract(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars, so many at a time."""

    def run(rows):
        held, n = [], 0

        def out():
            u, v = _stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            for i in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], ["u", "v"])

        for b in rows:
            held.append([c.to_numpy() for c in b.columns])
            n += b.num_rows
            if n >= CHUNK:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    return edges.mapInArrow(run, "u bigint, v bigint")


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` with the smallest node of each component, for every node that has an edge.

    Edges are undirected, of any number and order; loops and nulls are left out; an empty table gives an empty result.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u <> v")
    e = stage(_contract(e).distinct(), "edges")
    seen = _signature(e)
    least = [F.min("v").alias("m"), F.count(F.lit(1)).alias("d")]
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(*least).withColumn("m", F.least("u", "m"))
        large = join_counted(both, low, "u", 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # After the large star all edges point to a smaller node.
        large = stage(large, "large-stars")
        low = large.groupBy("u").agg(*least)
        small = join_counted(large, low, "u", 2 * seen[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if (now := _signature(e)) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
