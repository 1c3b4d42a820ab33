"""Bottleneck levels: the lowest level at which ground is reached from sources, over neighbouring cells.

The way from a source to a cell costs its highest cell. A component's cheapest edge out of it is on a best way to each
of its cells (every way in costs at least as much), so components hook along their cheapest edges, as in Boruvka's
spanning forest, and a cell keeps the cost of the hooks between it and its component's head:
``level(cell) = max(level(head), cost)``.

Rounds go over tiles. In its tile a component hooks as long as its cheapest edge stays inside; a component whose
cheapest edge leaves the tile waits. Between rounds edges are renamed to heads, and tiles get four times as wide. So a
tile holds ``TILE`` squared cells in the first round and at most what waits at its inner borders later on, never the
grid. The rounds' results are put together from the last to the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .grid import _SIDE, TILE, cell_id, with_tiles

ROOT, NONE = -1, -2  # what all sources hang on; no label
_ROWS = "kind int, a bigint, b bigint, w double, head bigint, label bigint"


def _hook(u, v, w, label, own):
    """One tile. Edges ``(u, v, w, label)`` of the ``own`` nodes: to each other (in one direction), to ``ROOT``, or out.

    Gives ``(head, cost, label)`` by own node (head ``ROOT`` where the level is settled) and the edges that are left
    between heads or from a head to ``ROOT``.
    """
    at = np.searchsorted(own, u)
    to = np.minimum(np.searchsorted(own, v), len(own) - 1)
    to = np.where(v == ROOT, -1, np.where(own[to] == v, to, -2))
    order = np.lexsort((np.maximum(u, v), np.minimum(u, v), w))
    parent, cost = list(range(len(own))), [-np.inf] * len(own)
    state = [0] * len(own)  # of heads: 0 hooks, 1 waits, 2 is settled
    named = [NONE] * len(own)
    rooted = set()
    left = []

    def head(i):
        way = []
        while parent[i] != i:
            way.append(i)
            i = parent[i]
        c = -np.inf
        for j in reversed(way):  # from below the head down: each then stands right below it
            c = cost[j] = max(cost[j], c)
            parent[j] = i
        return i

    for i, j, c, name in zip(at[order].tolist(), to[order].tolist(), w[order].tolist(), label[order].tolist()):
        a = head(i)
        if j == -1:
            if state[a] == 0:
                state[a], cost[a], named[a] = 2, c, name
            elif state[a] == 1 and a not in rooted:
                rooted.add(a)
                left.append((a, ROOT, c, name))
        elif j == -2:
            state[a] = state[a] or 1
        elif (b := head(j)) != a:
            if state[a] and (not state[b] or state[a] == 2):
                a, b = b, a
            if state[a] == 0:
                parent[a], cost[a] = b, c
            elif state[a] == 1 and state[b] == 2:
                left.append((a, ROOT, c, named[b]))
            elif state[a] == 1:
                left.append((a, b, c, NONE))
    heads, costs, labels = [], [], []
    for i in range(len(own)):
        a = head(i)
        done = state[a] == 2
        heads.append(ROOT if done else a)
        costs.append(max(cost[i], cost[a]) if done else (cost[i] if a != i else -np.inf))
        labels.append(named[a])
    heads = np.array(heads, np.int64)
    return np.where(heads == ROOT, ROOT, own[heads]), np.array(costs), np.array(labels, np.int64), left


def _round(own, u, v, w, label):
    """Rows of ``_ROWS``: kind 0 a node with its head; 1 an edge between heads; 2 an edge out of the tile, as seen from here."""
    inner = np.isin(v, own)
    keep = ~inner | (u < v)
    u, v, w, label, inner = (x[keep] for x in (u, v, w, label, inner))
    head, cost, name, left = _hook(u, v, w, label, own)
    out = ~inner & (v != ROOT)
    at = np.searchsorted(own, u[out])
    rows = [
        (np.zeros(len(own), np.int32), own, np.full(len(own), ROOT), cost, head, name),
        (np.ones(len(left), np.int32), np.array([own[x[0]] for x in left], np.int64), np.array([x[1] if x[1] == ROOT else own[x[1]] for x in left], np.int64), np.array([x[2] for x in left], float), np.full(len(left), ROOT), np.array([x[3] for x in left], np.int64)),
        (np.full(out.sum(), 2, np.int32), np.minimum(u[out], v[out]), np.maximum(u[out], v[out]), np.maximum(w[out], cost[at]), head[at], name[at]),
    ]
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["kind", "a", "b", "w", "head", "label"])


def _first(t: pa.Table) -> pa.Table:
    """A tile of cells ``(id, z, mine, start, label)``, those beside it among them (not mine)."""
    ids, z, mine = (t.column(c).to_numpy() for c in ("id", "z", "mine"))
    order = np.argsort(ids)
    ids, z, mine = ids[order], z[order], mine[order]
    start, label = (t.column(c).to_numpy(zero_copy_only=False)[order] for c in ("start", "label"))
    u, v, w = [], [], []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                want = ids + dy * _SIDE + dx
                at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
                i = np.flatnonzero((ids[at] == want) & mine)
                u.append(ids[i])
                v.append(ids[at[i]])
                w.append(np.maximum(z[i], z[at[i]]))
    s = np.flatnonzero(mine & ~np.isnan(start))
    u, v, w = np.concatenate([*u, ids[s]]), np.concatenate([*v, np.full(len(s), ROOT)]), np.concatenate([*w, np.maximum(start[s], z[s])])
    return _round(ids[mine], u, v, w, np.concatenate([np.full(len(u) - len(s), NONE), label[s].astype(np.int64)]))


def _later(t: pa.Table) -> pa.Table:
    """A tile of edges ``(u, v, w, label)`` between heads, each in the tile of its ``u``."""
    u, v, w, label = (t.column(c).to_numpy() for c in ("u", "v", "w", "label"))
    return _round(np.unique(u), u, v, w, label)


def _tile(c: Column, width: int) -> list[Column]:
    high = F.floor(c / F.lit(_SIDE * _SIDE))
    return [high.alias("_t"), F.floor(F.floor(c / F.lit(_SIDE)) % _SIDE / width).alias("_ty"), F.floor(c % _SIDE / width).alias("_tx")]


def bottleneck_levels(cells: DataFrame, sources: DataFrame, key: str | None = None, tile: int | None = None) -> DataFrame:
    """``(key, y, x, level, label)``: the lowest level from which water of a source reaches each cell, and that source's label.

    ``cells(key, y, x, z)`` are the ground; ``sources(key, y, x, start, label)`` the cells where water comes in, from
    ``start`` on (their own ground counts as well). Neighbours are the eight around a cell. Cells that no source reaches
    have no row. Of sources that reach a cell at the same level, any is named. ``key`` is a whole number under 2^23.
    """
    width = tile or TILE
    k = None if key is None else F.col(key)
    keys = [] if key is None else [key]
    s = sources.groupBy(*keys, "y", "x").agg(F.min(F.struct("start", "label")).alias("_s"))
    c = cells.join(s, [*keys, "y", "x"], "left").withColumn("id", cell_id(k))
    t = with_tiles(c.withColumn("_k", F.lit(0) if k is None else k), F.col("_k"), width).select(
        "_t", "_ty", "_tx", "id", F.col("z").cast("double").alias("z"), "mine", F.col("_s.start").cast("double").alias("start"), F.coalesce("_s.label", F.lit(NONE)).cast("bigint").alias("label")
    )
    rounds = [stage(t.groupBy("_t", "_ty", "_tx").applyInArrow(_first, _ROWS), "bottleneck")]
    while True:
        rows = rounds[-1]
        inside = rows.filter("kind = 1").select("a", "b", "w", "label")
        halves = rows.filter("kind = 2").groupBy("a", "b").agg(F.max("w").alias("w"), F.min("head").alias("lo"), F.max("head").alias("hi"), F.max(F.when(F.col("head") == ROOT, F.col("label"))).alias("label"))
        across = halves.filter("lo <> hi").select(F.col("hi").alias("a"), F.col("lo").alias("b"), "w", F.coalesce("label", F.lit(NONE)).alias("label"))
        edges = inside.unionByName(across)
        both = edges.unionByName(edges.filter(F.col("b") != ROOT).select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "label"))
        both = both.groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.min(F.struct("w", "label")).alias("_m")).select("u", "v", "_m.w", "_m.label")
        if rows.filter("kind > 0").isEmpty():
            break
        width *= 4
        rounds.append(stage(both.groupBy(*_tile(F.col("u"), width)).applyInArrow(_later, _ROWS), "bottleneck"))
    done = None
    for rows in reversed(rounds):
        nodes = rows.filter("kind = 0").select(F.col("a").alias("id"), "head", "w", "label")
        if done is None:
            done = nodes.filter(F.col("head") == ROOT).select("id", F.col("w").alias("level"), "label")
            continue
        above = done.select(F.col("id").alias("head"), F.col("level").alias("_l"), F.col("label").alias("_n"))
        met = nodes.join(above, "head", "left").filter((F.col("head") == ROOT) | F.col("_l").isNotNull())
        done = met.select("id", F.when(F.col("head") == ROOT, F.col("w")).otherwise(F.greatest("w", "_l")).alias("level"), F.when(F.col("head") == ROOT, F.col("label")).otherwise(F.col("_n")).alias("label"))
    back = [] if key is None else [F.floor(F.col("id") / F.lit(_SIDE * _SIDE)).cast("bigint").alias(key)]
    cell = F.col("id") % F.lit(_SIDE * _SIDE)
    return done.select(*back, F.floor(cell / F.lit(_SIDE)).cast("int").alias("y"), (cell % _SIDE).cast("int").alias("x"), "level", F.when(F.col("label") != NONE, F.col("label")).alias("label"))
