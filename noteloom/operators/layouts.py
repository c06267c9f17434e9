"""Deterministic layouts of a graph slice: id, x, y in a width by height area.

Radial and groups layouts are column expressions over ranks; force, tree and blocks layouts are sequential and run
as one group over a slice, whose size the caller has capped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import min_cut
from .workspace import cut, numbered

W, H = 800.0, 600.0


def _one_group(node_ids: DataFrame, edge_rows: DataFrame, place, most: int = 5000) -> DataFrame:
    both = node_ids.select(F.col("id").alias("source"), F.lit(None).cast("string").alias("target")).unionByName(edge_rows.select("source", "target"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(f.source[f.target.isna()])
        if len(ids) > most:
            raise ValueError(f"{len(ids)} nodes; layouts take slices of at most {most}")
        known, e = set(ids), f[f.target.notna()]
        pairs = [(a, b) for a, b in zip(e.source, e.target, strict=True) if a in known and b in known and a != b]
        at = place(ids, sorted(pairs))
        return pd.DataFrame({"id": ids, "x": [float(at[i][0]) for i in ids], "y": [float(at[i][1]) for i in ids]})

    return both.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "id string, x double, y double")


#: Nodes on a side of the tiles in which repulsion is computed; a tile fits a core's cache.
TILE = 128


def _repulsion(p: np.ndarray, k: float) -> np.ndarray:
    """The push of all nodes on each, in tiles of pairs, each pair once: memory grows with the nodes, not with their pairs.

    A node's pushes are summed one by one in the order of the nodes, so the sum does not depend on the tiles.
    """
    x, y = np.ascontiguousarray(p.T)
    out = np.zeros((2, len(p)))

    def add(side: int, to: slice, pushes: np.ndarray) -> None:
        out[side, to] = np.concatenate([out[side, to][None], pushes]).sum(0)

    for i in range(0, len(p), TILE):
        for j in range(i, len(p), TILE):
            a, b = slice(i, min(i + TILE, len(p))), slice(j, min(j + TILE, len(p)))
            dx, dy = x[a, None] - x[None, b], y[a, None] - y[None, b]
            dist = np.maximum(np.hypot(dx, dy), 0.01)
            force = k * k / dist
            for side, d in enumerate((dx, dy)):
                push = d / dist * force  # of b on a; that of a on b is its opposite
                add(side, a, np.ascontiguousarray(push.T))
                if j > i:
                    add(side, b, -push)
    return out.T


def force_positions(ids, pairs, width=W, height=H, iterations=300, seed=None, fixed=None) -> dict:
    """Repulsion k^2 / d of all pairs, attraction d^2 / k of edges, a falling step limit and a weak pull to the centre."""
    n = len(ids)
    k, centre = math.sqrt(width * height / max(1, n)), np.array([width / 2, height / 2])
    angle = 2 * np.pi * np.arange(n) / max(1, n)
    p = centre + np.stack([np.cos(angle), np.sin(angle)], 1) * (0.3 * min(width, height) if n > 1 else 0.0)  # a single node sits in the centre
    row = {v: i for i, v in enumerate(ids)}
    for v, xy in {**(seed or {}), **(fixed or {})}.items():
        if v in row:
            p[row[v]] = xy
    pinned = np.array([v in (fixed or {}) for v in ids], bool)
    a, b = np.array([row[x] for x, _ in pairs], int), np.array([row[y] for _, y in pairs], int)
    limit = 0.1 * min(width, height)
    for _ in range(iterations):
        move = _repulsion(p, k)
        if len(a):
            d = p[a] - p[b]
            size = np.maximum(np.hypot(d[:, 0], d[:, 1]), 0.01)
            pull = d / size[:, None] * (size * size / k)[:, None]
            np.subtract.at(move, a, pull)
            np.add.at(move, b, pull)
        size = np.maximum(np.hypot(move[:, 0], move[:, 1]), 0.01)
        step = move / size[:, None] * np.minimum(size, limit)[:, None] + (centre - p) * 0.01
        p = np.where(pinned[:, None], p, p + step)
        limit *= 0.97
    return {v: tuple(p[i]) for v, i in row.items()}


def force_layout(node_ids: DataFrame, edge_rows: DataFrame, **options) -> DataFrame:
    return _one_group(node_ids, edge_rows, lambda ids, pairs: force_positions(ids, pairs, **options))


def tree_positions(ids, pairs, width=W, height=H, gap_x=80.0, gap_y=90.0) -> dict:
    """Layers from longest paths (edges that close a cycle are ignored), ordered by the mean of their parents, fitted to the area."""
    out: dict = {i: [] for i in ids}
    for a, b in pairs:
        out[a].append(b)
    state, back = dict.fromkeys(ids, 0), set()
    for root in ids:
        stack = [(root, iter(out[root]))] if not state[root] else []
        state[root] = state[root] or 1
        while stack:
            v, rest = stack[-1]
            for u in rest:
                if state[u] == 1:
                    back.add((v, u))
                elif state[u] == 0:
                    state[u] = 1
                    stack.append((u, iter(out[u])))
                    break
            else:
                state[v] = 2
                stack.pop()
    down = [e for e in pairs if e not in back]
    layer, parents = dict.fromkeys(ids, 0), {i: [] for i in ids}
    for _ in ids:
        moved = False
        for a, b in down:
            if layer[b] < layer[a] + 1:
                layer[b], moved = layer[a] + 1, True
        if not moved:
            break
    for a, b in down:
        parents[b].append(a)
    x: dict = {}
    for depth in range(max(layer.values(), default=0) + 1):
        row = [i for i in ids if layer[i] == depth]
        mean = lambda i: np.mean([x[p] for p in parents[i]]) if parents[i] else 0.0
        row.sort(key=lambda i: (mean(i), i))
        for j, i in enumerate(row):
            x[i] = (j - (len(row) - 1) / 2) * gap_x
    wide, tall = max((abs(v) for v in x.values()), default=0) * 2, max(layer.values(), default=0) * gap_y
    scale = min(1.0, (width - 40) / max(wide, 1), (height - 40) / max(tall, 1))
    return {i: (width / 2 + x[i] * scale, height / 2 + (layer[i] * gap_y - tall / 2) * scale) for i in ids}


def tree_layout(node_ids: DataFrame, edge_rows: DataFrame, **options) -> DataFrame:
    return _one_group(node_ids, edge_rows, lambda ids, pairs: tree_positions(ids, pairs, **options))


def block_positions(ids, pairs, width=W, height=H) -> dict:
    """Nested min-cuts: an area is cut across its longer side in proportion to the halves' sizes; a node sits in its cell's centre."""
    at, stack = {}, [(ids, 0.0, 0.0, width, height)]
    while stack:
        some, x, y, w, h = stack.pop()
        if len(some) <= 1:
            at.update({i: (x + w / 2, y + h / 2) for i in some})
            continue
        inside = set(some)
        a, b, _ = min_cut(some, [e for e in pairs if e[0] in inside and e[1] in inside])
        share = len(a) / len(some)
        stack += [(a, x, y, w * share, h), (b, x + w * share, y, w * (1 - share), h)] if w >= h else [(a, x, y, w, h * share), (b, x, y + h * share, w, h * (1 - share))]
    return at


def blocks_layout(node_ids: DataFrame, edge_rows: DataFrame, **options) -> DataFrame:
    """At most 2,000 nodes, as bisected(): its cuts are cubic."""
    return _one_group(node_ids, edge_rows, lambda ids, pairs: block_positions(ids, pairs, **options), 2000)


def hops(node_ids: DataFrame, edge_rows: DataFrame, centre: str) -> DataFrame:
    """id, ring: hops from centre; nodes out of reach are one ring farther than the last."""
    both = cut(edge_rows.select(F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("e")).select("e.*").distinct())
    reached = cut(node_ids.select("id").where(F.col("id") == centre).distinct().withColumn("ring", F.lit(0)))
    depth = 0
    while True:
        near = both.join(reached.where(F.col("ring") == depth), F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct()
        new = cut(near.join(node_ids.select("id"), "id", "left_semi").join(reached, "id", "left_anti").withColumn("ring", F.lit(depth + 1)))
        if not new.limit(1).count():
            break
        reached, depth = reached.union(new), depth + 1
    return node_ids.select("id").distinct().join(reached, "id", "left").select("id", F.coalesce("ring", F.lit(depth + 1)).alias("ring"))


def radial_layout(node_rows: DataFrame, edge_rows: DataFrame, focus: str | None = None, width: float = W, height: float = H) -> DataFrame:
    """id, ring, x, y: focus (else the node of highest degree) in the centre, the others on a ring per hop, by id from the top."""
    node_rows = cut(node_rows.select("id", *(["degree"] if focus is None else [])))
    if focus is None:
        first = node_rows.orderBy(F.desc("degree"), "id").limit(1).collect()
        if not first:
            return node_rows.select("id", F.lit(0).alias("ring"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        focus = first[0]["id"]
    r = cut(hops(node_rows, edge_rows, focus))
    last = r.agg(F.greatest(F.lit(1), F.max("ring")).alias("last"))
    w = Window.partitionBy("ring")
    nth, count = F.row_number().over(w.orderBy("id")) - 1, F.count(F.lit(1)).over(w)
    placed = r.crossJoin(F.broadcast(last)).select("id", "ring", "last", (2 * math.pi * nth / count - math.pi / 2).alias("angle"))  # one row
    radius = F.col("ring") * (0.42 * min(width, height)) / F.col("last")
    return placed.select("id", "ring", (width / 2 + radius * F.cos("angle")).alias("x"), (height / 2 + radius * F.sin("angle")).alias("y"))


def groups_layout(communities: DataFrame, width: float = W, height: float = H) -> DataFrame:
    """id, community, x, y: communities by size on a ring, each one's nodes by id on a circle around its place."""
    small = min(width, height)
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("m"))
    ranked = numbered(sizes, "g", F.desc("m"), "community")
    ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("k"))))  # one row
    ring = F.when(F.col("k") == 1, 0.0).otherwise(0.32 * small)
    a = 2 * math.pi * F.col("g") / F.col("k") - math.pi / 2
    own = 0.05 * small * F.sqrt("m")
    local = F.when(F.col("k") == 1, F.least(F.lit(0.38 * small), own)).otherwise(F.least(0.8 * 0.32 * small * F.sin(math.pi / F.col("k")), own))
    centres = ranked.select("community", "m", (width / 2 + ring * F.cos(a)).alias("cx"), (height / 2 + ring * F.sin(a)).alias("cy"), F.when(F.col("m") == 1, 0.0).otherwise(local).alias("r"))
    placed = cut(numbered(communities.select("id", "community"), "_at", "community", "id"))  # not by a window, which would sort a community in one task
    first = placed.groupBy("community").agg(F.min("_at").alias("_first"))
    both = placed.join(centres.join(first, "community"), "community").withColumn("i", F.col("_at") - F.col("_first"))
    b = 2 * math.pi * F.col("i") / F.col("m") - math.pi / 2
    return both.select("id", "community", (F.col("cx") + F.col("r") * F.cos(b)).alias("x"), (F.col("cy") + F.col("r") * F.sin(b)).alias("y"))
