"""The knowledge graph of files(path, title) and triples(subject, relation, object, source_file).

edges: source, target, relation; a node is a note's name, or the text of an object that no note answers to (a ghost).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename
from .workspace import cut, numbered


def resolved(files: DataFrame, triples: DataFrame) -> DataFrame:
    """Triples with target and path: by note name, else by a path suffix without extension (the least path wins); a ghost has no path.

    Map files take no part. Suffixes are exploded, so that both lookups are equi-joins.
    """
    notes = files.where(~F.col("path").ilike("%.map.md")).select("path", basename(F.col("path")).alias("name"))
    by_name = notes.groupBy(F.col("name").alias("object")).agg(F.min("path").alias("name_path"))
    bare = F.regexp_replace("path", r"(?i)\.md$", "")
    parts = F.split(bare, "/")
    suffixes = notes.where(bare.contains("/")).select("path", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("object")).where(F.col("object").contains("/"))
    by_suffix = suffixes.groupBy("object").agg(F.min(F.struct("path", "name")).alias("s")).select("object", F.col("s.path").alias("suffix_path"), F.col("s.name").alias("suffix_name"))
    t = triples.where(~F.col("source_file").ilike("%.map.md"))
    both = t.join(by_name, "object", "left").join(by_suffix, "object", "left")
    target = F.when(F.col("name_path").isNotNull(), F.col("object")).otherwise(F.coalesce("suffix_name", "object"))
    return both.select(basename(F.col("source_file")).alias("source"), "relation", target.alias("target"), F.coalesce("name_path", "suffix_path").alias("path"))


def edges(files: DataFrame, triples: DataFrame) -> DataFrame:
    """Distinct edges without self-loops; a typed edge takes the place of a bare links_to of the same ordered pair."""
    e = resolved(files, triples).where("source <> target").select("source", "target", "relation").distinct()
    typed = F.max(F.col("relation") != "links_to").over(Window.partitionBy("source", "target"))
    return e.withColumn("typed", typed).where(~F.col("typed") | (F.col("relation") != "links_to")).drop("typed")


def nodes(files: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """id, path, ghost, degree of the nodes that edges touch."""
    ends = edge_rows.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    paths = files.where(~F.col("path").ilike("%.map.md")).groupBy(basename(F.col("path")).alias("id")).agg(F.min("path").alias("path"))
    return ends.join(paths, "id", "left").select("id", "path", F.col("path").isNull().alias("ghost"), "degree")


def local_slice(files: DataFrame, edge_rows: DataFrame, focus: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (with focus) within depth hops of focus, regardless of direction, and the edges among them."""
    spark = files.sparkSession
    edge_rows = cut(edge_rows)
    both = edge_rows.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edge_rows.select("target", "source"))
    seen = frontier = spark.createDataFrame([(focus,)], "id string")
    for _ in range(depth):
        frontier = both.join(frontier, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = cut(frontier)
        seen = seen.union(frontier)
    inside = edge_rows.join(seen.select(F.col("id").alias("source")), "source", "left_semi").join(seen.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "relation")
    n = seen.join(nodes(files, inside), "id", "left").select("id", "path", F.coalesce("ghost", F.lit(False)).alias("ghost"), F.coalesce("degree", F.lit(0)).alias("degree"), (F.col("id") == focus).alias("focus"))
    return n, inside


def global_slice(files: DataFrame, edge_rows: DataFrame, cap: int = 150) -> tuple[DataFrame, DataFrame]:
    """The cap nodes of highest degree (ties by id) with total, the number of all nodes, and the edges among them."""
    n = nodes(files, edge_rows)
    total = n.agg(F.count(F.lit(1)).alias("total"))
    top = n.orderBy(F.desc("degree"), "id").limit(cap).crossJoin(F.broadcast(total))  # one row
    ids = top.select("id")
    inside = edge_rows.join(F.broadcast(ids.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "target")), "target", "left_semi")
    return top, inside.select("source", "target", "relation")


def overlay(files: DataFrame, triples: DataFrame, run_files: DataFrame, run_triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of both sides together; each node says whether the vault, the run or both mention it."""
    all_files, all_triples = files.unionByName(run_files), triples.unionByName(run_triples)
    e = edges(all_files, all_triples)

    def names(f: DataFrame, t: DataFrame, side: str) -> DataFrame:
        r = resolved(all_files, t)
        own = f.select(basename(F.col("path")).alias("id")).union(r.select("source")).union(r.select("target"))
        return own.distinct().select("id", F.lit(side).alias("side"))

    sides = names(files, triples, "vault").unionByName(names(run_files, run_triples, "run")).groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("side").alias("side"))
    tag = F.when(F.col("c") == 2, "both").otherwise(F.col("side"))
    return nodes(all_files, e).join(sides.select("id", tag.alias("side")), "id"), e


def expand(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of two slices' node ids and edges."""
    return a[0].select("id").union(b[0].select("id")).distinct(), a[1].unionByName(b[1]).distinct()


def collapse(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The first slice's ids and edges without those of the second."""
    return a[0].select("id").exceptAll(b[0].select("id")), a[1].exceptAll(b[1])


def pagerank(node_ids: DataFrame, edge_rows: DataFrame, damping: float = 0.85, iterations: int = 50, small: int = 200_000) -> DataFrame:
    """id, rank: directed, a fixed number of iterations, the mass of nodes without targets spread evenly.

    Self-loops and edges of unknown nodes are dropped, parallel ones count. Nodes that no edge leads to all have one
    rank, so what they give is summed once and only the others, the core, are iterated. A core of up to `small` nodes
    and edges runs as one vectorised task; a larger one as joins, cut by a checkpoint every fifth iteration.
    """
    ids = node_ids.select("id").distinct()
    e = edge_rows.select("source", "target").where("source <> target")
    e = e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
    e, ids = cut(e), cut(ids)
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    out = e.groupBy("source").agg(F.count(F.lit(1)).alias("out"))
    shares = cut(e.groupBy("source", "target").agg(F.count(F.lit(1)).alias("m")).join(out, "source").select("source", "target", (F.col("m") / F.col("out")).alias("share")))
    inside = e.select(F.col("target").alias("id")).distinct()
    source = inside.withColumnRenamed("id", "source")
    given = shares.join(source, "source", "left_anti").groupBy(F.col("target").alias("id")).agg(F.sum("share").alias("given"))
    core = inside.join(out.withColumnRenamed("source", "id"), "id", "left").join(given, "id", "left")
    core = cut(core.select("id", F.col("out").isNull().alias("dangling"), F.coalesce("given", F.lit(0.0)).alias("given")))
    links = cut(shares.join(source, "source", "left_semi"))
    lone = n - e.select(F.explode(F.array("source", "target")).alias("id")).distinct().count()
    if core.count() + links.count() <= small:

        def ranks(f: pd.DataFrame) -> pd.DataFrame:
            node = f[f.id.notna() & f.target.isna()].sort_values("id")
            names, dangling, given = node.id.to_numpy(), node.dangling.to_numpy(bool), node.given.to_numpy(float)
            link = f[f.target.notna()]
            s, t, share = np.searchsorted(names, link.id.to_numpy()), np.searchsorted(names, link.target.to_numpy()), link.share.to_numpy(float)
            r, other = np.full(len(names), 1 / n), 1 / n
            for _ in range(iterations):
                even = (1 - damping) / n + damping * (r[dangling].sum() + lone * other) / n
                r, other = even + damping * (np.bincount(t, r[s] * share, minlength=len(names)) + given * other), even
            return pd.DataFrame({"id": [*names, None], "rank": [*r, other]})

        none = lambda t: F.lit(None).cast(t)
        both = core.select("id", none("string").alias("target"), none("double").alias("share"), "dangling", "given").unionByName(links.withColumnRenamed("source", "id"), allowMissingColumns=True)
        both = both.unionByName(ids.sparkSession.createDataFrame([(None,)], "id string"), allowMissingColumns=True)  # the row of the others
        got = cut(both.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(ranks, "id string, rank double"))
        other = F.lit(got.where("id is null").first()["rank"])
        got = got.where("id is not null")
    else:
        got, rank = core.withColumn("rank", F.lit(1 / n)), 1 / n
        for i in range(iterations):
            lost = got.where("dangling").agg(F.sum("rank")).first()[0] or 0.0
            even = (1 - damping) / n + damping * (lost + lone * rank) / n
            sums = links.join(got.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("sum"))
            new = got.join(sums, "id", "left").select("id", "dangling", "given", (F.lit(even) + damping * (F.coalesce("sum", F.lit(0.0)) + F.col("given") * rank)).alias("rank"))
            got, rank = cut(new) if i % 5 == 4 else new.persist(), even
        other = F.lit(rank)
    return ids.join(got.select("id", "rank"), "id", "left").select("id", F.coalesce("rank", other).alias("rank"))


def components(node_ids: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """id, component (least id): labels move along edges and jump to their label's label until none changes."""
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = edge_rows.select(F.explode(F.array(pair("source", "target"), pair("target", "source"))).alias("e")).select("e.*").where("a <> b").distinct()
    both, labels = cut(both), cut(node_ids.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("to"))
        far = labels.select(F.col("id").alias("to"), F.col("component").alias("far"))
        new = cut(step.join(far, "to", "left").select("id", "old", F.least("to", "far").alias("component")))
        labels = new.select("id", "component")
        if not new.where("old <> component").limit(1).count():
            return labels


def sweep(ids: list[str], pairs: list[tuple[str, str]], sweeps: int = 20) -> dict[str, str]:
    """Label propagation in id order, in place; ties to the least label."""
    at: dict[str, list[str]] = {i: [] for i in ids}
    for a, b in pairs:
        if a != b:
            at[a].append(b)
            at[b].append(a)
    labels = {i: i for i in ids}
    for _ in range(sweeps):
        moved = False
        for i in sorted(ids):
            counts: dict[str, int] = {}
            for j in at[i]:
                counts[labels[j]] = counts.get(labels[j], 0) + 1
            if counts:
                best = min(counts, key=lambda x: (-counts[x], x))
                moved, labels[i] = moved or best != labels[i], best
        if not moved:
            break
    return labels


def chained(names: DataFrame, at: DataFrame, rounds: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (i) by the length of the longest chain of ascending neighbours that ends at them, from 0; and those beyond `rounds`."""
    left, low = names.select("i"), at.where("b < a").select("a", "b")
    steps: list[DataFrame] = []
    while left.limit(1).count() and (rounds is None or len(steps) < rounds):
        waiting = cut(low.select(F.col("a").alias("i")).distinct())
        steps.append(cut(left.join(waiting, "i", "left_anti")))
        left, low = waiting, cut(low.join(steps[-1].withColumnRenamed("i", "b"), "b", "left_anti"))
    return steps, left


def swept(names: DataFrame, at: DataFrame, steps: list[DataFrame], sweeps: int, few: int = 100_000) -> DataFrame:
    """id, label as by sweep(), of nodes (i, id; i by id) with neighbours at (a, b, m times).

    Nodes of one step are not neighbours and those of earlier steps have moved before them, so a step moves all its
    nodes at once. A step none of whose neighbours has moved since is left out.
    """
    step = reduce(DataFrame.unionByName, [s.withColumn("step", F.lit(k)) for k, s in enumerate(steps)])
    own, other = step.toDF("a", "step"), step.toDF("b", "other")
    at = cut(at.join(own, "a").join(other, "b"))
    near: dict[int, list[int]] = {}
    for r in at.select("step", "other").distinct().orderBy("step", "other").collect():
        near.setdefault(r["step"], []).append(r["other"])
    ties = {k: cut(at.where(F.col("step") == k).select("a", "b", "m", "other")) for k in near}
    labels = [s.withColumn("label", F.col("i")) for s in steps]
    sizes = [s.count() for s in steps]
    moved, done, now = [0] * len(steps), [-1] * len(steps), 0
    for _ in range(sweeps):
        before = now
        for k, others in sorted(near.items()):
            if max(moved[j] for j in others) <= done[k]:
                continue
            done[k] = now
            narrow = [j for j in others if sizes[j] <= few]
            votes = []
            for side, hint in ((narrow, F.broadcast), ([j for j in others if j not in narrow], lambda df: df)):
                if side:
                    known = reduce(DataFrame.unionByName, [labels[j] for j in side]).withColumnRenamed("i", "b")
                    votes.append(ties[k].where(F.col("other").isin(side)).join(hint(known), "b").select("a", "label", "m"))
            count = reduce(DataFrame.unionByName, votes).groupBy("a", "label").agg(F.sum("m").alias("n"))
            best = count.groupBy(F.col("a").alias("i")).agg(F.min(F.struct(-F.col("n"), "label")).alias("best"))
            new = cut(labels[k].join(best, "i", "left").select("i", F.coalesce("best.label", "label").alias("label"), (F.col("best.label") != F.col("label")).alias("moved")))
            if new.where("moved").limit(1).count():
                now += 1
                labels[k], moved[k] = new.select("i", "label"), now
        if now == before:
            break
    label = reduce(DataFrame.unionByName, labels)
    return label.join(names.select("i", "id"), "i").join(names.select(F.col("i").alias("label"), F.col("id").alias("name")), "label").select("id", F.col("name").alias("label"))


def communities(node_ids: DataFrame, edge_rows: DataFrame, sweeps: int = 20, most: int | None = None, small: int = 200_000, deep: int = 100) -> DataFrame:
    """id, community (numbered by first appearance in id order).

    The sweep is sequential by definition (each node sees the labels that the nodes before it have just taken), but
    labels never leave a connected component: one of up to `small` nodes and edges is a task of its own. In a larger
    one, nodes wait only for neighbours before them, so all nodes at the same depth of waiting move at once. Components
    deeper than `deep` take a task, too, if they have at most 5,000,000 nodes and edges. If `most` is given, a component
    above it raises.
    """
    edge_rows = cut(edge_rows)
    c = components(node_ids, edge_rows)
    known = c.select(F.col("id").alias("source"), "component")
    link = edge_rows.join(known, "source").join(c.select(F.col("id").alias("target")), "target").select("component", "source", "target")
    both = cut(c.select("component", F.col("id").alias("source"), F.lit(None).cast("string").alias("target")).unionByName(link))
    sizes = cut(both.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if most is not None and largest > most:
        raise ValueError(f"a component of {largest} nodes and edges; label sweeps take at most {most}")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        e = f[f.target.notna()]
        labels = sweep(f.source[f.target.isna()].tolist(), list(zip(e.source, e.target, strict=True)), sweeps)
        return pd.DataFrame({"id": list(labels), "label": list(labels.values())})

    alone, parts = both, []
    if largest > small:
        of = lambda rows, some, how: rows.join(F.broadcast(some.select("component")), "component", how)  # noqa: E731  few components are large
        large = sizes.where(F.col("n") > small)
        wide = of(both, large, "left_semi")
        names = cut(numbered(wide.where("target is null").select("component", F.col("source").alias("id")), "i", "id"))
        name = lambda end, i: names.select(F.col("id").alias(end), F.col("i").alias(i))
        pair = wide.where("source <> target").join(name("source", "a"), "source").join(name("target", "b"), "target")
        pair = pair.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
        at = cut(pair.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("m")))
        steps, left = chained(names, at, deep)
        if left.limit(1).count():
            task = cut(of(large, left.join(names, "i").select("component").distinct(), "left_semi").where("n <= 5000000"))
            large = large.join(task, "component", "left_anti")
            names = cut(of(names, task, "left_anti"))
            at = cut(at.join(names.select(F.col("i").alias("a")), "a", "left_semi"))
            steps, _ = chained(names, at)
        if steps:
            parts.append(swept(names, at, steps, sweeps))
        alone = of(both, cut(large), "left_anti")
    got = cut(reduce(DataFrame.unionByName, [*parts, alone.groupBy("component").applyInPandas(run, "id string, label string")]))
    first = numbered(got.groupBy("label").agg(F.min("id").alias("first")), "community", "first")
    return got.join(first, "label").select("id", "community")


def without_relations(node_rows: DataFrame, edge_rows: DataFrame, relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """A slice as a legend shows it with some relations switched off: their edges go, the nodes stay."""
    return node_rows, edge_rows.where(~F.col("relation").isin(relations) | F.col("relation").isNull()) if relations else edge_rows


def without_nodes(node_rows: DataFrame, edge_rows: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A slice without the nodes of hidden (id) and the edges that touch them."""
    gone = hidden.select("id").distinct()
    left = edge_rows.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return node_rows.join(gone, "id", "left_anti").select(*node_rows.columns), left.select(*edge_rows.columns)


def incident(edge_rows: DataFrame, node: str) -> DataFrame:
    """direction (in, out), relation, other of every edge that touches node."""
    out = edge_rows.where(F.col("source") == node).select(F.lit("out").alias("direction"), "relation", F.col("target").alias("other"))
    return out.unionByName(edge_rows.where(F.col("target") == node).select(F.lit("in").alias("direction"), "relation", F.col("source").alias("other")))


def folder_groups(node_rows: DataFrame) -> DataFrame:
    """id, group: a note's top folder, (root) above all folders; ghosts have none."""
    return node_rows.select("id", F.when(F.col("path").isNull(), None).when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("(root)").alias("group"))


def min_cut(ids: list[str], pairs: list[tuple[str, str]]) -> tuple[list[str], list[str], int]:
    """Halves of equal size (the first may hold one more) improved by pair swaps until no prefix of swaps gains; and the edges cut."""
    ids = sorted(ids)
    place = {v: i for i, v in enumerate(ids)}
    n = len(ids)
    w = np.zeros((n, n), int)
    for a, b in pairs:
        if a != b and a in place and b in place:
            w[place[a], place[b]] += 1
            w[place[b], place[a]] += 1
    left = np.arange(n) < -(-n // 2)
    while True:
        side = np.where(left, 1, -1)
        d = -(w * np.outer(side, side)).sum(1)
        free, swaps, total, best, upto, cur = np.ones(n, bool), [], 0, 0, 0, left.copy()
        while (cur & free).any() and (~cur & free).any():
            a, b = np.flatnonzero(cur & free), np.flatnonzero(~cur & free)
            gain = d[a][:, None] + d[b][None, :] - 2 * w[np.ix_(a, b)]
            i, j = divmod(int(gain.argmax()), len(b))
            x, y = a[i], b[j]
            total += int(gain[i, j])
            swaps.append((x, y))
            free[[x, y]] = False
            inside, outside = cur & free, ~cur & free
            d[inside] += 2 * w[inside, x] - 2 * w[inside, y]
            d[outside] += 2 * w[outside, y] - 2 * w[outside, x]
            if total > best:
                best, upto = total, len(swaps)
        if not best:
            break
        for x, y in swaps[:upto]:
            left[x], left[y] = False, True
    cut_edges = int(w[np.ix_(left, ~left)].sum())
    return [v for v, s in zip(ids, left, strict=True) if s], [v for v, s in zip(ids, left, strict=True) if not s], cut_edges


def bisected(node_ids: DataFrame, edge_rows: DataFrame, most: int = 2000) -> DataFrame:
    """id, half (0 or 1), cut: min_cut of a capped slice, as one group. Slices of more than `most` nodes raise: the search is cubic."""
    both = node_ids.select(F.col("id").alias("source"), F.lit(None).cast("string").alias("target")).unionByName(edge_rows.select("source", "target"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, e = f.source[f.target.isna()].tolist(), f[f.target.notna()]
        if len(ids) > most:
            raise ValueError(f"{len(ids)} nodes; min_cut takes slices of at most {most}")
        a, b, c = min_cut(ids, list(zip(e.source, e.target, strict=True)))
        return pd.DataFrame({"id": a + b, "half": [0] * len(a) + [1] * len(b), "cut": c})

    return both.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "id string, half int, cut long")
