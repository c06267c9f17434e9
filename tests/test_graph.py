import math
import os

import pytest

from pyspark.sql import functions as F

from noteloom.operators import graph, layouts
from noteloom.operators.layouts import block_positions, force_positions, tree_positions
from noteloom.operators.workspace import numbered
from noteloom.plans.queries import QUERIES

STAR = "/root/testdata/sf0.001"

FILES = [("A.md", "A"), ("B.md", "B"), ("C.md", "C"), ("projects/Roadmap.md", "Roadmap"), ("X.map.md", "X")]
TRIPLES = [("A", "links_to", "B", "A.md"), ("A", "links_to", "Ghost", "A.md"), ("B", "links_to", "C", "B.md"), ("A", "links_to", "A", "A.md"), ("X", "links_to", "A", "X.map.md")]


@pytest.fixture
def frames(spark):
    make = lambda extra=(): (spark.createDataFrame(FILES, "path string, title string"), spark.createDataFrame([*TRIPLES, *extra], "subject string, relation string, object string, source_file string"))
    return make


def ids(df):
    return {r["id"] for r in df.collect()}


def test_edges_nodes_and_ghosts(frames):
    f, t = frames([("A", "cites", "B", "A.md"), ("A", "cites", "B", "A.md"), ("C", "links_to", "projects/Roadmap", "C.md")])
    e = graph.edges(f, t)
    assert {tuple(r) for r in e.collect()} == {("A", "B", "cites"), ("A", "Ghost", "links_to"), ("B", "C", "links_to"), ("C", "Roadmap", "links_to")}
    n = {r["id"]: r for r in graph.nodes(f, e).collect()}
    assert n["Ghost"]["ghost"] and n["Roadmap"]["path"] == "projects/Roadmap.md" and n["B"]["degree"] == 2


def test_slices(frames):
    f, t = frames()
    e = graph.edges(f, t)
    assert ids(graph.local_slice(f, e, "A", 1)[0]) == {"A", "B", "Ghost"}
    assert ids(graph.local_slice(f, e, "B", 1)[0]) == {"A", "B", "C"}
    assert "C" in ids(graph.local_slice(f, e, "A", 2)[0])
    alone = graph.local_slice(f, e, "Lonely", 1)
    assert ids(alone[0]) == {"Lonely"} and alone[1].count() == 0
    top, _ = graph.global_slice(f, e, 2)
    assert top.count() == 2 and top.first()["total"] == 4
    both = graph.expand(graph.local_slice(f, e, "A", 1), graph.local_slice(f, e, "C", 1))
    assert ids(both[0]) == {"A", "B", "C", "Ghost"}


def test_overlay(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, title string")
    t = lambda rows: spark.createDataFrame(rows, "subject string, relation string, object string, source_file string")
    n, e = graph.overlay(f([("Vault.md", "Vault"), ("Faction.md", "Faction")]), t([("Vault", "links_to", "Faction", "Vault.md")]), f([("run/Faction.md", "Faction"), ("run/Republic.md", "Republic")]), t([("Republic", "links_to", "Faction", "run/Republic.md")]))
    assert {r["id"]: r["side"] for r in n.collect()} == {"Vault": "vault", "Faction": "both", "Republic": "run"}
    assert e.where("target = 'Faction'").count() == 2


def frame(spark, pairs, nodes=None):
    names = nodes or sorted({x for p in pairs for x in p})
    return spark.createDataFrame([(x,) for x in names], "id string"), spark.createDataFrame(pairs, "source string, target string")


@pytest.mark.parametrize("small", [0, 1000])
def test_pagerank(spark, small):
    n, e = frame(spark, [("a", "H"), ("b", "H"), ("c", "H")])
    got = {r["id"]: r["rank"] for r in graph.pagerank(n, e, small=small).collect()}
    assert got["H"] == pytest.approx(0.541985, abs=1e-5) and got["a"] == pytest.approx(0.152672, abs=1e-5)
    n, e = frame(spark, [("a", "b"), ("b", "c"), ("c", "c"), ("c", "unknown")], ["a", "b", "c"])
    got = [r["rank"] for r in graph.pagerank(n, e, small=small).orderBy("id").collect()]
    assert got == pytest.approx([0.184417, 0.341171, 0.474412], abs=1e-5)


TRIANGLES = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d")]


def test_communities_and_components(spark):
    n, e = frame(spark, TRIANGLES, [*"abcdef", "lone"])
    c = {r["id"]: r["community"] for r in graph.communities(n, e).collect()}
    assert c["a"] == c["b"] == c["c"] == 0 and c["d"] == c["e"] == c["f"] == 1 and c["lone"] == 2
    k = {r["id"]: r["component"] for r in graph.components(n, e).collect()}
    assert k == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "d"), "lone": "lone"}


def test_min_cut(spark):
    a, b, c = graph.min_cut(list("abcdef"), [*TRIANGLES, ("c", "d")])
    assert {tuple(a), tuple(b)} == {tuple("abc"), tuple("def")} and c == 1
    a, b, c = graph.min_cut(list("abcd"), [("a", "c"), ("b", "d")])
    assert c == 0 and {"a", "c"} in ({*a}, {*b})
    a, b, _ = graph.min_cut(list("abcde"), [])
    assert abs(len(a) - len(b)) == 1
    n, e = frame(spark, [*TRIANGLES, ("c", "d")])
    assert graph.bisected(n, e).where("half = 0").count() == 3


def test_force():
    seed = {"a": (1.0, 2.0), "b": (3.0, 4.0)}
    assert force_positions(["a", "b"], [("a", "b")], iterations=0, seed=seed) == seed
    p = force_positions(list("abc"), [("a", "b")], fixed={"a": (10.0, 10.0)})
    assert p["a"] == (10.0, 10.0)
    assert force_positions(list("abc"), [("a", "b")]) == force_positions(list("abc"), [("a", "b")])


def test_repulsion_takes_little_memory_and_keeps_every_bit():
    import tracemalloc

    import numpy as np

    ids = [f"n{i:04d}" for i in range(1500)]
    pairs = [(ids[i], ids[i % 7]) for i in range(7, 1500)]
    tracemalloc.start()
    force_positions(ids, pairs, iterations=1)
    assert tracemalloc.get_traced_memory()[1] < 10e6  # all pairs at once: above 100 MB
    tracemalloc.stop()
    at = force_positions(ids, [], iterations=1)
    angle = 2 * np.pi * np.arange(1500) / 1500
    p = np.array([400.0, 300.0]) + np.stack([np.cos(angle), np.sin(angle)], 1) * 180.0
    delta = p[:, None] - p[None]
    dist = np.maximum(np.hypot(delta[..., 0], delta[..., 1]), 0.01)
    k = np.sqrt(800.0 * 600.0 / 1500)
    move = (delta / dist[..., None] * (k * k / dist)[..., None]).sum(1)
    size = np.maximum(np.hypot(move[:, 0], move[:, 1]), 0.01)
    want = p + (move / size[:, None] * np.minimum(size, 60.0)[:, None] + (np.array([400.0, 300.0]) - p) * 0.01)
    assert np.abs(np.array([at[i] for i in ids]) - want).max() == 0


def test_tree_and_blocks():
    p = tree_positions(list("abc"), [("a", "b"), ("b", "c")])
    assert p["a"][1] < p["b"][1] < p["c"][1]
    assert set(tree_positions(list("ab"), [("a", "b"), ("b", "a")])) == set("ab")
    q = block_positions(list("abcdef"), [*TRIANGLES, ("c", "d")])
    assert len(set(q.values())) == 6 and all(0 < x < 800 and 0 < y < 600 for x, y in q.values())
    side = lambda s: {q[i][0] < 400 for i in s}
    assert len(side("abc")) == len(side("def")) == 1


def test_radial_and_groups(spark):
    n, e = frame(spark, [("A", "B"), ("A", "C"), ("C", "D")])
    got = {r["id"]: r for r in layouts.radial_layout(n, e, "A").collect()}
    assert (got["A"]["x"], got["A"]["y"]) == (400, 300)
    far = lambda i: math.hypot(got[i]["x"] - 400, got[i]["y"] - 300)
    assert far("B") == pytest.approx(far("C")) and far("D") > far("B")
    n, e = frame(spark, TRIANGLES)
    g = {r["id"]: r for r in layouts.groups_layout(graph.communities(n, e)).collect()}
    d = lambda i, j: math.hypot(g[i]["x"] - g[j]["x"], g[i]["y"] - g[j]["y"])
    assert d("a", "d") > d("a", "b")


def test_folder_groups(spark):
    df = spark.createDataFrame([("a", "x/a.md"), ("b", "b.md"), ("g", None)], "id string, path string")
    assert {r["id"]: r["group"] for r in graph.folder_groups(df).collect()} == {"a": "x", "b": "(root)", "g": None}


@pytest.mark.skipif(not os.path.isdir(STAR), reason="the tables are not here")
def test_star_queries_against_brute_force(spark):
    """The graph queries see every customer and segment."""
    edges = {(r["source"], r["target"], r["relation"]) for r in QUERIES["graph_edges"](spark, STAR).collect()}
    ids = sorted({x for a, b, _ in edges for x in (a, b)})
    assert {"lives_in", "segment"} <= {r for _, _, r in edges}
    out = {i: [b for a, b, _ in edges if a == i] for i in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(50):
        lost = sum(rank[i] for i in ids if not out[i]) / len(ids)
        new = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * lost)
        for i in ids:
            for b in out[i]:
                new[b] += 0.85 * rank[i] / len(out[i])
        rank = new
    assert {r["id"]: r["rank"] for r in QUERIES["pagerank"](spark, STAR).collect()} == pytest.approx(rank, abs=2e-6)
    label = {i: i for i in ids}
    for _ in ids:
        for a, b, _ in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["component"] for r in QUERIES["graph_components"](spark, STAR).collect()} == label
    labels = graph.sweep(ids, [(a, b) for a, b, _ in edges])
    first = sorted({min(i for i in ids if labels[i] == x) for x in set(labels.values())})
    want = {i: first.index(min(j for j in ids if labels[j] == labels[i])) for i in ids}
    assert {r["id"]: r["community"] for r in QUERIES["communities"](spark, STAR).collect()} == want
    for name in ("groups_layout", "radial_layout"):
        assert sorted(r["id"] for r in QUERIES[name](spark, STAR).collect()) == ids


@pytest.mark.skipif(not os.path.isdir(STAR), reason="the tables are not here")
@pytest.mark.parametrize("name", ["mincut", "force_layout", "tree_layout", "blocks_layout"])
def test_one_group_queries_take_the_whole_graph(spark, name):
    assert ids(QUERIES[name](spark, STAR)) == ids(QUERIES["graph_nodes"](spark, STAR))


def test_layout_constants(spark):
    """Seeds stand on 0.3 of the shorter side, a single node in the centre; one community's circle ends at 0.38 of it."""
    one = layouts.force_positions(["a"], [])
    assert one["a"] == pytest.approx((400, 300), abs=1e-9)
    start = layouts.force_positions(list("abcd"), [], iterations=0)
    assert {k: (round(x, 6), round(y, 6)) for k, (x, y) in start.items()} == {"a": (580, 300), "b": (400, 480), "c": (220, 300), "d": (400, 120)}
    many = spark.range(400).select(F.format_string("n%03d", "id").alias("id"), F.lit(0).alias("community"))
    first = layouts.groups_layout(many).orderBy("id").first()
    assert (first["x"], first["y"]) == pytest.approx((400, 300 - 0.38 * 600))
    with pytest.raises(Exception, match="at most 2000"):
        layouts.blocks_layout(spark.range(2001).select(F.col("id").cast("string").alias("id")), spark.createDataFrame([], "source string, target string")).count()


def test_numbers_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.col("id").alias("w"))
    assert [r["v"] for r in numbered(df, "n", F.desc("v")).orderBy("n").collect()] == list(range(999, -1, -1))
    assert numbered(df.limit(0), "n", "v").count() == 0


def test_legend_hide_and_inspector(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("a", "c", "q"), ("c", "a", "r")], "source string, target string, relation string")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert graph.without_relations(n, e, ["r"])[1].count() == 1 and graph.without_relations(n, e, [])[1].count() == 3
    left, edges = graph.without_nodes(n, e, spark.createDataFrame([("b",)], "id string"))
    assert {r["id"] for r in left.collect()} == {"a", "c"} and edges.count() == 2
    assert {tuple(r) for r in graph.incident(e, "a").collect()} == {("out", "r", "b"), ("out", "q", "c"), ("in", "r", "c")}


def test_a_giant_component_raises(spark):
    e = spark.range(50).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    n = spark.range(51).select(F.col("id").cast("string").alias("id"))
    with pytest.raises(ValueError, match="at most 100"):
        graph.communities(n, e, most=100)


@pytest.mark.parametrize("small", [0, 1000])
def test_pagerank_iterates_only_nodes_that_edges_lead_to(spark, small, monkeypatch):
    """Against plain loops; and 300 leaves of three nodes in a ring leave a core of three, which is one task even for small=10."""
    pairs = [(f"leaf{i}", "xyz"[i % 3]) for i in range(300)] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "x"), ("leaf0", "y"), ("leaf1", "end")]
    n, e = frame(spark, pairs, sorted({x for p in pairs for x in p} | {"alone"}))
    names = [r["id"] for r in n.collect()]
    out = {i: [b for a, b in pairs if a == i] for i in names}
    rank = dict.fromkeys(names, 1 / len(names))
    for _ in range(50):
        new = dict.fromkeys(names, 0.15 / len(names) + 0.85 * sum(rank[i] for i in names if not out[i]) / len(names))
        for i in names:
            for b in out[i]:
                new[b] += 0.85 * rank[i] / len(out[i])
        rank = new
    assert {r["id"]: r["rank"] for r in graph.pagerank(n, e, small=small).collect()} == pytest.approx(rank, abs=1e-12)
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: cuts.append(1) or f(df))
    assert graph.pagerank(n, e, small=10).count() == len(names) and len(cuts) < 10
    assert graph.pagerank(n.limit(0), e.limit(0), small=small).count() == 0


@pytest.mark.parametrize(("small", "deep"), [(0, 100), (0, 2), (40, 100)])
def test_large_components_are_swept_by_steps(spark, small, deep):
    import random

    r = random.Random(small + deep)
    names = [f"{c}{i:02d}" for c in "abc" for i in range(40)] + ["lone"]
    pairs = [(c + f"{r.randrange(40):02d}", c + f"{min(39, int(r.expovariate(0.15))):02d}") for c in "abc" for _ in range(70)]
    pairs += [("a01", "a02")] * 3 + [("a02", "a01"), ("b05", "b05")]
    n, e = frame(spark, pairs, names)
    labels = graph.sweep(names, pairs)
    first = sorted({min(i for i in names if labels[i] == x) for x in set(labels.values())})
    want = {i: first.index(min(j for j in names if labels[j] == labels[i])) for i in names}
    assert {x["id"]: x["community"] for x in graph.communities(n, e, small=small, deep=deep).collect()} == want


def test_a_large_community_is_not_placed_by_one_task(spark):
    c = spark.range(3000).select(F.format_string("n%04d", (F.col("id") * 7) % 3000).alias("id"), (F.col("id") % 10 == 0).cast("long").alias("community"))
    got = layouts.groups_layout(c)
    assert "windowspecdefinition(community" not in got._jdf.queryExecution().toString()
    at, m = {r["id"]: (r["x"], r["y"]) for r in got.collect()}, {0: 2700, 1: 300}
    ring, rows = 0.32 * 600, sorted((r["community"], r["id"]) for r in c.collect())
    for k, g in ((0, 0), (1, 1)):
        a, radius = 2 * math.pi * g / 2 - math.pi / 2, min(0.8 * ring * math.sin(math.pi / 2), 30 * math.sqrt(m[k]))
        for i, name in enumerate(n for x, n in rows if x == k):
            b = 2 * math.pi * i / m[k] - math.pi / 2
            assert at[name] == pytest.approx((400 + ring * math.cos(a) + radius * math.cos(b), 300 + ring * math.sin(a) + radius * math.sin(b)))
