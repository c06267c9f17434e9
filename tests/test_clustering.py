import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.operators import clustering, distill, vectors


def both(spark, ids, x, k, parts=3, **kw):
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id long, embedding array<float>").repartition(parts)
    rows, nearest = clustering.kmeans(df, k, **kw)
    members, reps = {}, {}
    for r in rows.orderBy("id").collect():
        members.setdefault(r["cluster"], []).append(r["id"])
    for r in nearest.orderBy("cluster", "nth").collect():
        reps.setdefault(r["cluster"], []).append(r["id"])
    got = [(members[j], reps[j]) for j in sorted(members)]
    assert sorted(members) == list(range(len(members)))
    assert got == distill.kmeans(list(ids), np.array(x, np.float32).reshape(len(ids), -1), k, **kw)
    return got


@pytest.mark.parametrize(("seed", "n", "k"), [(1, 60, 4), (2, 200, 8)])
def test_as_within_one_document(spark, seed, n, k):
    rng = np.random.default_rng(seed)
    ids = random.Random(seed).sample(range(10 * n), n)
    assert len(both(spark, ids, rng.normal(size=(n, 5)), k)) == k


def test_ties_equal_points_and_restarts(spark):
    both(spark, range(8), [[0, 0], [0, 0], [1, 0], [1, 0], [0, 1], [0, 1], [1, 1], [1, 1]], 4)  # every distance is a tie
    both(spark, range(6), np.ones((6, 2)), 3)  # equal points: clusters that lose all points restart
    rng = np.random.default_rng(0)
    both(spark, range(40), rng.integers(0, 3, (40, 2)), 7)
    both(spark, range(30), rng.normal(size=(30, 2)), 4, iterations=1, representatives=2)


def test_few_points_and_none(spark):
    assert both(spark, [5, 3], [[1.0], [2.0]], 4) == [([3], [3]), ([5], [5])]
    empty = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    assert [t.count() for t in clustering.kmeans(empty, 3)] == [0, 0]


def test_sums_of_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(f"k{min(i % 7, 2)}", [float(v) for v in rng.normal(size=3).astype(np.float32)]) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, embedding array<float>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")  # keys go over batches
    try:
        got = {r["key"]: (r["n"], r["sums"]) for r in vectors.summed(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {"k0", "k1", "k2"}
    for k in got:
        x = np.array([v for key, v in rows if key == k])
        assert got[k][0] == len(x) and np.allclose(got[k][1], x.sum(0))
    assert vectors.summed(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="vectors of one length"):
        vectors.summed(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "key string, embedding array<float>").coalesce(1)).count()
    zero = vectors.centroids(spark.createDataFrame([("z", [0.0, 0.0]), (None, [1.0, 1.0]), ("n", None)], "file string, embedding array<float>")).select("file", F.array_max("embedding")).collect()
    assert [tuple(r) for r in zero] == [("z", 0.0)]


def brute_edges(rows, k, least):
    x = np.array([v for _, v in rows], float)
    s = np.round(x @ x.T, 12)
    out = set()
    for i, (name, _) in enumerate(rows):
        ranked = sorted((-s[i, j], rows[j][0]) for j in range(len(rows)) if rows[j][0] != name and s[i, j] >= least)
        out |= {(name, t) for _, t in ranked[:k]}
    return out


@pytest.mark.parametrize(("least", "odd"), [(0.0, False), (0.7, True)])
def test_pruned_neighbours_are_all_neighbours(spark, least, odd):
    rng = np.random.default_rng(9)
    centres = np.eye(6)
    x = np.concatenate([c + rng.normal(size=(40, 6)) * 0.05 for c in centres])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    x = x.astype(np.float32).astype(float)
    if odd:  # zero vectors, longer ones, and copies
        x[3], x[50], x[60:70] = 0, x[50] * 3, x[60]
    x = np.concatenate([x, -x[:5]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "file long, embedding array<double>").repartition(3)
    edges, skipped = vectors.pruned_edges(df, 3, least, block_rows=20)
    assert {(r["source"], r["target"]) for r in edges.collect()} == brute_edges(rows, 3, least)
    assert skipped > 0.3
    whole, none = vectors.pruned_edges(df, 3, least)
    assert {(r["source"], r["target"]) for r in whole.collect()} == brute_edges(rows, 3, least) and none == 0


def test_blocks_go_round_in_several_broadcasts(spark, monkeypatch):
    """Ties across rounds are broken by name, and copies of one vector stand in several blocks."""
    monkeypatch.setattr(vectors, "ROUND_BYTES", 40 * 8 * 8)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 8))
    x[100:] = x[:50]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    rows = [(f"v{i:03}", [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "file string, embedding array<double>")
    edges, _ = vectors.pruned_edges(df, 3, -1.0, block_rows=10)
    assert {(r["source"], r["target"]) for r in edges.collect()} == brute_edges(rows, 3, -1.0)


def test_nothing_to_prune(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 30)).astype(np.float32)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    rows = [(f"v{i:02}", [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "file string, embedding array<float>")
    edges, _ = vectors.pruned_edges(df, 4, -1.0, block_rows=10)
    assert {(r["source"], r["target"]) for r in edges.collect()} == brute_edges(rows, 4, -1.0)
    assert vectors.pruned_edges(df.limit(0))[0].count() == 0


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.005, 0.995] * 500, [-5.5, -0.0, 0.0, 7.0, 1e300, -1e-300, float("inf")], list(range(2000)), [0.0] * 10, [float("nan"), 2.0]])
def test_radix_selection(spark, values):
    from noteloom.operators import telemetry

    rng = random.Random(1)
    values = [float(v) * (1 + rng.random() * 0.001) if len(values) == 1500 else float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "ms double").repartition(4)
    ranked = sorted(values, key=lambda v: (v != v, v))
    for nth in {0, len(values) // 2, min(len(values) - 1, len(values) * 99 // 100)}:
        for bits in (16, 8):
            got = telemetry.nth_value(df, nth, bits)
            assert got == ranked[nth] or got != got and ranked[nth] != ranked[nth]
    assert telemetry.nth_value(df, len(values)) is None
    keys = [r[0] for r in df.select("ms", telemetry.ordered_bits(F.col("ms")).alias("k")).orderBy("k").select("ms").collect()]
    assert [v for v in keys if v == v] == [v for v in ranked if v == v]
