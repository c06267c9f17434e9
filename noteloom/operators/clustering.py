"""k-means over any number of points: every step is a pass over all of them, and only centres and sums of clusters meet.

The rules are those of distill.kmeans, which works within one document: the first seed is the least id, every further one
the point farthest from all seeds; ties go to the least id; a point belongs to the first nearest centre; means are
rounded to 32 bits; a cluster without points restarts at the point that is farthest from its own centre; clusters are
numbered by their least member. Sums of 32-bit numbers in 64 bits don't depend on the order here, as long as they
are exact, which they are for up to about 500,000 coordinates of like size.

What the driver holds is k centres and, after a restart, k ids. A point without a vector belongs to no cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix, merged_sums
from .workspace import cut


def _squared(x: np.ndarray, c: np.ndarray, rows: int = 1000) -> np.ndarray:
    """Squared distances of every row of x to every row of c."""
    parts = [((x[i : i + rows, None] - c[None]) ** 2).sum(2) for i in range(0, len(x), rows)]
    return np.concatenate(parts) if parts else np.zeros((0, len(c)))


def _labels(ids: pa.Array, x: np.ndarray, c: np.ndarray, moved: dict) -> np.ndarray:
    label = _squared(x, c).argmin(1)
    if moved:
        for i, key in enumerate(ids.to_pylist()):
            label[i] = moved.get(key, label[i])
    return label


def _farthest(points: DataFrame, kind: str, distance) -> tuple:
    """id and vector of the point of largest distance(ids, x), the least id among several."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                d = distance(b.column(0), x)
                far = np.flatnonzero(d == d.max())
                at = min(far.tolist(), key=lambda i: b.column(0)[i].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1), pa.array([float(d[at])]), pa.array([x[at]])], ["id", "d", "x"])

    r = points.mapInArrow(best, f"id {kind}, d double, x array<double>").orderBy(F.desc("d"), "id").first()
    return r["id"], np.array(r["x"])


def kmeans(points: DataFrame, k: int, iterations: int = 20, representatives: int = 4) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance of each point to its centre; cluster, nth, id of the points nearest to each centre) of points (id, embedding).

    The first table has a row for every point, so no cluster is a row or a group of unbounded size.
    """
    spark, kind = points.sparkSession, dict(points.dtypes)["id"]
    points = cut(points.select("id", "embedding").where("embedding is not null"))
    few = [r["id"] for r in points.select("id").orderBy("id").limit(k + 1).collect()]
    if not few or k <= 0:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance double"), spark.createDataFrame([], f"cluster int, nth int, id {kind}")
    if len(few) <= k:
        alone = [(key, j, 0.0) for j, key in enumerate(few)]
        return spark.createDataFrame(alone, f"id {kind}, cluster int, distance double"), spark.createDataFrame([(j, 0, key) for key, j, _ in alone], f"cluster int, nth int, id {kind}")
    seeds = [np.array(points.where(F.col("id") == F.lit(few[0])).first()["embedding"], float)]
    while len(seeds) < k:
        c = np.array(seeds)
        seeds.append(_farthest(points, kind, lambda _, x, c=c: _squared(x, c).min(1))[1])
    c, before, moved = np.array(seeds), None, {}
    for _ in range(iterations):

        def sums(batches: Iterator[pa.RecordBatch], c=c, before=before, moved=moved) -> Iterator[pa.RecordBatch]:
            """Of each batch and cluster: the number of points, the sum of their vectors, and how many came from another cluster."""
            for b in batches:
                x = matrix(b.column(1))
                label = _labels(b.column(0), x, c, {})
                came = np.ones(len(x)) if before is None else (label != _labels(b.column(0), x, before, moved)).astype(float)
                here = np.unique(label)
                rows = [np.append(x[label == j].sum(0), came[label == j].sum()) for j in here]
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array([int((label == j).sum()) for j in here], pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["key", "n", "sums"])

        rows = merged_sums(points.mapInArrow(sums, "key long, n long, sums array<double>")).collect()  # k rows
        changed = any(r["sums"][-1] for r in rows)
        before, moved = c, {}
        c = c.copy()
        for r in rows:
            c[r["key"]] = (np.array(r["sums"][:-1]) / r["n"]).astype(np.float32)
        for j in sorted(set(range(k)) - {r["key"] for r in rows}):

            def own(ids, x, c=c.copy(), moved=dict(moved)):
                return ((x - c[_labels(ids, x, before, moved)]) ** 2).sum(1)

            key, c[j] = _farthest(points, kind, own)
            moved[key], changed = j, True
        if not changed:
            break

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            label = _labels(b.column(0), x, before, moved)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.int32()), pa.array(((x - c[label]) ** 2).sum(1), pa.float64())], ["id", "label", "distance"])

    rows = cut(points.mapInArrow(judged, f"id {kind}, label int, distance double"))
    order = [r["label"] for r in rows.groupBy("label").agg(F.min("id").alias("low")).orderBy("low").collect()]  # k rows
    number = F.element_at(F.create_map(*[F.lit(v) for j, label in enumerate(order) for v in (label, j)]), F.col("label")).cast("int").alias("cluster")
    rows = rows.select("id", number, "distance")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).sort_by([("cluster", "ascending"), ("distance", "ascending"), ("id", "ascending")])
            cluster = t.column("cluster").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(cluster)) + 1]) if len(cluster) else np.zeros(0, int)
            nth = np.arange(len(cluster)) - np.repeat(starts, np.diff(np.append(starts, len(cluster))))
            yield from t.filter(pa.array(nth < representatives)).to_batches()

    w = Window.partitionBy("cluster").orderBy("distance", "id")  # a few rows of each batch
    best = rows.mapInArrow(nearest, f"id {kind}, cluster int, distance double").withColumn("nth", (F.row_number().over(w) - 1).cast("int"))
    return rows, best.where(F.col("nth") < representatives).select("cluster", "nth", "id")
