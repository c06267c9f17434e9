"""Staged runs: each distilled document's notes are kept apart from the vault until they are merged."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, markdown


def is_safe(run_id: str) -> bool:
    return bool(run_id) and not run_id.startswith(".") and ".." not in run_id and "/" not in run_id and "\\" not in run_id


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_run(base: str, run_id: str, source_name: str, source: str, rendered: DataFrame, meta: dict) -> DataFrame:
    """Replaces the run below base: its source note, its notes (file_name, content) and its facts. Returns path, content."""
    if not is_safe(run_id):
        raise ValueError(f"not a run's name: {run_id!r}")
    spark = rendered.sparkSession
    own = spark.createDataFrame([(f"{source_name}.md", source, "source"), ("run.json", json.dumps(meta, sort_keys=True), "meta")], "path string, content string, kind string")
    rows = rendered.select(F.col("file_name").alias("path"), "content", F.lit("note").alias("kind")).unionByName(own)
    rows.write.mode("overwrite").parquet(f"{base}/run_id={run_id}")
    return notes(spark, base, run_id)


def all_runs(spark: SparkSession, base: str) -> DataFrame:
    """run_id, path, content, kind of every staged run."""
    return spark.read.schema("path string, content string, kind string, run_id string").option("basePath", base).parquet(base)


def list_runs(spark: SparkSession, base: str) -> list[str]:
    return [r[0] for r in all_runs(spark, base).select("run_id").distinct().orderBy("run_id").collect()]


def notes(spark: SparkSession, base: str, run_id: str) -> DataFrame:
    """path, content of one run, its source included; the partition filter reads no other run."""
    return all_runs(spark, base).where((F.col("run_id") == run_id) & (F.col("kind") != "meta")).select("path", "content")


def meta(spark: SparkSession, base: str, run_id: str) -> dict:
    row = all_runs(spark, base).where((F.col("run_id") == run_id) & (F.col("kind") == "meta")).first()
    return json.loads(row["content"]) if row else {}


def remove_run(spark: SparkSession, base: str, run_id: str) -> None:
    if not is_safe(run_id):
        raise ValueError(f"not a run's name: {run_id!r}")
    _delete(spark, f"{base}/run_id={run_id}")


def indexed(note_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and triples of notes (path, content)."""
    h = markdown.harvest(note_rows)
    return h.select("path", "title"), markdown.triples_of(h)


def run_graph(note_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a run by itself."""
    files, triples = indexed(note_rows)
    e = graph.edges(files, triples)
    return graph.nodes(files, e), e


def run_overlay(vault_notes: DataFrame, note_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the vault and a run together; each node says which side it comes from."""
    f, t = indexed(vault_notes)
    rf, rt = indexed(note_rows)
    return graph.overlay(f, t, rf, rt)


def reveal(cites: DataFrame, note_rows: DataFrame) -> DataFrame:
    """path, source, start, end, text: the cited spans (path, source, chunk, start, end) in the source notes (path, content)."""
    s = note_rows.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.md$", "").alias("source"), F.col("path").alias("source_path"), "content")
    s = s.groupBy("source").agg(F.min_by("content", "source_path").alias("content"))
    both = cites.join(s, "source")
    return both.select("path", "source", "start", "end", F.substring("content", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("text"))
