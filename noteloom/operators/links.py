"""Questions about triples(subject, relation, object, source_file) and files(path, title)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename


def backlinks(triples: DataFrame, target: str) -> DataFrame:
    """Distinct (source_file, relation) that point at target."""
    return triples.where(F.col("object") == target).select("source_file", "relation").distinct().orderBy("relation", "source_file")


def outbound(triples: DataFrame, file: str) -> DataFrame:
    """Distinct (relation, object) of a file."""
    return triples.where(F.col("source_file") == file).select("relation", "object").distinct().orderBy("relation", "object")


def connections(triples: DataFrame, name: str, rel: str) -> DataFrame:
    """Backlinks by a note's name or path without extension, without its own, grouped by relation: relation, files."""
    hits = triples.where(F.col("object").isin(name, rel) & (F.col("source_file") != rel + ".md")).select("source_file", "relation").distinct()
    return hits.groupBy("relation").agg(F.array_sort(F.collect_set("source_file")).alias("files"))


def resolvable(triples: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct objects and whether a note has that name or that path without extension."""
    names = files.select(basename(F.col("path")).alias("object")).union(files.select(F.regexp_replace("path", r"(?i)\.md$", ""))).distinct()
    objects = triples.select("object").distinct()
    return objects.join(names.withColumn("found", F.lit(True)), "object", "left").select("object", F.coalesce("found", F.lit(False)).alias("resolvable"))


def note_names(files: DataFrame) -> DataFrame:
    """Distinct note names in language-aware order."""
    return files.select(basename(F.col("path")).alias("name")).distinct().orderBy(F.collate("name", "UNICODE"), "name")


def stats(files: DataFrame, triples: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files")).crossJoin(triples.agg(F.count(F.lit(1)).alias("triples")))  # one row each


def match_triples(triples: DataFrame, subject: str | None = None, relation: str | None = None, object: str | None = None) -> DataFrame:
    """Triples that match the given parts."""
    for name, value in (("subject", subject), ("relation", relation), ("object", object)):
        if value is not None:
            triples = triples.where(F.col(name) == value)
    return triples


def complete_name(files: DataFrame, typed: str) -> DataFrame:
    """Note names that contain what was typed after the last open [[ (any case)."""
    start = typed.rfind("[[")
    part = typed[start + 2 :] if start >= 0 and "]]" not in typed[start:] else None
    names = note_names(files)
    return names.limit(0) if part is None else names.where(F.lower("name").contains(part.lower()))
