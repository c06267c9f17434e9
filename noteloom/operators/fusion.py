"""Reciprocal-rank fusion and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, collapsed
from . import search, vectors
from .workspace import few


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """key, score of lists (list_id, rank from 0, key): the sum of 1 / (k + rank + 1); ties by first appearance.

    A key that a list holds twice counts twice.
    """
    s = lists.groupBy("key").agg(F.sum(1 / (F.lit(k) + F.col("rank") + 1)).alias("score"), F.min(F.struct("list_id", "rank")).alias("first"))
    return s.orderBy(F.desc("score"), "first").select("key", "score")


def ranked(hits: DataFrame, list_id: int, *order) -> DataFrame:
    """A list for rrf() from a bounded number of hits."""
    return hits.select(F.lit(list_id).alias("list_id"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"), "key")


def hybrid_notes(notes: DataFrame | search.TextIndex, chunks: DataFrame, query: str, vector, text_limit: int = 50, vector_limit: int = 30, limit: int = 50) -> DataFrame:
    """key, title, score, semantic, snippet: text and chunk hits fused per note, best first.

    chunks: file, text, embedding. Without chunk hits the text hits come back as they are. Several near chunks of one
    note add up.
    """
    texts = few(search.search(notes, query, text_limit))
    near = vectors.nearest_l2(chunks.withColumn("key", F.struct("file", "ord")), vector, vector_limit).withColumn("chunk", F.col("key")).withColumn("key", F.col("chunk.file"))
    near = few(near)
    if not near.limit(1).count():
        return texts.select("key", "title", "score", F.lit(False).alias("semantic"), "snippet")
    rows = notes.notes if isinstance(notes, search.TextIndex) else notes
    fused = rrf(ranked(texts, 0, F.desc("score"), "key").unionByName(ranked(near, 1, "distance", "chunk"))).limit(limit)
    first = near.groupBy("key").agg(F.min_by("chunk", F.struct("distance", "chunk")).alias("chunk"))
    body = chunks.join(F.broadcast(first), F.struct("file", "ord") == F.col("chunk")).select("key", F.left(collapsed(F.col("text")), F.lit(180)).alias("near_text"))
    titles = rows.select("key", F.col("title").alias("note_title")).join(F.broadcast(fused.select("key")), "key")
    out = fused.join(texts.select("key", "title", "snippet"), "key", "left").join(body, "key", "left").join(titles, "key", "left")
    title = F.coalesce("title", "note_title", basename(F.col("key").cast("string")))
    return out.select("key", title.alias("title"), "score", F.col("near_text").isNotNull().alias("semantic"), F.coalesce("snippet", "near_text").alias("snippet")).orderBy(F.desc("score"), "key")


def retrieve_chunks(chunks: DataFrame, query: str, vector, k: int = 8, limit: int = 30, index: search.TextIndex | None = None) -> DataFrame:
    """key, file, heading, text, score of the k best chunks (key, file, heading, text, embedding): vector hits and text hits fused.

    index: the chunks' texts, if they are indexed (by key, without a title); else they are tokenized.
    """
    as_notes = index or chunks.select("key", F.lit("").alias("title"), F.col("text").alias("body"))
    near = ranked(vectors.nearest_l2(chunks, vector, k), 0, "distance", "key")
    texts = ranked(search.bm25(as_notes, query).orderBy(F.desc("score"), "key").limit(limit), 1, F.desc("score"), "key")
    best = rrf(near.unionByName(texts)).limit(k)
    return chunks.select("key", "file", "heading", "text").join(F.broadcast(best), "key").orderBy(F.desc("score"), "key")


def cited_notes(hits: DataFrame) -> DataFrame:
    """Distinct files of ranked hits (file, score, key), first seen first."""
    w = Window.orderBy(F.desc("score"), "key")
    return hits.select("file", F.row_number().over(w).alias("nth")).groupBy("file").agg(F.min("nth").alias("nth")).orderBy("nth").select("file")
