"""Registered queries over an index that has followed changes, and over real chunks: several of each document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, markdown, search, text_index, vectors
from ..sources.tables import table
from . import indexed
from .queries import NOTES, ORACLES, QUESTION, TOKENS, WORDS, bm25_sql, documents_path, note_index, notes, query, rounded, snippet_sql, vector_sql

# --- changes -------------------------------------------------------------------------------------------------------

#: Every fourth document gets more words, every seventh but three goes, every eleventh comes again as a new note.
MORE, FAR = " erst thin thinly more", 1_000_000_000
CHANGED = rf"""n AS (SELECT *, list_concat({TOKENS.format("title")}, {TOKENS.format("body")}) AS tokens FROM (
  SELECT doc_id AS key, source || ' ' || lang AS title, CASE WHEN doc_id % 4 = 1 THEN COALESCE(text, '') || '{MORE}' ELSE text END AS body FROM documents WHERE doc_id % 7 <> 3
  UNION ALL SELECT doc_id + {FAR}, 'thin ' || source, text FROM documents WHERE doc_id % 11 = 0))"""


def changed_index(spark, d):
    """The index of all documents, built once and then brought up to date by two batches."""

    def write(base):
        old, key = notes(spark, d), F.col("key")
        text_index.build(old, base)
        grown = old.where(key % 4 == 1).withColumn("body", F.concat(F.coalesce("body", F.lit("")), F.lit(MORE)))
        again = table(spark, d, "documents").where("doc_id % 11 = 0").select((F.col("doc_id") + FAR).alias("key"), F.concat(F.lit("thin "), "source").alias("title"), F.col("text").alias("body"))
        batch = grown.unionByName(again)
        text_index.update(base, batch, batch.select(key.alias("file")))
        text_index.update(base, old.limit(0), old.where(key % 7 == 3).select(key.alias("file")))

    return text_index.open_index(spark, indexed.built(spark, "changed notes", documents_path(d), write))


@query(f"WITH {CHANGED}, {bm25_sql(WORDS)} SELECT key, round(score, 6) AS score FROM scored")
def search_after_changes(spark, d):
    """Scores of all matching notes after notes were added, changed and deleted: as if the index had been built from what is there now."""
    return rounded(search.bm25(changed_index(spark, d), WORDS), "score")


@query(f"""WITH {CHANGED}, {bm25_sql(WORDS)}, hits AS (SELECT key, title, body, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, key LIMIT 50) JOIN n USING (key)), {snippet_sql(WORDS, "hits")}
SELECT key, title, score, snippet FROM hits JOIN snips USING (key)""")
def snippets_after_changes(spark, d):
    return rounded(search.search(changed_index(spark, d), WORDS), "score")


@query(f"WITH {CHANGED}, t AS (SELECT key, unnest(tokens) AS token FROM n) SELECT token, count(*) AS tokens, count(DISTINCT key) AS notes, (SELECT count(*) FROM n) AS total, (SELECT round(avg(len(tokens)), 6) FROM n) AS mean FROM t GROUP BY token")
def postings_after_changes(spark, d):
    """What the live postings hold of each token, with the running totals."""
    index = changed_index(spark, d)
    held = index.postings.groupBy("token").agg(F.sum(text_index.frequency()).alias("tokens"), F.count_distinct("key").alias("notes"))
    return held.withColumn("total", F.lit(index.total).cast("long")).withColumn("mean", F.round(F.lit(index.mean), 6))


# --- chunks --------------------------------------------------------------------------------------------------------

PER_FILE = 100_000
CHUNKS = f"""parts AS ({ORACLES["chunk_pack"]}), chunks AS (SELECT doc_id, doc_id * {PER_FILE} + row_number() OVER (PARTITION BY doc_id ORDER BY p.start) - 1 AS key,
  trim(substr(text, p.start + 1, p."end" - p.start), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM parts p JOIN documents USING (doc_id))"""
PARTS = rf"""{CHUNKS}, n AS (SELECT key, {TOKENS.format("text")} AS tokens FROM chunks)"""


def real_chunks(spark, d):
    """key, file, ord, heading, text, embedding of all chunks of the documents, made once and stored."""

    def rows():
        cut = markdown.chunks(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))
        return vectors.hashed_embedding(cut.select((F.col("file").cast("long") * PER_FILE + F.col("ord")).alias("key"), F.col("file").cast("long").alias("file"), "ord", "heading", "text", "embed_text"), "embed_text").drop("embed_text")

    return indexed.stored(spark, "real chunks", documents_path(d), rows)


def real_chunk_index(spark, d):
    texts = lambda: real_chunks(spark, d).select("key", "file", F.lit("").alias("title"), F.col("text").alias("body"))
    return indexed.text_index(spark, "real chunk texts", documents_path(d), texts)


@query(f"WITH {PARTS}, {bm25_sql(WORDS)} SELECT key, doc_id AS file, round(score, 6) AS score FROM scored JOIN chunks USING (key) ORDER BY round(score, 9) DESC, key LIMIT 30")
def chunk_search(spark, d):
    """The 30 chunks that hold a query's words best, with the note each is a part of."""
    hits = search.bm25(real_chunk_index(spark, d), WORDS).orderBy(F.desc(F.round("score", 9)), "key").limit(30)
    return rounded(real_chunks(spark, d).select("key", "file").join(F.broadcast(hits), "key"), "score")


@query(f"""WITH {PARTS}, {bm25_sql(QUESTION)}, {vector_sql("chunks", "key", "text")},
l AS (SELECT 0 AS list_id, key, row_number() OVER (ORDER BY round(distance, 6), key) - 1 AS rank FROM near QUALIFY rank < 8 UNION ALL SELECT 1, key, row_number() OVER (ORDER BY round(score, 12) DESC, key) - 1 AS rank FROM scored QUALIFY rank < 30),
best AS (SELECT key, round(sum(1 / (61 + rank)), 6) AS score FROM l GROUP BY key ORDER BY round(sum(1 / (61 + rank)), 12) DESC, min((list_id, rank)) LIMIT 8)
SELECT key, doc_id AS file, '' AS heading, text, score FROM best JOIN chunks USING (key)""")
def ask_chunks(spark, d):
    """The chunks that answer a question's words and vector best, several of them perhaps of one document."""
    chunks = real_chunks(spark, d).select("key", "file", "heading", "text", "embedding")
    return rounded(fusion.retrieve_chunks(chunks, QUESTION, vectors.embed_text(QUESTION, 384, {}), index=real_chunk_index(spark, d)), "score")


@query(f"""WITH {NOTES}, {bm25_sql(QUESTION)}, {CHUNKS}, {vector_sql("chunks", "key", "text")}, texts AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) - 1 AS rank FROM scored QUALIFY rank < 50),
nearest AS (SELECT key // {PER_FILE} AS key, key AS chunk, row_number() OVER (ORDER BY round(distance, 5), key) - 1 AS rank FROM near QUALIFY rank < 30), hits AS (SELECT key, title, body FROM texts JOIN n USING (key)), {snippet_sql(QUESTION, "hits")},
fused AS (SELECT key, sum(1 / (61 + rank)) AS s, bool_or(semantic) AS semantic, min((semantic::INT, rank)) AS first, count(*) FILTER (semantic) AS n_chunks FROM (SELECT key, rank, false AS semantic FROM texts UNION ALL SELECT key, rank, true FROM nearest) GROUP BY key ORDER BY round(s, 12) DESC, first LIMIT 50),
closest AS (SELECT key, arg_min(chunk, rank) AS chunk FROM nearest GROUP BY key)
SELECT f.key, n.title, round(s, 6) AS score, semantic, COALESCE(snippet, left(trim(regexp_replace(c.text, '\\s+', ' ', 'g')), 180)) AS snippet
FROM fused f JOIN n USING (key) LEFT JOIN snips USING (key) LEFT JOIN closest USING (key) LEFT JOIN chunks c ON c.key = closest.chunk""")
def hybrid_chunks(spark, d):
    """Text hits of notes and vector hits of their chunks, fused per note: near chunks of one note add up."""
    return rounded(fusion.hybrid_notes(note_index(spark, d), real_chunks(spark, d).drop("key"), QUESTION, vectors.embed_text(QUESTION, 384, {})), "score")
