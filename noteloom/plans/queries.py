"""Registered queries over the plain tables, each with the SQL that must give the same rows.

The SQL is written on its own for DuckDB. Numbers that both sides compute in floating point are rounded to 6 places.
Operators that SQL can't express have no SQL here and are tested against golden cases.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clustering, distill, fusion, graph, layouts, links, markdown, search, store, telemetry, text_index, vectors
from ..operators.workspace import dealt
from . import indexed
from ..sources import convert
from ..sources.tables import STAR_SQL, star_files, star_triples, table

QUERIES, ORACLES = {}, {}
WORDS = "thin erst"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def notes(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat_ws(" ", "source", "lang").alias("title"), F.col("text").alias("body"))


def documents_path(d):
    return f"{d.rstrip('/')}/documents.parquet"


def note_index(spark, d, again=False):
    return indexed.text_index(spark, "notes", documents_path(d), lambda: notes(spark, d), again)


TOKENS = r"regexp_extract_all(strip_accents(lower(COALESCE({0}, ''))), '[\p{{L}}\p{{N}}]+')"
NOTES = rf"""n AS (
  SELECT doc_id AS key, source || ' ' || lang AS title, text AS body, list_concat({TOKENS.format("source || ' ' || lang")}, {TOKENS.format("text")}) AS tokens FROM documents
)"""


def bm25_sql(words: str, source: str = "n") -> str:
    """Scores of the rows of a table with key and tokens."""
    qs = words.split()
    f = ", ".join(f"len(list_filter(tokens, lambda x: starts_with(x, '{q}'))) AS f{i}" for i, q in enumerate(qs))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(qs)))
    part = lambda i: f"GREATEST(ln((total - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / mean))"
    return f"""counted AS (SELECT key, len(tokens) AS len, {f} FROM {source}), totals AS (SELECT count(*) AS total, avg(len) AS mean, {n} FROM counted),
    scored AS (SELECT key, {" + ".join(map(part, range(len(qs))))} AS score FROM counted, totals WHERE {" AND ".join(f"f{i} > 0" for i in range(len(qs)))})"""


# --- text ----------------------------------------------------------------------------------------------------------


@query(f"WITH {NOTES}, t AS (SELECT key, unnest(tokens) AS token FROM n) SELECT token, count(*) AS tokens, count(DISTINCT key) AS notes FROM t GROUP BY token")
def index_build(spark, d):
    """The text index built anew; what its postings hold of each token."""
    p = note_index(spark, d, again=True).postings
    return p.groupBy("token").agg(F.sum(text_index.frequency()).alias("tokens"), F.count_distinct("key").alias("notes"))


@query(f"WITH {NOTES}, {bm25_sql(WORDS)} SELECT key, title, round(score, 6) AS score FROM scored JOIN n USING (key) ORDER BY score DESC, key LIMIT 50")
def bm25_search(spark, d):
    return search.search(note_index(spark, d), WORDS, snippet=False, places=6)  # its SQL orders by the rounded score


@query(f"WITH {NOTES}, {bm25_sql(WORDS)} SELECT key, round(score, 6) AS score FROM scored")
def bm25_scan(spark, d):
    """Scores of all matching notes without an index: one pass over the texts."""
    return rounded(search.bm25(notes(spark, d), WORDS), "score")


def snippet_sql(words: str, hits: str, size: int = 10) -> str:
    """snips(key, snippet) of hits (key, body): the earliest window of `size` tokens with the most distinct terms, then tokens, those marked."""
    term = " ".join(f"WHEN starts_with(strip_accents(lower(x)), '{q}') THEN {i}" for i, q in enumerate(dict.fromkeys(words.split())))
    return rf"""cutup AS (SELECT key, body, regexp_extract_all(body, '[\p{{L}}\p{{N}}]+') AS toks, regexp_split_to_array(body, '[\p{{L}}\p{{N}}]+') AS seps FROM {hits}),
    marked AS (SELECT *, len(toks) AS m, list_transform(toks, lambda x: CASE {term} END) AS terms FROM cutup),
    windows AS (SELECT key, s, list_filter(terms[s + 1:s + {size}], lambda t: t IS NOT NULL) AS got FROM (SELECT key, terms, unnest(range(0, greatest(1, m - {size} + 1))) AS s FROM marked WHERE m > 0)),
    best AS (SELECT key, arg_min(s, (-len(list_distinct(got)), -len(got), s)) AS s FROM windows GROUP BY key),
    snips AS (SELECT key, CASE WHEN s IS NULL THEN body ELSE (CASE WHEN s > 0 THEN '…' ELSE seps[1] END) || array_to_string(list_transform(range(s + 1, least(m, s + {size}) + 1),
      lambda j: (CASE WHEN j > s + 1 THEN seps[j] ELSE '' END) || CASE WHEN terms[j] IS NULL THEN toks[j] ELSE '<mark>' || toks[j] || '</mark>' END), '') || (CASE WHEN s + {size} < m THEN '…' ELSE seps[m + 1] END) END AS snippet
      FROM marked LEFT JOIN best USING (key))"""


@query(f"""WITH {NOTES}, {bm25_sql(WORDS)}, hits AS (SELECT key, title, body, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, key LIMIT 50) JOIN n USING (key)), {snippet_sql(WORDS, "hits")}
SELECT key, title, score, snippet FROM hits JOIN snips USING (key)""")
def search_with_snippets(spark, d):
    return rounded(search.search(note_index(spark, d), WORDS), "score")


@query(f"WITH {NOTES}, {bm25_sql('the ea')} SELECT key FROM scored")
def prefix_and_match(spark, d):
    return search.matching(note_index(spark, d), "the ea")


@query(rf"""WITH t AS (SELECT unnest({TOKENS.format("text")}) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY token""")
def token_postings(spark, d):
    p = search.postings(notes(spark, d)).where("field = 'body'")
    return p.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NOTES} SELECT key, len(tokens)::BIGINT AS n FROM n")
def doc_lengths(spark, d):
    return search.lengths(notes(spark, d))


# --- triples -------------------------------------------------------------------------------------------------------


@query(f"WITH {STAR_SQL} SELECT DISTINCT source_file, relation FROM triples WHERE object = 'BUILDING' OR object = (SELECT min(n_name) FROM nation)")
def backlinks(spark, d):
    t = star_triples(spark, d)
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return links.backlinks(t, "BUILDING").unionByName(links.backlinks(t, first)).distinct()


@query(f"WITH {STAR_SQL} SELECT DISTINCT relation, object FROM triples WHERE source_file = (SELECT 'nations/' || min(n_name) || '.md' FROM nation)")
def outbound(spark, d):
    return links.outbound(star_triples(spark, d), "nations/" + table(spark, d, "nation").agg(F.min("n_name")).first()[0] + ".md")


@query(f"""WITH {STAR_SQL}, x AS (SELECT min(n_name) AS name FROM nation) SELECT relation, list_sort(list(DISTINCT source_file)) AS files FROM triples, x
WHERE object IN (name, 'nations/' || name) AND source_file <> 'nations/' || name || '.md' GROUP BY relation""")
def connections(spark, d):
    name = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return links.connections(star_triples(spark, d), name, "nations/" + name)


@query(f"""WITH {STAR_SQL}, names AS (SELECT title AS object FROM files UNION SELECT regexp_replace(path, '\\.md$', '') FROM files)
SELECT object, object IN (SELECT object FROM names) AS resolvable FROM (SELECT DISTINCT object FROM triples)""")
def link_resolvability(spark, d):
    return links.resolvable(star_triples(spark, d), star_files(spark, d))


@query(f"WITH {STAR_SQL} SELECT DISTINCT title AS name FROM files")
def note_names(spark, d):
    return links.note_names(star_files(spark, d))


@query(f"WITH {STAR_SQL} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM triples) AS triples")
def index_stats(spark, d):
    return links.stats(star_files(spark, d), star_triples(spark, d))


@query(f"WITH {STAR_SQL} SELECT * FROM triples WHERE relation = 'segment' AND object = 'MACHINERY'")
def match_triples(spark, d):
    return links.match_triples(star_triples(spark, d), relation="segment", object="MACHINERY")


@query(f"WITH {STAR_SQL} SELECT DISTINCT title AS name FROM files WHERE contains(lower(title), 'ia')")
def complete_names(spark, d):
    return links.complete_name(star_files(spark, d), "see [[IA")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def links_from_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def field_notes(spark, d):
    """Notes with typed fields, made from parts."""
    p = dealt(table(spark, d, "part"))
    content = F.concat(F.lit("# "), F.col("p_name"), F.lit("\n\nbrand:: "), F.col("p_brand"), F.lit("\ntype:: [["), F.col("p_type"), F.lit("|kind]]\n- size:: no\n```\nin:: code\n```\nsee [["), F.col("p_brand"), F.lit("#top]]\n"))
    return p.select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS subject, * FROM part) SELECT subject, 'links_to' AS relation, p_type AS object, p_name AS title FROM p
UNION ALL SELECT subject, 'links_to', split_part(p_brand, '#', 1), p_name FROM p UNION ALL SELECT subject, 'brand', p_brand, p_name FROM p UNION ALL SELECT subject, 'type', p_type, p_name FROM p""")
def typed_fields(spark, d):
    h = markdown.harvest(field_notes(spark, d))
    return h.select(F.explode("triples").alias("t"), "title").select("t.subject", "t.relation", "t.object", "title")


# --- chunks and hashes ---------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE l AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line, len(lines) AS n, text FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)
), o AS (
  SELECT *, COALESCE(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM l
), s AS (
  SELECT doc_id, i, n, text, place AS start, length(line) + 1 AS len, trim(line, ' ' || chr(10) || chr(9) || chr(13)) <> '' AS filled, -1::BIGINT AS cut_start, -1::BIGINT AS cut_end FROM o WHERE i = 1
  UNION ALL
  SELECT s.doc_id, o.i, o.n, o.text, CASE WHEN s.filled AND s.len + length(o.line) + 1 > 1600 THEN o.place ELSE s.start END,
    CASE WHEN s.filled AND s.len + length(o.line) + 1 > 1600 THEN 0 ELSE s.len END + length(o.line) + 1,
    (s.filled AND NOT s.len + length(o.line) + 1 > 1600) OR trim(o.line, ' ' || chr(10) || chr(9) || chr(13)) <> '',
    CASE WHEN s.filled AND s.len + length(o.line) + 1 > 1600 THEN s.start ELSE -1 END, CASE WHEN s.filled AND s.len + length(o.line) + 1 > 1600 THEN o.place ELSE -1 END
  FROM s JOIN o ON o.doc_id = s.doc_id AND o.i = s.i + 1
)
SELECT doc_id, cut_start AS start, cut_end AS "end" FROM s WHERE cut_start >= 0 UNION ALL SELECT doc_id, start, length(text) FROM s WHERE i = n AND filled""")
def chunk_pack(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return markdown.chunks(docs).select(F.col("file").cast("long").alias("doc_id"), "start", "end")


@query("""WITH a AS (SELECT doc_id, sha1(text) AS h FROM documents WHERE source <> 'src1'), b AS (SELECT doc_id, sha1(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE source <> 'src2')
SELECT COALESCE(a.doc_id, b.doc_id)::VARCHAR AS file, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def content_hash_gate(spark, d):
    """What changed between two snapshots of a vault, of which each lacks a source and one has edits."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    old = store.hashes(docs.where("source <> 'src1'"))
    new = store.hashes(docs.where("source <> 'src2'").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))))
    return store.changed_files(old, new)


@query("""WITH r AS (SELECT 'Distilled/run1/' || doc_id || '.md' AS path, text AS content FROM documents WHERE source = 'src1'), v AS (SELECT 'notes/' || doc_id || '.md' AS path, text AS content FROM documents WHERE source <> 'src1')
SELECT 'merged' AS state, count(*) AS files, count(*) FILTER (path LIKE 'Distilled/%') AS distilled FROM (SELECT * FROM v UNION ALL SELECT * FROM r)
UNION ALL SELECT 'undone', count(*), 0 FROM v""")
def merge_undo(spark, d):
    docs = table(spark, d, "documents")
    vault = docs.where("source <> 'src1'").select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    run = docs.where("source = 'src1'").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.col("text").alias("content"))
    merged, manifest = store.merge_run(vault, run, "run1")
    undone = store.undo_merge(merged, manifest, "run1")
    count = lambda df, state: df.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("path").startswith("Distilled/")).alias("distilled")).select(F.lit(state).alias("state"), "files", "distilled")
    return count(merged, "merged").unionByName(count(undone, "undone"))


# --- vectors and fusion --------------------------------------------------------------------------------------------

HASH = """hashed AS (SELECT word, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 384 AS dim FROM (
  SELECT word, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(word, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM (SELECT DISTINCT word FROM words)))"""


@query(rf"""WITH words AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark), {HASH},
c AS (SELECT item_id, dim, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL)
SELECT item_id, dim::INTEGER AS dim, round((n / sqrt(sum(n * n) OVER (PARTITION BY item_id)))::FLOAT::DOUBLE, 5) AS x FROM c""")
def hashed_embedding(spark, d):
    e = vectors.hashed_embedding(table(spark, d, "benchmark").select("item_id", "text"))
    return e.select("item_id", F.posexplode("embedding").alias("dim", "x")).where("x <> 0").select("item_id", "dim", F.round(F.col("x").cast("double"), 5).alias("x"))


def embeddings(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")


def first_vector(spark, d):
    return embeddings(spark, d).where("key = (SELECT 0)").select("embedding").first()[0]


@query("""SELECT vec_id AS key, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance
FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), key LIMIT 30""")
def knn_l2(spark, d):
    return rounded(vectors.nearest_l2(embeddings(spark, d), first_vector(spark, d)), "distance")


@query("""WITH s AS (SELECT vec_id AS key, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings)
SELECT key, round(score, 6) AS score FROM s WHERE score >= 0.1 ORDER BY s.score DESC, key LIMIT 5""")
def cosine_topk(spark, d):
    return rounded(vectors.top_cosine(embeddings(spark, d), first_vector(spark, d), 5, 0.1), "score")


CENTROIDS = """x AS (SELECT vec_id % 50 AS file, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT file, pos, avg(x::DOUBLE) AS x FROM x GROUP BY ALL),
c AS (SELECT file, pos, x / sqrt(sum(x * x) OVER (PARTITION BY file)) AS x FROM m)"""


def note_vectors(spark, d):
    return table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("file"), "embedding")


@query(f"WITH {CENTROIDS} SELECT file, (pos - 1)::INTEGER AS pos, round(x, 6) AS x FROM c")
def centroids(spark, d):
    return rounded(vectors.centroids(note_vectors(spark, d)).select("file", F.posexplode("embedding").alias("pos", "x")), "x")


@query(f"WITH {CENTROIDS}, s AS (SELECT b.file, sum(a.x * b.x) AS score FROM c a JOIN c b USING (pos) WHERE a.file = 7 AND b.file <> 7 GROUP BY b.file) SELECT file, round(score, 6) AS score FROM s WHERE score >= 0 ORDER BY s.score DESC, file LIMIT 5")
def neighbors(spark, d):
    return rounded(vectors.neighbors(note_vectors(spark, d), 7), "score")


@query(f"""WITH {CENTROIDS}, s AS (SELECT a.file AS source, b.file AS target, sum(a.x * b.x) AS score FROM c a JOIN c b USING (pos) WHERE a.file <> b.file GROUP BY ALL)
SELECT source, target, round(score, 6) AS score FROM s WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(s.score, 12) DESC, target) <= 4""")
def semantic_edges(spark, d):
    return rounded(vectors.semantic_edges(vectors.centroids(note_vectors(spark, d)), blocks=3), "score")


@query("""WITH s AS (SELECT a.vec_id AS source, b.vec_id AS target, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT source, target, round(score, 6) AS score FROM s WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(s.score, 12) DESC, target) <= 4""")
def vector_edges(spark, d):
    """The nearest others of every vector of the table, by blocks of 100 with pivots."""
    e, _ = vectors.pruned_edges(embeddings(spark, d).select("key", "embedding"), least=0.2, key="key", block_rows=100)
    return rounded(e, "score")


@query(f"""WITH {CENTROIDS}, s AS (SELECT a.file AS source, b.file AS target, sum(a.x * b.x) AS score FROM c a JOIN c b USING (pos) WHERE a.file <> b.file GROUP BY ALL),
e AS (SELECT * FROM s WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(s.score, 12) DESC, target) <= 4)
SELECT source, target, round(score, 6) AS score FROM e WHERE abs(source - target) <> 1""")
def related_unlinked(spark, d):
    """Similar notes that no link joins; links join neighbouring numbers here."""
    e = vectors.semantic_edges(vectors.centroids(note_vectors(spark, d)))
    linked = spark.range(49).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    return rounded(vectors.related_unlinked(e, linked), "score")


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank, c_custkey AS key FROM customer
UNION ALL SELECT row_number() OVER (ORDER BY orders DESC, key) - 1, key FROM (SELECT o_custkey AS key, count(*) AS orders FROM orders GROUP BY 1) QUALIFY row_number() OVER (ORDER BY orders DESC, key) <= 30)
SELECT key, round(sum(1 / (61 + rank)), 6) AS score FROM l WHERE rank < 50 GROUP BY key""")
def rrf_fuse(spark, d):
    """Two ranked lists of customers fused: the 50 of highest balance and the 30 with most orders, out of all."""
    top = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal").orderBy(F.desc("c_acctbal"), "key").limit(50)
    busy = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("orders")).orderBy(F.desc("orders"), "key").limit(30)
    lists = fusion.ranked(top, 0, F.desc("c_acctbal"), "key").unionByName(fusion.ranked(busy, 1, F.desc("orders"), "key"))
    return rounded(fusion.rrf(lists), "score")


QUESTION = "the thin erst of anon"


def vector_sql(rows: str, key: str, text: str) -> str:
    """The k nearest of the hashed vectors of rows to that of the question, by 2 - 2 * cosine."""
    return rf"""words AS (SELECT {key} AS key, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS word FROM {rows} UNION ALL SELECT -1, unnest(string_split('{QUESTION}', ' '))), {HASH},
    counts AS (SELECT key, dim, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL), unit AS (SELECT key, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS x FROM counts),
    near AS (SELECT k.key, 2 - 2 * COALESCE(sum(a.x * b.x), 0) AS distance FROM (SELECT DISTINCT key FROM unit WHERE key >= 0) k LEFT JOIN unit a ON a.key = k.key LEFT JOIN unit b ON b.key = -1 AND a.dim = b.dim GROUP BY k.key)"""


def document_chunks(spark, d, again=False):
    """Every document as one chunk, with its vector: file, ord, text, embedding; embedded once and stored."""
    docs = lambda: table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.lit(0).alias("ord"), "text")
    return indexed.stored(spark, "vectors", documents_path(d), lambda: vectors.hashed_embedding(docs()), again)


@query(r"SELECT doc_id AS file, len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0 AS filled FROM documents")
def vectors_build(spark, d):
    """The documents' vectors made anew: unit vectors, zero where a text has no word."""
    v = document_chunks(spark, d, again=True)
    return v.select("file", F.round(tx.dot(F.col("embedding"), F.col("embedding")), 3).alias("x")).select("file", F.when(F.col("x").isin(0.0, 1.0), F.col("x") == 1.0).alias("filled"))


HYBRID = f"""{NOTES}, {bm25_sql(QUESTION)}, {vector_sql("documents", "doc_id", "text")},
texts AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) - 1 AS rank FROM scored QUALIFY rank < 50), nearest AS (SELECT key, row_number() OVER (ORDER BY round(distance, 5), key) - 1 AS rank FROM near QUALIFY rank < 30)"""


def _question_hits(spark, d, vector_limit: int):
    chunks = document_chunks(spark, d).withColumnRenamed("file", "key")
    q = vectors.embed_text(QUESTION, 384, {})
    # ranks by distances of 5 places, so that both engines break near ties alike
    near = vectors.nearest_l2(chunks, q, vector_limit * 4).select("key", F.round(F.col("distance") * F.col("distance"), 5).alias("distance")).orderBy("distance", "key").limit(vector_limit)
    return chunks, near


@query(f"""WITH {HYBRID} SELECT key, round(sum(1 / (61 + rank)), 6) AS score, bool_or(semantic) AS semantic FROM (SELECT key, rank, false AS semantic FROM texts UNION ALL SELECT key, rank, true FROM nearest) GROUP BY key
ORDER BY sum(1 / (61 + rank)) DESC, min((NOT semantic)::INT * -1), key LIMIT 200""")
def hybrid_fusion(spark, d):
    """Text and vector hits of a question fused; all fused rows."""
    _, near = _question_hits(spark, d, 30)
    texts = search.bm25(note_index(spark, d), QUESTION).orderBy(F.desc("score"), "key").limit(50)
    fused = fusion.rrf(fusion.ranked(texts, 0, F.desc("score"), "key").unionByName(fusion.ranked(near, 1, "distance", "key")))
    return rounded(fused.join(near.select("key", F.lit(True).alias("semantic")), "key", "left").select("key", "score", F.coalesce("semantic", F.lit(False)).alias("semantic")), "score")


@query(f"""WITH {HYBRID}, hits AS (SELECT key, title, body FROM texts JOIN n USING (key)), {snippet_sql(QUESTION, "hits")},
fused AS (SELECT key, sum(1 / (61 + rank)) AS s, bool_or(semantic) AS semantic, min((semantic::INT, rank)) AS first FROM (SELECT key, rank, false AS semantic FROM texts UNION ALL SELECT key, rank, true FROM nearest) GROUP BY key ORDER BY round(s, 12) DESC, first LIMIT 50)
SELECT key, title, round(s, 6) AS score, semantic, COALESCE(snippet, left(trim(regexp_replace(body, '\\s+', ' ', 'g')), 180)) AS snippet FROM fused JOIN n USING (key) LEFT JOIN snips USING (key)""")
def hybrid_search(spark, d):
    v = vectors.embed_text(QUESTION, 384, {})
    return rounded(fusion.hybrid_notes(note_index(spark, d), document_chunks(spark, d), QUESTION, v), "score")


ALONE = rf"""n AS (SELECT doc_id AS key, {TOKENS.format("text")} AS tokens FROM documents)"""


def chunk_index(spark, d, again=False):
    """The documents' texts as chunks without titles, indexed by the chunk's key."""
    texts = lambda: table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit("").alias("title"), F.col("text").alias("body"))
    return indexed.text_index(spark, "chunks", documents_path(d), texts, again)


@query(f"WITH {ALONE} SELECT count(*) AS chunks, round(avg(len(tokens)), 6) AS mean FROM n")
def chunk_index_build(spark, d):
    """The chunk index built anew; its totals, which BM25 needs."""
    index = chunk_index(spark, d, again=True)
    return spark.range(1).select(F.lit(index.total).cast("long").alias("chunks"), F.round(F.lit(index.mean), 6).alias("mean"))


@query(f"""WITH {ALONE}, {bm25_sql(QUESTION)}, {vector_sql("documents", "doc_id", "text")},
l AS (SELECT 0 AS list_id, key, row_number() OVER (ORDER BY round(distance, 6), key) - 1 AS rank FROM near QUALIFY rank < 8 UNION ALL SELECT 1, key, row_number() OVER (ORDER BY round(score, 12) DESC, key) - 1 AS rank FROM scored QUALIFY rank < 30)
SELECT key, key::VARCHAR AS file, '' AS heading, round(sum(1 / (61 + rank)), 6) AS score FROM l GROUP BY key ORDER BY round(sum(1 / (61 + rank)), 12) DESC, min((list_id, rank)) LIMIT 8""")
def ask_context(spark, d):
    """The chunks that answer a question's words and vector best, from the stored index and vectors."""
    chunks = document_chunks(spark, d).select(F.col("file").alias("key"), F.col("file").cast("string").alias("file"), F.lit("").alias("heading"), "text", "embedding")
    return rounded(fusion.retrieve_chunks(chunks, QUESTION, vectors.embed_text(QUESTION, 384, {}), index=chunk_index(spark, d)).drop("text"), "score")


@query(f"WITH {NOTES}, {bm25_sql(WORDS)}, r AS (SELECT source, row_number() OVER (ORDER BY score DESC, key) AS nth FROM scored JOIN documents ON key = doc_id ORDER BY score DESC, key LIMIT 20) SELECT source AS file FROM r GROUP BY source")
def ask_citations(spark, d):
    hits = search.bm25(note_index(spark, d), WORDS).orderBy(F.desc("score"), "key").limit(20).join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("file")), "key")
    return fusion.cited_notes(hits)


# --- graph ---------------------------------------------------------------------------------------------------------

EDGES = f"""{STAR_SQL}, r AS (
  SELECT subject AS source, relation, CASE WHEN f.title IS NOT NULL THEN object ELSE COALESCE(s.title, object) END AS target, COALESCE(f.path, s.path) AS path
  FROM triples t LEFT JOIN (SELECT title, min(path) AS path FROM files GROUP BY title) f ON t.object = f.title LEFT JOIN files s ON t.object || '.md' = s.path
), d AS (SELECT DISTINCT source, target, relation FROM r WHERE source <> target),
edges AS (SELECT source, target, relation FROM (SELECT *, bool_or(relation <> 'links_to') OVER (PARTITION BY source, target) AS typed FROM d) WHERE NOT typed OR relation <> 'links_to'),
nodes AS (SELECT id, path, path IS NULL AS ghost, degree FROM (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) LEFT JOIN (SELECT title AS id, min(path) AS path FROM files GROUP BY title) USING (id))"""


def star_edges(spark, d):
    return graph.edges(star_files(spark, d), star_triples(spark, d))


@query(f"WITH {EDGES} SELECT * FROM edges")
def graph_edges(spark, d):
    return star_edges(spark, d)


@query(f"WITH {EDGES} SELECT * FROM nodes")
def graph_nodes(spark, d):
    return graph.nodes(star_files(spark, d), star_edges(spark, d))


@query(f"WITH {EDGES} SELECT id, degree FROM nodes WHERE ghost")
def graph_ghosts(spark, d):
    return graph.nodes(star_files(spark, d), star_edges(spark, d)).where("ghost").select("id", "degree")


def focus(spark, d):
    return table(spark, d, "region").agg(F.min("r_name")).first()[0]


LOCAL = """both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
near AS (SELECT (SELECT min(r_name) FROM region) AS id UNION SELECT b FROM both_ways WHERE a = (SELECT min(r_name) FROM region)),
two AS (SELECT id FROM near UNION SELECT b FROM both_ways JOIN near ON a = id), inside AS (SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM two) AND target IN (SELECT id FROM two))"""


@query(f"WITH {EDGES}, {LOCAL} SELECT * FROM inside")
def graph_local_edges(spark, d):
    return graph.local_slice(star_files(spark, d), star_edges(spark, d), focus(spark, d), 2)[1]


@query(f"""WITH {EDGES}, {LOCAL} SELECT two.id, f.path, f.path IS NULL AS ghost, (SELECT count(*) FROM inside WHERE source = two.id OR target = two.id) AS degree, two.id = (SELECT min(r_name) FROM region) AS focus
FROM two LEFT JOIN (SELECT title AS id, min(path) AS path FROM files GROUP BY title) f ON f.id = two.id""")
def graph_local_nodes(spark, d):
    return graph.local_slice(star_files(spark, d), star_edges(spark, d), focus(spark, d), 2)[0]


@query(f"WITH {EDGES} SELECT *, (SELECT count(*) FROM nodes) AS total FROM nodes ORDER BY degree DESC, id LIMIT 150")
def graph_global_cap(spark, d):
    return graph.global_slice(star_files(spark, d), star_edges(spark, d))[0]


@query(f"""WITH {EDGES}, v AS (SELECT id FROM (SELECT title AS id FROM files WHERE NOT starts_with(path, 'suppliers/') UNION SELECT source FROM r WHERE relation <> 'located_in' UNION SELECT target FROM r WHERE relation <> 'located_in')),
u AS (SELECT id FROM (SELECT title AS id FROM files WHERE starts_with(path, 'suppliers/') UNION SELECT source FROM r WHERE relation = 'located_in' UNION SELECT target FROM r WHERE relation = 'located_in'))
SELECT id, path, ghost, degree, CASE WHEN id IN (SELECT id FROM v) AND id IN (SELECT id FROM u) THEN 'both' WHEN id IN (SELECT id FROM v) THEN 'vault' ELSE 'run' END AS side FROM nodes""")
def graph_overlay(spark, d):
    f, t = star_files(spark, d), star_triples(spark, d)
    run_f, run_t = F.col("path").startswith("suppliers/"), F.col("relation") == "located_in"
    return graph.overlay(f.where(~run_f), t.where(~run_t), f.where(run_f), t.where(run_t))[0]


@query(f"""WITH {EDGES} SELECT id, CASE WHEN path IS NULL THEN NULL WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS "group" FROM nodes""")
def folder_colours(spark, d):
    return graph.folder_groups(graph.nodes(star_files(spark, d), star_edges(spark, d)))


def star_graph(spark, d):
    """All nodes and edges of the star tables, customers and segments too."""
    e = star_edges(spark, d)
    return graph.nodes(star_files(spark, d), e), e


WHOLE = f"{EDGES}, e AS (SELECT source, target FROM edges), ids AS (SELECT source AS id FROM e UNION SELECT target FROM e), outs AS (SELECT source, count(*) AS o FROM e GROUP BY source)"


def pagerank_sql(iterations: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS rank FROM ids)"]
    for i in range(iterations):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT id, 0.15 / (SELECT count(*) FROM ids) + 0.85 * (COALESCE(got, 0) + (SELECT COALESCE(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT source FROM outs)) / (SELECT count(*) FROM ids)) AS rank "
            f"FROM ids LEFT JOIN (SELECT target AS id, sum(rank / o) AS got FROM e JOIN r{i} ON e.source = r{i}.id JOIN outs USING (source) GROUP BY target) USING (id))"
        )
    return f"WITH {WHOLE}, {', '.join(steps)} SELECT id, round(rank, 6) AS rank FROM r{iterations}"


@query(pagerank_sql(50))
def pagerank(spark, d):
    n, e = star_graph(spark, d)
    return rounded(graph.pagerank(n, e), "rank")


@query(f"WITH RECURSIVE {WHOLE}, b AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e), reach(id, other) AS (SELECT id, id FROM ids UNION SELECT reach.id, y FROM reach JOIN b ON other = x) SELECT id, min(other) AS component FROM reach GROUP BY id")
def graph_components(spark, d):
    n, e = star_graph(spark, d)
    return graph.components(n, e)


@query()
def communities(spark, d):
    return graph.communities(*star_graph(spark, d))


RINGS = f"""{WHOLE}, b AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e), deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id),
c AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1), walk(id, ring) AS (SELECT id, 0 FROM c UNION SELECT y, ring + 1 FROM walk JOIN b ON id = x WHERE ring < 8), near AS (SELECT id, min(ring) AS ring FROM walk GROUP BY id),
rings AS (SELECT id, COALESCE(ring, (SELECT max(ring) + 1 FROM near)) AS ring FROM ids LEFT JOIN near USING (id))"""


@query(f"""WITH RECURSIVE {RINGS}, p AS (SELECT *, 2 * pi() * (row_number() OVER (PARTITION BY ring ORDER BY id) - 1) / count(*) OVER (PARTITION BY ring) - pi() / 2 AS a, ring * 252.0 / (SELECT greatest(1, max(ring)) FROM rings) AS r FROM rings)
SELECT id, ring::INTEGER AS ring, round(400 + r * cos(a), 4) AS x, round(300 + r * sin(a), 4) AS y FROM p""")
def radial_layout(spark, d):
    n, e = star_graph(spark, d)
    return layouts.radial_layout(n, e).withColumns({c: F.round(c, 4) for c in "xy"})


@query()
def groups_layout(spark, d):
    """Communities on a ring; the numbers of the communities are those of the query of that name."""
    return layouts.groups_layout(graph.communities(*star_graph(spark, d)))


def capped_graph(spark, d, most=5000):
    """The whole graph where the operators that run as one group take it, else its `most` nodes of highest degree."""
    return graph.global_slice(star_files(spark, d), star_edges(spark, d), most)


@query()
def mincut(spark, d):
    return graph.bisected(*capped_graph(spark, d, 2000))


@query()
def force_layout(spark, d):
    return layouts.force_layout(*capped_graph(spark, d))


@query()
def tree_layout(spark, d):
    return layouts.tree_layout(*capped_graph(spark, d))


@query()
def blocks_layout(spark, d):
    return layouts.blocks_layout(*capped_graph(spark, d, 2000))


# --- distillation --------------------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS n, least(count(*), greatest(4, least(24, ceil(count(*) / 8.0))))::INTEGER AS k FROM documents GROUP BY source")
def choose_k(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", "n", tx.choose_k(F.col("n")).alias("k"))


def kmeans_sql(points: str) -> str:
    """labels(file, id, label, distance to the centre after the last step), by the rules of distill.kmeans, of points (file, id, x DOUBLE[])."""
    return f"""points AS ({points}), sizes AS (SELECT file, count(*) AS n, least(count(*), greatest(4, least(24, ceil(count(*) / 8.0))))::INTEGER AS k FROM points GROUP BY file),
seeds AS (
  SELECT file, 1 AS n, [arg_min(x, id)] AS c FROM points GROUP BY file
  UNION ALL SELECT file, n + 1, list_append(any_value(c), arg_max(x, (near, -id))) FROM (
    SELECT s.file, s.n, s.c, p.id, p.x, list_min(list_transform(s.c, lambda y: list_sum(list_transform(list_zip(y, p.x), lambda z: (z[1] - z[2]) ** 2)))) AS near
    FROM seeds s JOIN sizes z ON z.file = s.file JOIN points p ON p.file = s.file WHERE s.n < z.k) GROUP BY file, n
), steps AS (
  SELECT s.file, 0 AS step, s.c, s.c AS before FROM seeds s JOIN sizes z ON z.file = s.file AND z.k = s.n
  UNION ALL SELECT file, step + 1, list(m ORDER BY j), any_value(c) FROM (
    SELECT file, step, j, any_value(c) AS c, list(m ORDER BY d) AS m FROM (SELECT file, step, j, d, any_value(c) AS c, avg(v)::FLOAT::DOUBLE AS m FROM (
      SELECT file, step, c, list_position(far, list_min(far)) AS j, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM (
        SELECT s.file, s.step, s.c, p.x, list_transform(s.c, lambda y: list_sum(list_transform(list_zip(y, p.x), lambda z: (z[1] - z[2]) ** 2))) AS far FROM steps s JOIN points p ON p.file = s.file WHERE s.step < 20))
      GROUP BY file, step, j, d) GROUP BY file, step, j) GROUP BY file, step
), labels AS (
  SELECT file, id, list_position(far, list_min(far)) AS label, list_sum(list_transform(list_zip(c[list_position(far, list_min(far))], x), lambda z: (z[1] - z[2]) ** 2)) AS distance FROM (
    SELECT s.file, s.c, p.id, p.x, list_transform(s.before, lambda y: list_sum(list_transform(list_zip(y, p.x), lambda z: (z[1] - z[2]) ** 2))) AS far FROM steps s JOIN points p ON p.file = s.file WHERE s.step = 20)
)"""


@query()
def kmeans(spark, d):
    return distill.clusters(table(spark, d, "embeddings").select(F.col("label").alias("file"), F.col("vec_id").alias("chunk_id"), "embedding"))


@query(f"""WITH RECURSIVE {kmeans_sql("SELECT label AS file, vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings")},
found AS (SELECT file, label, row_number() OVER (PARTITION BY file ORDER BY min(id)) - 1 AS cluster FROM labels GROUP BY file, label)
SELECT file, cluster::INTEGER AS cluster, id, CASE WHEN row_number() OVER (PARTITION BY file, cluster ORDER BY distance, id) <= 4 THEN row_number() OVER (PARTITION BY file, cluster ORDER BY distance, id) ELSE 0 END::INTEGER AS representative FROM labels JOIN found USING (file, label)""")
def kmeans_members(spark, d):
    """The clusters within each label: every member, representatives numbered from 1."""
    members = kmeans(spark, d).select("file", "cluster", F.explode("members").alias("id"), "representatives")
    return members.select("file", "cluster", "id", F.array_position("representatives", F.col("id")).cast("int").alias("representative"))


@query(f"""WITH RECURSIVE {kmeans_sql("SELECT 0 AS file, vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings")},
found AS (SELECT label, row_number() OVER (ORDER BY min(id)) - 1 AS cluster FROM labels GROUP BY label)
SELECT id, cluster::INTEGER AS cluster, round(distance, 6) AS distance, (row_number() OVER (PARTITION BY cluster ORDER BY distance, id) <= 4) AS representative FROM labels JOIN found USING (label)""")
def kmeans_all(spark, d):
    """All vectors as one set, clustered by passes over the whole table."""
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows, nearest = clustering.kmeans(points, distill.cluster_count(points.count()))
    return rounded(rows.join(nearest.select("id", F.lit(True).alias("representative")), "id", "left").withColumn("representative", F.coalesce("representative", F.lit(False))), "distance")


@query("""SELECT b.item_id, d.doc_id, (strpos(d.text, trim(b.text)) - 1)::BIGINT AS start, (strpos(d.text, trim(b.text)) - 1 + length(trim(b.text)))::BIGINT AS "end" FROM benchmark b JOIN documents d ON contains(d.text, trim(b.text))""")
def ground_quotes(spark, d):
    """Benchmark texts as quotes, located in the documents.

    Candidates hold the quote's longest inner word, so the join is on equality of words.
    """
    quotes = table(spark, d, "benchmark").select("item_id", F.trim("text").alias("quote")).where("quote <> ''")
    docs = table(spark, d, "documents").select("doc_id", "text")
    word = F.filter(F.regexp_extract_all("quote", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) > 0)
    inner = F.slice(word, 2, F.greatest(F.size(word) - 2, F.lit(0)))  # whole words of the quote are whole words of the text
    key = F.array_sort(inner, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    keyed = quotes.select("item_id", F.get(key, 0).alias("word"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("word"))
    small = F.broadcast if keyed.count() <= 100_000 else lambda df: df
    pairs = words.join(small(keyed.where("word is not null")), "word").select("item_id", "doc_id").distinct()
    short = keyed.where("word is null").select("item_id")  # quotes of fewer than three words meet every document
    pairs = pairs.unionByName(docs.select("doc_id").crossJoin(small(short)).select("item_id", "doc_id"))
    both = pairs.join(quotes, "item_id").join(docs, "doc_id").withColumn("at", F.instr("text", F.col("quote")) - 1).where("at >= 0")
    return both.select("item_id", "doc_id", F.col("at").cast("long").alias("start"), (F.col("at") + F.length("quote")).cast("long").alias("end"))


@query("""WITH t AS (SELECT DISTINCT p_name AS title FROM part), g AS (SELECT title, list_distinct(list_transform(range(1, length(title) + 2), lambda i: substr('  ' || lower(title) || ' ', i, 3))) AS g FROM t),
s AS (SELECT a.title AS a, b.title AS b, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS similarity FROM g a JOIN g b ON a.title < b.title)
SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE s.similarity >= 0.5""")
def near_dup_titles(spark, d):
    return rounded(distill.similar_titles(table(spark, d, "part").select(F.col("p_name").alias("title")), 0.5), "similarity")


@query("SELECT p_partkey, p_name || CASE WHEN nth > 1 THEN ' ' || nth ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS nth FROM part)")
def name_decollide(spark, d):
    return distill.unique_names(table(spark, d, "part"), "p_name", "p_partkey").select("p_partkey", "name")


@query(r"""SELECT p_name || CASE WHEN nth > 1 THEN ' ' || nth ELSE '' END AS name, p_name || CASE WHEN nth > 1 THEN ' ' || nth ELSE '' END || '.md' AS file_name,
'---' || chr(10) || 'kind: concept' || chr(10) || 'source: book' || chr(10) || 'cite:' || chr(10) || '  - chunk: ' || p_size || chr(10) || '    span: 0-' || length(p_type) || chr(10) || '---' || chr(10) || chr(10) || '# ' || p_name || CASE WHEN nth > 1 THEN ' ' || nth ELSE '' END
|| chr(10) || chr(10) || 'source:: [[book]]' || chr(10) || 'made_by:: [[' || regexp_replace(p_brand, '#', ' ', 'g') || ']]' || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '> ' || p_type || chr(10) AS content
FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS nth FROM part)""")
def emit_notes(spark, d):
    cite = F.struct(F.lit("x/book.md").alias("file"), F.col("p_size").cast("long").alias("chunkId"), F.lit(0).cast("long").alias("start"), F.length("p_type").cast("long").alias("end"), F.col("p_type").alias("quote"))
    n = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.lit("concept").alias("kind"), F.col("p_type").alias("summary"), F.array(F.struct(F.lit("made/by").alias("relation"), F.col("p_brand").alias("target"))).alias("links"), F.array(cite).alias("citations"))
    return distill.render(distill.unique_names(n, order="p_partkey"))


@query()
def distill_run(spark, d):
    """All documents through the whole distillation with the offline model."""
    from .distill import distill_documents

    docs = table(spark, d, "documents").select(F.format_string("b/%s.md", F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("# Item\n\n"), F.col("text")).alias("content"))
    return distill_documents(docs).rendered


# --- telemetry, trees, conversion ----------------------------------------------------------------------------------


def samples(spark, d):
    return table(spark, d, "events").select(F.col("ts").alias("at"), F.col("value").alias("ms"), "event_id")


@query("""SELECT b::INTEGER AS bucket, (SELECT count(*) FROM events WHERE CASE WHEN value < 1 THEN 0 ELSE least(14, floor(log2(value)) + 1) END = b) AS n FROM range(15) t(b)""")
def lag_histogram(spark, d):
    return telemetry.histogram(samples(spark, d))


@query("""WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT max(n) AS count, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(max(value) FILTER (i = least(n - 1, floor(0.99 * n))), 6) AS p99 FROM s""")
def lag_summary(spark, d):
    return rounded(telemetry.summary(samples(spark, d)), "max", "mean", "p99")


@query("SELECT ts AS at, value AS ms, event_id FROM events ORDER BY value DESC, ts LIMIT 6")
def worst_n(spark, d):
    return telemetry.worst(samples(spark, d))


@query("""SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w, 6) AS worst FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW)""")
def rolling_5m(spark, d):
    return rounded(telemetry.rolling(samples(spark, d)).select("event_id", "n", "mean", "worst"), "mean", "worst")


@query("SELECT event_type, round(least(1.0, sum(value) / sum(value + 1)), 6) AS progress FROM events GROUP BY event_type")
def byte_progress(spark, d):
    return rounded(table(spark, d, "events").groupBy("event_type").agg(telemetry.progress(F.col("value"), F.col("value") + 1).alias("progress")), "progress")


@query("SELECT date_trunc('hour', ts) AS at, round(sum(value), 4) AS cpu, count(*) AS memory FROM events GROUP BY 1")
def process_usage(spark, d):
    e = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("at"), F.col("value").alias("cpu"), F.lit(1).alias("memory"))
    return telemetry.usage(e).withColumn("cpu", F.round("cpu", 4))


@query("""WITH RECURSIVE f AS (SELECT string_split('all/' || lang || '/' || source, '/') AS p FROM documents), up AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS folder FROM f, range(1, 4) t(i)),
c AS (SELECT folder, (SELECT count(*) FROM f WHERE array_to_string(p, '/') = folder) AS files, (SELECT count(*) FROM up u WHERE starts_with(u.folder, up.folder || '/') AND NOT contains(substr(u.folder, length(up.folder) + 2), '/')) AS folders FROM up),
kept AS (SELECT * FROM c WHERE files > 0 OR folders <> 1), p AS (SELECT k.folder, COALESCE(max(a.folder) FILTER (a.folder <> k.folder AND starts_with(k.folder, a.folder || '/')), '') AS parent, k.files, k.folders FROM kept k, kept a GROUP BY ALL)
SELECT folder, parent, CASE WHEN parent = '' THEN folder ELSE substr(folder, length(parent) + 2) END AS name, files, folders FROM p""")
def file_tree(spark, d):
    docs = table(spark, d, "documents").select(F.concat_ws("/", F.lit("all"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("rel"))
    return markdown.file_tree(docs)


@query("SELECT user_id AS path, max(ts) AS at FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 10")
def recents(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("ts").alias("at"), "event_id")
    return store.merge_recents(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"))


@query()
def html_to_markdown(spark, d):
    return convert.html_pages(table(spark, d, "pages"))


@query("SELECT p_name, p_brand, trim(regexp_replace(regexp_replace(p_brand || '/' || p_type, '[\\\\/:*?\"<>|#\\[\\]]+', ' ', 'g'), '\\s+', ' ', 'g')) AS note FROM part")
def safe_names(spark, d):
    return table(spark, d, "part").select("p_name", "p_brand", tx.note_name(F.concat_ws("/", "p_brand", "p_type")).alias("note"))


from . import index_queries as _, upkeep_queries as _u, vault_queries as _v  # noqa: E402, F401  they register their queries too
