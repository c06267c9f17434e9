"""More registered queries, with their SQL: upkeep of the index, parsed notes, slices as a reader sees them, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import distill, graph, markdown, store, telemetry
from ..sources.tables import STAR_SQL, star_files, star_triples, table
from . import runs
from .queries import EDGES, ORACLES, QUERIES, query, samples, star_edges

NL = "\n"


def doc_notes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))


# --- upkeep --------------------------------------------------------------------------------------------------------


@query(f"""WITH {STAR_SQL} SELECT subject, relation, object, source_file FROM triples WHERE NOT starts_with(source_file, 'nations/')
UNION ALL SELECT n_name, 'near', n_name || '!', 'nations/' || n_name || '.md' FROM nation""")
def replace_triples(spark, d):
    """All nations are indexed again with other triples; the rest stays."""
    rows = table(spark, d, "nation").select(F.col("n_name").alias("subject"), F.lit("near").alias("relation"), F.concat("n_name", F.lit("!")).alias("object"), F.format_string("nations/%s.md", "n_name").alias("source_file"))
    return store.replace(star_triples(spark, d), rows, rows, "source_file")


@query(f"WITH {STAR_SQL} SELECT path, title FROM files WHERE NOT starts_with(path, 'customers/')")
def remove_files(spark, d):
    files = star_files(spark, d)
    return store.remove(files, files.where(F.col("path").startswith("customers/")))


@query("SELECT o_custkey AS path, max(o_orderkey) AS version FROM orders GROUP BY 1")
def upsert_latest(spark, d):
    """The latest order of each customer, from two halves of the table."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("version"))
    return store.upsert(o.where("version % 2 = 0"), o.where("version % 2 = 1"), "path", "version")


@query(f"WITH {STAR_SQL} SELECT CASE WHEN starts_with(path, 'suppliers/') THEN 'people/s/' || substr(path, 11) ELSE path END AS path, title FROM files")
def repath_folder(spark, d):
    return store.repath(star_files(spark, d), "suppliers", "people/s")


@query("SELECT n_name || '.md' AS path, CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN n_comment || chr(10) || 'cites:: [[R]]' || chr(10) ELSE n_comment END AS content FROM (SELECT n_name, 'note of ' || n_name AS n_comment FROM nation)")
def written_back(spark, d):
    n = table(spark, d, "nation").select(F.concat("n_name", F.lit(".md")).alias("path"), F.concat(F.lit("note of "), "n_name").alias("content"))
    return store.add_relation(n, n.agg(F.min("path")).first()[0], "cites", "R")


CHANGED = "CASE WHEN doc_id % 4 = 1 THEN text || chr(10) || 'new line' ELSE text END"


@query(ORACLES["chunk_pack"].replace("(SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)", f"(SELECT doc_id, {CHANGED} AS text, string_split({CHANGED}, chr(10)) AS lines FROM documents)"))
def rechunked(spark, d):
    """All documents chunked, then every fourth one changed: the next chunks, of which only theirs are made anew."""
    old = doc_notes(spark, d)
    new = old.withColumn("content", F.when(F.col("doc_id") % 4 == 1, F.concat("content", F.lit("\nnew line"))).otherwise(F.col("content"))).drop("doc_id")
    chunks = markdown.chunks(old)
    vectors = chunks.select("file", "ord")
    out, _, _ = store.rechunk(chunks, vectors, store.hashes(old), new, markdown.chunks)
    return out.select(F.col("file").cast("long").alias("doc_id"), "start", "end")


@query("SELECT vec_id AS file, 0 AS ord, vec_id % 3 AS label FROM embeddings WHERE vec_id % 3 <> 0")
def pending_vectors(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("file"), F.lit(0).alias("ord"), (F.col("vec_id") % 3).alias("label"))
    return store.pending(chunks, chunks.where("label = 0"))


@query("SELECT count(*) AS chunks, count(*) FILTER (vec_id % 3 = 0) AS embedded, count(*) FILTER (vec_id % 3 <> 0) AS pending FROM embeddings")
def vector_counts(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("file"), F.lit(0).alias("ord"))
    return store.vector_status(chunks, chunks.where("file % 3 = 0"))


@query("SELECT vec_id AS file, 0 AS ord, round((CASE WHEN vec_id % 10 = 0 THEN -embedding[1] ELSE embedding[1] END)::DOUBLE, 6) AS first FROM embeddings")
def vectors_put(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("file"), F.lit(0).alias("ord"), "embedding")
    dims = v.select(F.size("embedding")).first()[0]
    turned = v.where("file % 10 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return store.set_dims(store.put_vectors(v, turned, dims), dims, dims).select("file", "ord", F.round(F.get("embedding", 0).cast("double"), 6).alias("first"))


# --- parsed notes --------------------------------------------------------------------------------------------------


def region_maps(spark, d):
    """A map per region: the region, below it its nations by alias, and an edge of each nation."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("ns"))
    bullets = F.array_join(F.transform("ns", lambda x: F.concat(F.lit("  - [["), x, F.lit("|"), F.lower(x), F.lit("]] x\n"))), "")
    edges = F.array_join(F.transform("ns", lambda x: F.concat(F.lit("- [["), x, F.lit("]] part of [["), F.col("r_name"), F.lit("#top]]\n"))), "")
    content = F.concat(F.lit("# Map of [["), F.col("r_name"), F.lit("]]\n- [["), F.col("r_name"), F.lit("]]\n"), bullets, F.lit("## Edges\n"), edges)
    return n.select(F.concat("r_name", F.lit(".map.md")).alias("path"), content.alias("content"))


@query("""WITH n AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS nth FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT r_name || '.map.md' AS path, 'Map of ' || r_name AS title, 0::BIGINT AS node_id, -1::BIGINT AS parent_id, 0::BIGINT AS ord, 0::BIGINT AS depth, r_name AS label, r_name AS target FROM n
UNION ALL SELECT r_name || '.map.md', 'Map of ' || r_name, nth, 0, nth - 1, 1, lower(n_name) || ' x', n_name FROM n""")
def map_outline(spark, d):
    return markdown.map_nodes(region_maps(spark, d)).withColumn("parent_id", F.coalesce("parent_id", F.lit(-1).cast("long")))


@query("SELECT r_name || '.map.md' AS path, n_name AS source, 'part of' AS relation, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def map_relations(spark, d):
    return markdown.map_edges(region_maps(spark, d))


def part_notes(spark, d):
    content = F.concat(F.lit("# "), "p_brand", F.lit("\n\n"), "p_name", F.lit("\n\n## "), "p_type", F.lit("\n[["), "p_type", F.lit("|x]] [site](https://x.org/"), F.col("p_partkey").cast("string"), F.lit(") <https://y.org/"), F.col("p_partkey").cast("string"), F.lit(">\n"))
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))


LAST = "'[[' || p_type || '|x]] [site](https://x.org/' || p_partkey || ') <https://y.org/' || p_partkey || '>'"


@query(f"""WITH p AS (SELECT *, length(p_brand) + 4 AS a, length(p_brand) + 4 + length(p_name) + 2 AS b, length(p_brand) + 4 + length(p_name) + 2 + 4 + length(p_type) AS c, {LAST} AS last FROM part)
SELECT p_partkey::VARCHAR AS file, 0 AS ord, p_brand AS heading, (a - 1)::BIGINT AS start, b::BIGINT AS "end", p_name AS text, p_brand || chr(10) || chr(10) || p_name AS embed_text FROM p
UNION ALL SELECT p_partkey::VARCHAR, 1, p_brand || ' > ' || p_type, c::BIGINT, (c + length(last) + 1)::BIGINT, last, p_brand || ' > ' || p_type || chr(10) || chr(10) || last FROM p""")
def chunks_of_headings(spark, d):
    """Chunks below headings, with the text to embed."""
    return markdown.chunks(part_notes(spark, d))


@query("SELECT p_partkey::VARCHAR AS path, 'site' AS label, 'https://x.org/' || p_partkey AS url FROM part UNION ALL SELECT p_partkey::VARCHAR, 'https://y.org/' || p_partkey, 'https://y.org/' || p_partkey FROM part")
def external_links(spark, d):
    return markdown.external_links(part_notes(spark, d))


@query("""SELECT n_name AS path, 0::BIGINT AS start, (length(n_name) + 2)::BIGINT AS "end", 'heading' AS kind, '' AS target, 1::BIGINT AS level FROM nation
UNION ALL SELECT n_name, (length(n_name) + 7)::BIGINT, (2 * length(n_name) + 11)::BIGINT, 'wikilink', n_name, 0 FROM nation UNION ALL SELECT n_name, (2 * length(n_name) + 12)::BIGINT, (2 * length(n_name) + 17)::BIGINT, 'strong', '', 0 FROM nation""")
def live_spans(spark, d):
    content = F.concat(F.lit("# "), "n_name", F.lit("\nsee [["), "n_name", F.lit("]] **b** `"))
    s = markdown.spans(table(spark, d, "nation").select(F.col("n_name").alias("path"), content.alias("content")))
    return s.withColumn("target", F.coalesce("target", F.lit(""))).withColumn("level", F.coalesce("level", F.lit(0).cast("long")))


@query("""SELECT p_name || CASE WHEN nth > 1 THEN ' ' || nth ELSE '' END || '.md' AS path, 'book' AS source, p_size::BIGINT AS chunk, 0::BIGINT AS start, length(p_type)::BIGINT AS "end"
FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS nth FROM part)""")
def citation_spans(spark, d):
    """What the rendered notes cite."""
    return markdown.citations(QUERIES["emit_notes"](spark, d).select(F.col("file_name").alias("path"), "content"))


@query("""SELECT doc_id::VARCHAR AS path, doc_id::VARCHAR AS source, 5::BIGINT AS start, 25::BIGINT AS "end", substr(text, 6, 20) AS text FROM documents""")
def citation_reveal(spark, d):
    """The cited span of every document."""
    docs = doc_notes(spark, d)
    cites = docs.select("path", F.col("path").alias("source"), F.lit(0).cast("long").alias("chunk"), F.lit(5).cast("long").alias("start"), F.lit(25).cast("long").alias("end"))
    return runs.reveal(cites, docs.select(F.format_string("lib/%s.md", "path").alias("path"), "content"))


# --- slices --------------------------------------------------------------------------------------------------------

NEAR = "both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges)"
ENDS = "(SELECT min(r_name) FROM region)", "(SELECT max(r_name) FROM region)"


def _ends(spark, d):
    return [r for r in table(spark, d, "region").agg(F.min("r_name"), F.max("r_name")).first()]


@query(f"WITH {EDGES}, {NEAR} SELECT id FROM (SELECT {ENDS[0]} AS id UNION SELECT {ENDS[1]} UNION SELECT b FROM both_ways WHERE a IN ({ENDS[0]}, {ENDS[1]}))")
def expanded_slice(spark, d):
    f, e = star_files(spark, d), star_edges(spark, d)
    a, b = _ends(spark, d)
    return graph.expand(graph.local_slice(f, e, a), graph.local_slice(f, e, b))[0]


@query(f"WITH {EDGES}, {NEAR} SELECT id FROM (SELECT {ENDS[1]} AS id UNION SELECT b FROM both_ways WHERE a = {ENDS[1]}) WHERE id NOT IN (SELECT {ENDS[0]} UNION SELECT b FROM both_ways WHERE a = {ENDS[0]})")
def collapsed_slice(spark, d):
    f, e = star_files(spark, d), star_edges(spark, d)
    a, b = _ends(spark, d)
    both = graph.expand(graph.local_slice(f, e, a), graph.local_slice(f, e, b))
    return graph.collapse(both, graph.local_slice(f, e, a))[0]


@query(f"WITH {EDGES} SELECT * FROM edges WHERE relation NOT IN ('segment', 'located_in')")
def legend_filter(spark, d):
    e = star_edges(spark, d)
    return graph.without_relations(graph.nodes(star_files(spark, d), e), e, ["segment", "located_in"])[1]


@query(f"WITH {EDGES} SELECT source, target, relation FROM edges WHERE source NOT IN (SELECT n_name FROM nation) AND target NOT IN (SELECT n_name FROM nation)")
def hidden_nodes(spark, d):
    e = star_edges(spark, d)
    return graph.without_nodes(graph.nodes(star_files(spark, d), e), e, table(spark, d, "nation").select(F.col("n_name").alias("id")))[1]


@query(f"WITH {EDGES}, x AS (SELECT min(n_name) AS id FROM nation) SELECT 'out' AS direction, relation, target AS other FROM edges, x WHERE source = id UNION ALL SELECT 'in', relation, source FROM edges, x WHERE target = id")
def link_inspector(spark, d):
    return graph.incident(star_edges(spark, d), table(spark, d, "nation").agg(F.min("n_name")).first()[0])


# --- distillation and scalars --------------------------------------------------------------------------------------


@query("""SELECT doc_id AS item_id, 0 AS nth, doc_id::VARCHAR AS file, doc_id AS chunk_id, (strpos(text, q) + 99)::BIGINT AS start, (strpos(text, q) + 99 + length(q))::BIGINT AS "end", q AS quote
FROM (SELECT *, trim(substr(text, 31, 50), ' ') AS q FROM documents) WHERE q <> ''""")
def grounded_quotes(spark, d):
    """A quote of every document, grounded in its chunk, which starts at 100; a quote that is nowhere is dropped."""
    docs = table(spark, d, "documents")
    quote = lambda q: F.struct(F.col("doc_id").alias("chunkId"), q.alias("quote"))
    items = docs.select(F.col("doc_id").alias("item_id"), F.array(quote(F.substring("text", 31, 50)), quote(F.lit("§ not there §"))).alias("evidence"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("file"), F.lit(100).cast("long").alias("start"), "text")
    return distill.ground(items, chunks)


@query("""SELECT p_partkey AS file, p_partkey % 3 <> 0 AS ok, CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '' END AS title, CASE WHEN p_partkey % 3 <> 0 THEN 'claim' ELSE '' END AS kind, CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END::BIGINT AS chunk FROM part""")
def parsed_replies(spark, d):
    """A model's replies read: prose around JSON, and replies that are none."""
    p = table(spark, d, "part")
    reply = F.concat(F.lit('Here: {"items": [{"kind": "claim", "title": " '), "p_name", F.lit(' ", "evidence": [{"chunkId": "'), F.col("p_size").cast("string"), F.lit('", "quote": "q"}, {"quote": "x"}]}, {"title": ""}]} done'))
    rows = p.select(F.col("p_partkey").alias("file"), F.lit(0).alias("cluster"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("no JSON {"), "p_name")).otherwise(reply).alias("prompt"))
    first = F.get("items", 0)
    got = distill.extract(rows, lambda prompt: prompt.split("\n\nAnswer")[0], rule="")  # the rows are what the model says
    return got.select("file", "ok", F.coalesce(first["title"], F.lit("")).alias("title"), F.coalesce(first["kind"], F.lit("")).alias("kind"), F.coalesce(F.get(first["evidence"], 0)["chunkId"], F.lit(0).cast("long")).alias("chunk"))


@query("""SELECT n_regionkey AS file, 0 AS cluster, string_agg('[chunk ' || n_nationkey || '] ' || n_name || chr(10) || 'text of ' || n_name, chr(10) || chr(10) ORDER BY n_nationkey) AS prompt FROM nation GROUP BY 1""")
def cluster_prompts(spark, d):
    n = table(spark, d, "nation")
    clusters = n.groupBy(F.col("n_regionkey").alias("file")).agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("long"))).alias("representatives")).withColumn("cluster", F.lit(0))
    chunks = n.select(F.col("n_regionkey").alias("file"), F.col("n_nationkey").cast("long").alias("chunk_id"), F.col("n_name").alias("heading"), F.concat(F.lit("text of "), "n_name").alias("text"))
    return distill.prompts(clusters, chunks)


@query("""SELECT p_partkey, left(regexp_replace(regexp_replace(p_type || ' (2)', '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS run, regexp_replace(p_brand || '/x', '[^A-Za-z0-9_ -]', '_', 'g') AS relation,
regexp_replace(p_name, '\\s+', ' ', 'g') AS flat FROM part""")
def text_scalars(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", tx.run_id(F.concat(F.lit("d/"), "p_type", F.lit(" (2).pdf"))).alias("run"), tx.relation_name(F.concat("p_brand", F.lit("/x"))).alias("relation"), tx.collapsed(F.concat(F.lit(" \n"), F.replace("p_name", F.lit(" "), F.lit("\t  ")), F.lit(" "))).alias("flat"))


@query("SELECT event_id, CASE WHEN value < 1 THEN '<1ms' WHEN value < 1000 THEN round(value)::BIGINT || 'ms' ELSE printf('%.1fs', value / 1000) END AS label FROM events")
def lag_labels(spark, d):
    return samples(spark, d).select("event_id", tx.lag_label(F.col("ms")).alias("label"))


@query("SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events) * 16)::INTEGER AS level FROM events")
def sparkline(spark, d):
    return telemetry.sparkline(samples(spark, d), 16, "event_id")
