"""Registered queries over files that Spark writes from the tables: vaults, documents to convert, runs, settings, streams."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layouts, markdown, store
from ..sources import convert, settings, vault
from ..sources.tables import table
from ..streaming import telemetry as stream_telemetry
from . import indexed, runs
from .chat import StubChat, answer, event_payloads, payload_text
from .queries import documents_path, query, rounded, samples

# --- vaults --------------------------------------------------------------------------------------------------------


def written_files(files: DataFrame, root: str) -> int:
    """Writes files (path, content) below root, by executors; how many there are. root: a folder that Python workers can open."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = vault._opener(root)
        made = set()
        for f in frames:
            for path, content in zip(f.path, f.content, strict=True):
                folder = path.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(f"{top}/{folder}")
                    made.add(folder)
                with system.open_output_stream(f"{top}/{path}") as out:
                    out.write(content.encode())
            yield pd.DataFrame({"n": [len(f)]})

    # small tables are few partitions, and making files is slow: they are dealt by number
    n = max(files.sparkSession.sparkContext.defaultParallelism, min(files.count() // 1000, 10_000))
    return files.repartition(n).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def part_files(spark: SparkSession, d: str) -> DataFrame:
    """A vault of parts: most in a folder of their brand, some under names with an underscore, some in hidden folders, some no notes."""
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    folder = F.when(key % 10 == 3, F.lit(".hidden/")).when(key % 10 == 4, F.lit("_drafts/")).otherwise(F.concat(F.regexp_replace("p_brand", "#", "-"), F.lit("/")))
    ending = F.when(key % 10 == 5, ".txt").when(key % 10 == 6, ".MD").otherwise(".md")
    return p.select(F.concat(folder, key.cast("string"), ending).alias("path"), F.concat(F.lit("# "), "p_name", F.lit("\n\n[["), "p_type", F.lit("]]\n")).alias("content"))


PART_FILES = """files AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 4 THEN '_drafts/' ELSE replace(p_brand, '#', '-') || '/' END || p_partkey || CASE WHEN p_partkey % 10 = 6 THEN '.MD' ELSE '.md' END AS path,
  '# ' || p_name || chr(10) || chr(10) || '[[' || p_type || ']]' || chr(10) AS content FROM part WHERE p_partkey % 10 NOT IN (3, 5))"""


def part_vault(spark: SparkSession, d: str) -> str:
    def write(place: str) -> None:
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place))
        written_files(part_files(spark, d), place)

    return indexed.built(spark, "part vault", f"{d.rstrip('/')}/part.parquet", write)


@query(f"WITH {PART_FILES} SELECT path, content FROM files")
def vault_notes(spark, d):
    """All notes of a vault on disk: hidden folders and other files are left out, names with an underscore are not."""
    return vault.notes(spark, part_vault(spark, d)).select("path", "content")


@query(f"WITH {PART_FILES} SELECT path AS rel, p_partkey::VARCHAR AS name FROM files")
def vault_listing(spark, d):
    return vault.scan(spark, part_vault(spark, d)).select("rel", "name")


@query(f"WITH {PART_FILES} SELECT path, content FROM files WHERE p_partkey % 3 = 0 UNION ALL SELECT 'gone/' || s_suppkey || '.md', NULL FROM supplier")
def vault_changed_notes(spark, d):
    """What has changed since an index was made that knew other times of every third note, and notes that are gone."""
    root = part_vault(spark, d)
    known = vault.listing(spark, root).where(~F.col("is_dir")).select(F.col("rel").alias("path"), F.when(F.regexp_extract("rel", r"(\d+)\.[^.]*$", 1).cast("long") % 3 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    gone = table(spark, d, "supplier").select(F.format_string("gone/%s.md", F.col("s_suppkey").cast("string")).alias("path"), F.lit(1).cast("long").alias("mtime"))
    return vault.changes(spark, root, known.where(F.lower("path").endswith(".md")).unionByName(gone)).select("path", "content")


# --- documents to convert ------------------------------------------------------------------------------------------


def _pdf(pages: list[str]) -> bytes:
    """A PDF whose objects stand in the reverse order of its pages."""
    objects = ["<</Type /Catalog /Pages 2 0 R>>", f"<</Type /Pages /Kids [{' '.join(f'{10 + i} 0 R' for i in range(len(pages)))}] /Count {len(pages)}>>"]
    numbered = [(1, objects[0]), (2, objects[1])]
    for i, text in reversed(list(enumerate(pages))):
        shown = f"BT /F1 12 Tf ({text}) Tj ET"
        numbered += [(10 + i, f"<</Type /Page /Contents {1000 + i} 0 R>>"), (1000 + i, f"<</Length {len(shown)}>>\nstream\n{shown}\nendstream")]
    return b"%PDF-1.4\n" + b"".join(f"{n} 0 obj {body}\nendobj\n".encode("latin-1") for n, body in numbered)


def _epub(title: str, sections: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="s{i}" href="s{i}.xhtml"/>' for i in reversed(range(len(sections))))
        z.writestr("o/p.opf", f"<package><manifest>{items}</manifest><spine>{''.join(f'<itemref idref="s{i}"/>' for i in range(len(sections)))}</spine></package>")
        for i, text in enumerate(sections):
            z.writestr(f"o/s{i}.xhtml", f"<html><head><title>{title}</title><body><h1>{title}</h1><p>{text} <b>bold</b></p>")
    return out.getvalue()


@query("""SELECT CASE p_partkey % 5 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'a.epub' WHEN 2 THEN 'a.txt' WHEN 3 THEN 'a.markdown' ELSE 'a.doc' END AS kind, p_partkey,
CASE p_partkey % 5 WHEN 0 THEN '## Page 1' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '## Page 2' || chr(10) || chr(10) || p_type || chr(10)
WHEN 1 THEN '## Section 1' || chr(10) || chr(10) || '# ' || p_name || chr(10) || chr(10) || p_type || ' **bold**' || chr(10) || chr(10) || '## Section 2' || chr(10) || chr(10) || '# ' || p_name || chr(10) || chr(10) || p_name || ' **bold**' || chr(10)
WHEN 4 THEN NULL ELSE p_name || chr(10) || p_type END AS content, p_partkey % 5 = 4 AS failed FROM part""")
def converted_files(spark, d):
    """Parts as PDF, EPUB and text files, converted; what has no reader fails by itself."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            data = [_pdf([n, t]) if k % 5 == 0 else _epub(n, [t, n]) if k % 5 == 1 else f"{n}\n{t}".encode() for k, n, t in zip(f.p_partkey, f.p_name, f.p_type, strict=True)]
            yield pd.DataFrame({"path": [f"{k}/a.{('PDF', 'epub', 'txt', 'markdown', 'doc')[k % 5]}" for k in f.p_partkey], "content": data})

    files = table(spark, d, "part").select("p_partkey", "p_name", "p_type").mapInPandas(write, "path string, content binary")
    place = F.split("path", "/")
    return convert.convert(files).select(F.get(place, 1).alias("kind"), F.get(place, 0).cast(table(spark, d, "part").schema["p_partkey"].dataType).alias("p_partkey"), "content", F.col("error").isNotNull().alias("failed"))


# --- models, settings, runs ----------------------------------------------------------------------------------------

FIRST = r"regexp_extract_all(split_part(COALESCE(text, ''), chr(10), 1), '[^ \t]+')[1:20]"


@query(f"SELECT doc_id, 'From the notes: ' || array_to_string({FIRST}, ' ') || CASE WHEN len({FIRST}) > 0 THEN ' ' ELSE '' END AS reply FROM documents")
def streamed_answers(spark, d):
    """The offline model's answer to each document, sent as an event stream of either dialect and read back."""
    import json

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies = []
            for i, text in zip(f.doc_id, f.text, strict=True):
                piece = (lambda t: {"delta": {"text": t}}) if i % 2 else (lambda t: {"choices": [{"delta": {"content": t}}]})
                lines = [x for t in StubChat().stream(text or "") for x in ("event: part", f"data: {json.dumps(piece(t))}", "")]
                replies.append("".join(map(payload_text, event_payloads(iter([*lines, "data: {broken", "data: [DONE]", "data: {}"])))))
                assert replies[-1] == answer(StubChat(), text or "")
            yield pd.DataFrame({"doc_id": f.doc_id, "reply": replies})

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, reply string")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' ELSE 'system' END AS theme, CASE WHEN c_custkey % 5 < 3 THEN c_custkey % 5 / 2.0 ELSE 0.5 END::DOUBLE AS min_score,
c_name AS model, c_custkey % 2 = 0 AS telemetry FROM customer""")
def edited_settings(spark, d):
    """Settings of each customer, in places not valid, edited and parsed again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, name in zip(f.c_custkey, f.c_name, strict=True):
                text = f"theme = {('\"dark\"', '\"light\"', '\"pink\"', '3')[k % 4]}  # mine\nlist = [\n  [1],\n]\n[semantic]\nmin_score = {k % 5 / 2}\n[chat]\nmodel = \"\"\"\n[chat]\nmodel = 1\n\"\"\"\n"
                s = settings.parse(settings.edited(settings.edited(text, "chat.model", name), "telemetry.enabled", k % 2 == 0))
                rows.append((k, s.theme, s.semantic.min_score, s.chat.model, s.telemetry.enabled))
            yield pd.DataFrame(rows, columns=["c_custkey", "theme", "min_score", "model", "telemetry"])

    customers = table(spark, d, "customer")
    return customers.select("c_custkey", "c_name").mapInPandas(run, f"c_custkey {dict(customers.dtypes)['c_custkey']}, theme string, min_score double, model string, telemetry boolean")


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'run-0' ELSE 'run-1' END AS run_id, p_partkey || '.md' AS path, p_name AS content FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT 'run-0', 'source.md', 'the source of 0' UNION ALL SELECT 'run-1', 'source.md', 'the source of 1'""")
def staged_run_notes(spark, d):
    """The notes of two runs of three that were staged; one was written twice, one removed."""
    base = indexed.new_place(spark)
    p = table(spark, d, "part")
    for i in (1, 0, 1, 2):
        rows = p.where(F.col("p_partkey") % 3 == i).select(F.format_string("%s.md", F.col("p_partkey").cast("string")).alias("file_name"), F.col("p_name").alias("content"))
        runs.write_run(base, f"run-{i}", "source", f"the source of {i}", rows, {"n": i})
    runs.remove_run(spark, base, "run-2")
    each = [runs.notes(spark, base, x).select(F.lit(x).alias("run_id"), "path", "content") for x in runs.list_runs(spark, base)]
    return each[0].unionByName(each[1])


@query("SELECT 'files' AS name, count(*) AS n FROM nation UNION ALL SELECT 'chunks', -1 UNION ALL SELECT 'vectors', -1")
def dropped_layer(spark, d):
    """Rows of an index's tables after its semantic layer was dropped: none but the files are there, -1 stands for a missing one."""
    base, n = indexed.new_place(spark), table(spark, d, "nation").select(F.col("n_name").alias("path"))
    for name in ("files", "chunks", "vectors"):
        store.write_table(n, f"{base}/{name}")
    store.drop_tables(spark, base)
    counts = [store.read_table(spark, f"{base}/{x}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("name"), "n") if store.exists(spark, f"{base}/{x}") else spark.range(1).select(F.lit(x).alias("name"), F.lit(-1).cast("long").alias("n")) for x in ("files", "chunks", "vectors")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- queues, functions, layouts, streams ---------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id % 3 <> 0")
def unchunked_files(spark, d):
    docs = table(spark, d, "documents")
    return store.unchunked(docs.select(F.col("doc_id").cast("string").alias("path")), docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("file")))


@query("SELECT vec_id AS file, 0 AS ord, ((row_number() OVER (ORDER BY vec_id) - 1) // 32)::BIGINT AS batch FROM embeddings WHERE vec_id % 3 <> 0")
def pending_batches(spark, d):
    """The chunks that wait for a vector, in batches of 32."""
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("file"), F.lit(0).alias("ord"))
    return store.pending_batches(chunks, chunks.where("file % 3 = 0"))


@query("""SELECT p_partkey, 'links_to' AS relation, p_type AS object, p_name AS text FROM part UNION ALL SELECT p_partkey, 'brand', p_brand, p_name FROM part""")
def sql_table_functions(spark, d):
    """Triples and chunks of notes by table functions in SQL."""
    markdown.register(spark)
    content = F.concat(F.lit("# "), "p_name", F.lit("\n\nbrand:: "), "p_brand", F.lit("\n\n## x\n\n"), "p_name", F.lit("\n\n## y\n\n[["), "p_type", F.lit("]]\n"))
    notes = table(spark, d, "part").select("p_partkey", content.alias("content"))
    return spark.sql("SELECT p_partkey, t.relation, t.object, c.text FROM {notes}, LATERAL harvest_triples(CAST(p_partkey AS STRING), content) t, LATERAL chunk_markdown(content) c WHERE c.heading LIKE '% > x'", notes=notes)


@query(f"""WITH m AS (SELECT c_name AS id, c_nationkey AS community FROM customer), s AS (SELECT community, count(*) AS m FROM m GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY m DESC, community) - 1 AS g, count(*) OVER () AS k FROM s), small AS (SELECT least({layouts.W}, {layouts.H})::DOUBLE AS small),
c AS (SELECT community, m, {layouts.W} / 2.0 + CASE WHEN k = 1 THEN 0 ELSE 0.32 * small END * cos(2 * pi() * g / k - pi() / 2) AS cx, {layouts.H} / 2.0 + CASE WHEN k = 1 THEN 0 ELSE 0.32 * small END * sin(2 * pi() * g / k - pi() / 2) AS cy,
  CASE WHEN m = 1 THEN 0 WHEN k = 1 THEN least(0.38 * small, 0.05 * small * sqrt(m)) ELSE least(0.8 * 0.32 * small * sin(pi() / k), 0.05 * small * sqrt(m)) END AS r FROM r, small),
i AS (SELECT id, community, row_number() OVER (PARTITION BY community ORDER BY id) - 1 AS i FROM m)
SELECT id, i.community, round(cx + r * cos(2 * pi() * i / m - pi() / 2), 4) AS x, round(cy + r * sin(2 * pi() * i / m - pi() / 2), 4) AS y FROM i JOIN c USING (community)""")
def ring_of_groups(spark, d):
    """Customers in groups by nation, the groups on a ring."""
    groups = table(spark, d, "customer").select(F.col("c_name").alias("id"), F.col("c_nationkey").alias("community"))
    out = layouts.groups_layout(groups)
    return out.withColumns({c: F.round(c, 4) for c in ("x", "y")})


@query("""WITH e AS (SELECT value, epoch_us(ts)::BIGINT AS t FROM events), w AS (SELECT value, unnest(range(0, 5)) AS back, t FROM e)
SELECT strftime(make_timestamp((t // 60000000 - back) * 60000000), '%Y-%m-%d %H:%M:%S') AS start, count(value) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS worst FROM w GROUP BY 1""")
def streamed_windows(spark, d):
    """Windows of five minutes, one each minute, by a stream over the events that runs until all are read."""
    source = samples(spark, d).select(F.col("at").cast("timestamp").alias("at"), "ms")
    place = indexed.new_place(spark)
    source.write.parquet(f"{place}/in")
    stream = stream_telemetry.rolling_summary(spark.readStream.schema(source.schema).parquet(f"{place}/in"))
    out = f"{place}/out"

    def write(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(out)  # complete mode: each batch is the whole state

    q = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "mean", "worst")
    return rounded(rows, "mean", "worst")
