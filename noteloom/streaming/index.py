"""A vault index kept up to date: each micro-batch of notes replaces its rows in the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import markdown, store, text_index
from ..sources import vault


def apply_batch(batch: DataFrame, base: str) -> None:
    """notes (path, content, mtime): the latest row of a path wins; null content deletes. Repeating a batch changes nothing.

    Only the buckets of the tables that hold one of the batch's paths are written anew; the text indexes of notes and
    chunks get the batch's postings, and changed notes lose their vectors, so that their chunks are pending again. The
    table of files comes last: it says what the index has seen, so a batch that ended before it is done again.
    """
    last = batch.withColumn("_nth", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("mtime")))).where("_nth = 1").drop("_nth").persist()
    here = last.where("content is not null")
    harvested = markdown.harvest(here).persist()
    chunks = markdown.chunks(here).withColumn("path", F.col("file")).persist()
    store.update_table(f"{base}/triples", markdown.triples_of(harvested).withColumn("path", F.col("source_file")), last)
    store.update_table(f"{base}/chunks", chunks, last)
    if store.exists(last.sparkSession, f"{base}/vectors"):
        vectors = store.read_table(last.sparkSession, f"{base}/vectors")
        store.update_table(f"{base}/vectors", vectors.limit(0), last)
    files = last.select(F.col("path").alias("file"))
    notes = here.join(harvested.select("path", "title"), "path").select(F.col("path").alias("key"), "title", F.col("content").alias("body"))
    text_index.update(f"{base}/text", notes, files)
    text_index.update(f"{base}/chunk_text", chunks.select(chunk_key().alias("key"), "file", F.lit("").alias("title"), F.col("text").alias("body")), files)
    store.update_table(f"{base}/files", harvested.select("path", "title").join(here.select("path", "mtime"), "path"), last)
    chunks.unpersist()
    harvested.unpersist()
    last.unpersist()


def chunk_key() -> Column:
    """What the text index of chunks calls a chunk of the columns file and ord."""
    return F.concat_ws("#", "file", F.col("ord").cast("string"))


def pending(spark: SparkSession, base: str) -> DataFrame:
    """The chunks of the index below base that have no vector."""
    chunks = store.read_table(spark, f"{base}/chunks")
    return store.pending(chunks, store.read_table(spark, f"{base}/vectors")) if store.exists(spark, f"{base}/vectors") else chunks


def put_vectors(base: str, embedded: DataFrame) -> None:
    """Stores vectors of chunks (file, ord, embedding) of whole files: all vectors that a file has so far are replaced."""
    rows = embedded.select("file", "ord", "embedding", F.col("file").alias("path"))
    store.update_table(f"{base}/vectors", rows, rows.select("path").distinct())


def indexed_files(spark: SparkSession, base: str) -> DataFrame:
    """path, mtime of the notes in the index; none before the first batch."""
    try:
        return store.read_table(spark, f"{base}/files").select("path", "mtime")
    except FileNotFoundError:
        return spark.createDataFrame([], "path string, mtime long")


def refresh(spark: SparkSession, root: str, base: str, settle_ms: int = 150) -> int:
    """Brings the index below base up to the vault's files: new, modified and deleted ones. Returns how many notes changed."""
    changed = vault.changes(spark, root, indexed_files(spark, base), settle_ms).persist()
    n = changed.count()
    if n:
        apply_batch(changed, base)
    changed.unpersist()
    return n


def rename(spark: SparkSession, root: str, base: str, old: str, new: str) -> None:
    """Moves a note, or a folder with all below it, in the vault and in the index; names that links use follow the new path."""
    if not (vault.inside(old) and vault.inside(new)):
        raise ValueError("both paths must stay in the vault")
    below = (F.col("path") == old) | F.col("path").startswith(old + "/")
    gone = indexed_files(spark, base).where(below).select("path", F.lit(None).cast("string").alias("content"), "mtime").persist()
    gone.count()  # before the files move
    vault.move(spark, root, old, new)
    moved = vault.notes(spark, root).where((F.col("path") == new) | F.col("path").startswith(new + "/"))
    apply_batch(gone.unionByName(moved), base)
    gone.unpersist()


def watch(spark: SparkSession, root: str, base: str, checkpoint: str, seconds: int = 1, changed: Callable[[int], None] | None = None) -> StreamingQuery:
    """A streaming query that refreshes the index at every tick and tells `changed` how many notes have changed, if any."""

    def tick(_: DataFrame, __: int) -> None:
        n = refresh(spark, root, base)
        if n and changed:
            changed(n)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()


def start(notes: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """A streaming query over notes (path, content, mtime) that keeps files, triples and chunks below base."""
    return notes.writeStream.foreachBatch(lambda df, _: apply_batch(df, base)).option("checkpointLocation", checkpoint).outputMode("append").start()
