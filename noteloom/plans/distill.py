"""The distillation of converted documents: chunk, embed, cluster, extract, ground, merge, render.

All documents run at once; every step is a DataFrame step per document, so the group is a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import distill, markdown, vectors
from ..operators.workspace import grouped
from .chat import StubChat, answer

#: What a run tells of, in order.
PHASES = ("embed", "cluster", "extract", "ground", "merge", "emit")
CITATION = "struct<file:string,chunkId:bigint,start:bigint,end:bigint,quote:string>"
LINK = "struct<relation:string,target:string>"


@dataclass
class Run:
    """The tables of a run. cited: the extracted items of which a quote was found; they are merged into notes."""

    chunks: DataFrame
    clusters: DataFrame
    items: DataFrame
    each: DataFrame
    cited: DataFrame
    notes: DataFrame
    rendered: DataFrame
    observed: list[Observation]
    done: bool = False

    @property
    def phases(self) -> list[tuple[str, DataFrame]]:
        return list(zip(PHASES, (self.chunks, self.clusters, self.items, self.cited, self.notes, self.rendered), strict=True))

    def execute(self, progress: Callable[[str, int, int], None] | None = None) -> Run:
        """Computes the run, phase after phase, each from what the phases before have left; progress(phase, done, of) tells of each.

        Every table is computed once: a phase's rows are counted as they pass, in the pass that makes them.
        """
        if not self.done:
            for i, (phase, df) in enumerate(self.phases):
                self.rendered.sparkSession.sparkContext.setJobDescription(f"distill: {phase}")
                if progress:
                    progress(phase, i, len(self.phases))
                df.write.format("noop").mode("overwrite").save()
            self.rendered.sparkSession.sparkContext.setJobDescription(None)
            if progress:
                progress("done", len(self.phases), len(self.phases))
            self.done = True
        return self

    def stats(self) -> dict[str, int]:
        """The funnel, from chunks to notes, as it was observed in the passes."""
        self.execute()
        n = {k: v for o in self.observed for k, v in o.get.items()}
        return n | {"dropped": n["extracted"] - n["grounded"], "merged": n["grounded"] - n["notes"]}

    def ungrounded(self) -> DataFrame:
        """file, title of the items that were dropped because none of their quotes was found."""
        return self.each.join(self.cited.select("item_id"), "item_id", "left_anti").select("file", F.col("item.title").alias("title"))

    def release(self) -> None:
        for df in (self.chunks, self.clusters, self.items, self.each, self.cited, self.notes):
            df.unpersist()


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside, by this thread, end when another one calls cancel() with the tag."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def distill_documents(documents: DataFrame, ask: Callable[[str], str] | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, most: int = 1600) -> Run:
    """documents: path, content (Markdown)."""
    observed: list[Observation] = []

    def counted(df: DataFrame, **counts: Column) -> DataFrame:
        """df with counts of the rows that pass, kept for the later phases."""
        observed.append(Observation())
        return df.observe(observed[-1], *[c.alias(k) for k, c in counts.items()]).persist()

    rows = F.count(F.lit(1))
    ask = ask or (lambda p: answer(StubChat(), p))
    embed = embed or (lambda df: vectors.hashed_embedding(df, "embed_text"))
    chunks = counted(embed(markdown.chunks(documents, most)).withColumn("chunk_id", F.col("ord").cast("long")), chunks=rows)
    clusters = counted(distill.clusters(chunks), clusters=rows)
    items = counted(distill.extract(distill.prompts(clusters, chunks), ask), failed=F.count_if(~F.col("ok")))
    each = items.select("file", "cluster", F.posexplode("items").alias("nth", "item"))
    each = each.select(F.concat_ws("#", "file", F.col("cluster").cast("string"), F.col("nth").cast("string")).alias("item_id"), "file", "cluster", "nth", "item", F.col("item.evidence").alias("evidence"))
    each = counted(each, extracted=rows)
    keyed = each.select("item_id", "file", F.transform("evidence", lambda e: F.struct(F.concat_ws("#", F.col("file"), e["chunkId"].cast("string")).alias("chunkId"), e["quote"].alias("quote"))).alias("evidence"))
    source = chunks.select(F.concat_ws("#", "file", F.col("chunk_id").cast("string")).alias("chunk_id"), "file", F.col("chunk_id").alias("number"), "start", "text")
    grounded = distill.ground(keyed, source)
    number = F.element_at(F.split("chunk_id", "#"), -1).cast("long")
    cites = grounded.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.struct("file", number.alias("chunkId"), "start", "end", "quote").alias("c")))), lambda x: x["c"]).alias("citations"))
    cited = counted(each.join(cites, "item_id").select("file", "cluster", "nth", "item.kind", "item.title", "item.summary", "item.links", "citations", "item_id"), grounded=rows)

    def merge(t: pa.Table) -> list[dict]:
        rows = t.to_pylist()
        kept, _ = distill.dedup_notes([{k: r[k] for k in ("kind", "title", "summary", "links", "citations")} for r in rows])
        return [{"file": rows[0]["file"], "ord": i, **n} for i, n in enumerate(kept)]

    merged = grouped(cited.drop("item_id"), "file", ["cluster", "nth"], merge, f"file string, ord int, kind string, title string, summary string, links array<{LINK}>, citations array<{CITATION}>")
    notes = counted(merged, notes=rows)
    named = distill.unique_names(notes.withColumn("_o", F.struct("file", "ord")), order="_o").drop("_o")
    return Run(chunks, clusters, items, each, cited, notes, distill.render(named), observed)
