"""From chunks of documents to grounded notes: clustering, extraction, grounding, merging and rendering."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, collapsed, note_name, relation_name, trigram_similarity
from .vectors import matrix
from .workspace import grouped

KINDS = ("concept", "claim", "entity", "event", "definition", "quote")
ITEM = "struct<kind:string,title:string,summary:string,evidence:array<struct<chunkId:bigint,quote:string>>,links:array<struct<relation:string,target:string>>>"


def cluster_count(n: int, per: int = 8, least: int = 4, most: int = 24) -> int:
    return 0 if n <= 0 else min(n, max(least, min(most, -(-n // per))))


def kmeans(ids: list, vectors: np.ndarray, k: int, iterations: int = 20, representatives: int = 4) -> list[tuple[list, list]]:
    """(members, representatives) of each cluster, by least member.

    Seeds: the least id, then always the point farthest from all seeds. Ties go to the first. A cluster that loses
    all points restarts at the worst served one.
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    ids, x = [ids[i] for i in order], np.asarray(vectors, np.float32)[order].astype(float)
    if k <= 0 or not ids:
        return []
    if k >= len(ids):
        return [([i], [i]) for i in ids]
    seeds, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(seeds) < k:
        seeds.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[seeds[-1]]) ** 2).sum(1))
    c, label = x[seeds].copy(), np.full(len(x), -1)
    for _ in range(iterations):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        new = d.argmin(1)
        changed = bool((new != label).any())
        label = new
        counts = np.bincount(label, minlength=k)
        for j in range(k):
            if counts[j]:
                c[j] = x[label == j].mean(0).astype(np.float32)
        for j in range(k):
            if not counts[j]:
                worst = int(((x - c[label]) ** 2).sum(1).argmax())
                c[j], label[worst], changed = x[worst], j, True
        if not changed:
            break
    out = []
    for j in range(k):
        members = np.flatnonzero(label == j)
        if len(members):
            far = ((x[members] - c[j]) ** 2).sum(1)
            out.append(([ids[i] for i in members], [ids[members[i]] for i in np.lexsort((members, far))[:representatives]]))
    return sorted(out, key=lambda p: p[0][0])


def clusters(chunks: DataFrame, by: str = "file", k: int | None = None, representatives: int = 4) -> DataFrame:
    """by, cluster, members, representatives of chunks (by, chunk_id, embedding): a worker holds the vectors of one document, and of a batch."""
    kind = dict(chunks.dtypes)[by]

    def run(t: pa.Table) -> list[dict]:
        got = kmeans(t["chunk_id"].to_pylist(), matrix(t["embedding"].combine_chunks()), cluster_count(len(t)) if k is None else k, representatives=representatives)
        key = t[by][0].as_py()
        return [{by: key, "cluster": i, "members": m, "representatives": r} for i, (m, r) in enumerate(got)]

    rows = chunks.select(by, "chunk_id", "embedding")
    return grouped(rows, by, ["chunk_id"], run, f"{by} {kind}, cluster int, members array<long>, representatives array<long>")


def prompts(cluster_rows: DataFrame, chunks: DataFrame, by: str = "file") -> DataFrame:
    """by, cluster, prompt: the representatives' texts as numbered blocks."""
    reps = cluster_rows.select(by, "cluster", F.posexplode("representatives").alias("nth", "chunk_id"))
    text = reps.join(chunks.select(by, "chunk_id", "heading", "text"), [by, "chunk_id"])
    block = F.concat(F.lit("[chunk "), F.col("chunk_id").cast("string"), F.lit("] "), F.coalesce("heading", F.lit("")), F.lit("\n"), F.col("text"))
    return text.groupBy(by, "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("prompt"))


def parse_extraction(reply: str | None) -> tuple[bool, list[dict]]:
    """Whether a model's reply holds an object with an items list, and its usable items."""
    text = reply or ""
    a, b = text.find("{"), text.rfind("}")
    try:
        items = json.loads(text[a : b + 1]).get("items") if 0 <= a < b else None
    except (ValueError, AttributeError):
        return False, []
    if not isinstance(items, list):
        return False, []

    def number(v) -> int | None:
        try:
            x = float(v)
        except (TypeError, ValueError):
            return None
        return int(x) if not isinstance(v, bool) and x.is_integer() else None  # no chunk has a broken number

    out = []
    for x in items:
        title = x.get("title") if isinstance(x, dict) else None
        if not isinstance(title, str) or not title.strip():
            continue
        evidence = [{"chunkId": number(e.get("chunkId")), "quote": e.get("quote")} for e in x.get("evidence") or [] if isinstance(e, dict)]
        links = [{"relation": y.get("relation"), "target": y.get("target")} for y in x.get("links") or [] if isinstance(y, dict)]
        out.append(
            {
                "kind": x.get("kind") if x.get("kind") in KINDS else "concept", "title": title.strip(), "summary": x["summary"].strip() if isinstance(x.get("summary"), str) else "",
                "evidence": [e for e in evidence if e["chunkId"] is not None and isinstance(e["quote"], str) and e["quote"].strip()],
                "links": [y for y in links if all(isinstance(v, str) and v.strip() for v in y.values())],
            }
        )
    return True, out


#: What a model is told before the chunks: the form of its answer, and that only quoted things count.
RULE = f"""From the numbered chunks below, take notes that the chunks themselves prove. Reply with one JSON object and nothing else:
{{"items": [{{"kind": one of {", ".join(KINDS)}, "title": a short name, "summary": one or two sentences,
"evidence": [{{"chunkId": the chunk's number, "quote": words exactly as they stand in that chunk}}],
"links": [{{"relation": how it relates, for example about, supports, contrasts_with, part_of, "target": the title of another item}}]}}]}}
Every item needs at least one quote, letter for letter. Leave out whatever you can't quote."""


def extract(prompt_rows: DataFrame, ask: Callable[[str], str], by: str = "file", rule: str = RULE) -> DataFrame:
    """by, cluster, ok, items: the model's reply to the rule and each prompt, asked once more if it can't be parsed."""
    kind = dict(prompt_rows.dtypes)[by]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for p in f.prompt:
                p = f"{rule}\n\n{p}" if rule else p
                ok, items = parse_extraction(reply := ask(p))
                if not ok:
                    ok, items = parse_extraction(ask(f"{p}\n\nAnswer with JSON only. The last answer was:\n{reply[:800]}"))
                got.append((ok, items))
            yield pd.DataFrame({by: f[by], "cluster": f.cluster, "ok": [g[0] for g in got], "items": [g[1] for g in got]})

    return prompt_rows.mapInPandas(run, f"{by} {kind}, cluster int, ok boolean, items array<{ITEM}>")


def locate(source: Column, quote: Column) -> Column:
    """struct(start, end) of quote in source, from 0, with any white space for white space; null if it is not there or blank."""
    q = F.trim(quote)
    exact = F.instr(source, q) - 1
    pattern = F.regexp_replace(F.regexp_replace(q, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1"), r"(?U)\s+", r"(?U:\\s+)")
    found = F.regexp_substr(source, pattern)
    loose = F.instr(source, found) - 1
    span = lambda at, n: F.struct(at.cast("long").alias("start"), (at + n).cast("long").alias("end"))
    return F.when(F.coalesce(q, F.lit("")) == "", None).when(exact >= 0, span(exact, F.length(q))).when(found.isNotNull() & (found != ""), span(loose, F.length(found)))


def ground(items: DataFrame, chunks: DataFrame, exact_spans: bool = False) -> DataFrame:
    """item_id, file, start, end, chunk_id, quote: the located evidence of items (item_id, evidence) in chunks (chunk_id, file, start, text).

    An item without any located quote is ungrounded: it has no row. exact_spans shifts spans by what trimming took
    from the chunk's front, if chunks has lead (the number of trimmed characters).
    """
    e = items.select("item_id", F.posexplode("evidence").alias("nth", "e")).select("item_id", "nth", F.col("e.chunkId").alias("chunk_id"), F.col("e.quote").alias("quote"))
    both = e.join(chunks, "chunk_id").withColumn("at", locate(F.col("text"), F.col("quote"))).where("at is not null")
    lead = F.col("lead") if exact_spans and "lead" in chunks.columns else F.lit(0)
    start = F.col("start") + lead
    text = F.substring("text", (F.col("at.start") + 1).cast("int"), (F.col("at.end") - F.col("at.start")).cast("int"))
    return both.select("item_id", "nth", "file", "chunk_id", (start + F.col("at.start")).alias("start"), (start + F.col("at.end")).alias("end"), text.alias("quote"))


def dedup_notes(notes: list[dict], title_threshold: float = 0.6, similarity: Callable[[dict, dict], float] | None = None, hook_threshold: float = 0.9) -> tuple[list[dict], int]:
    """Notes merged in order into the first group they match, and how many were merged away.

    A match: alike titles, overlapping citations of one file, or a high similarity hook. The better cited title leads;
    citations and links are united.
    """

    def grams(t: str) -> set[str]:
        t = f"  {t.strip().lower()} "
        return {t[i : i + 3] for i in range(len(t) - 2)} if t.strip() else set()

    own = [grams(n["title"]) for n in notes]
    holders: dict[str, list[int]] = {}  # notes by a trigram of their title, and by a file they cite
    citing: dict[str, list[tuple[int, int, int]]] = {}
    groups: list[list[dict]] = []
    group_of: list[int] = []
    for i, n in enumerate(notes):
        common = Counter(j for g in own[i] for j in holders.get(g, ()))
        alike = {j for j, c in common.items() if c / (len(own[i]) + len(own[j]) - c) >= title_threshold}
        if not own[i] or title_threshold <= 0:
            alike |= {j for j in range(i) if not own[j] or title_threshold <= 0}
        alike |= {j for c in n["citations"] for j, start, end in citing.get(c["file"], ()) if c["start"] < end and start < c["end"]}
        if similarity:
            alike |= {j for j in range(i) if similarity(notes[j], n) >= hook_threshold}
        home = min((group_of[j] for j in alike), default=len(groups))
        if home == len(groups):
            groups.append([])
        groups[home].append(n)
        group_of.append(home)
        for g in own[i]:
            holders.setdefault(g, []).append(i)
        for c in n["citations"]:
            citing.setdefault(c["file"], []).append((i, c["start"], c["end"]))
    out = []
    for g in groups:
        lead = max(enumerate(g), key=lambda p: (len(p[1]["citations"]), -p[0]))[1]
        cites = {(c["file"], c["chunkId"], c["start"], c["end"]): c for m in g for c in m["citations"]}
        links = {(x["relation"], x["target"]): x for m in g for x in m["links"]}
        out.append({**lead, "citations": list(cites.values()), "links": list(links.values())})
    return out, len(notes) - len(out)


def similar_titles(titles: DataFrame, threshold: float = 0.6) -> DataFrame:
    """a, b, similarity of distinct titles (a < b) at or above threshold.

    Similar titles share a trigram among the first of their prefixes (rarest first), so the pairs come from an
    equi-join on those trigrams.
    """
    from ..functions.text import trigrams

    d = titles.select("title").where(F.col("title").isNotNull()).distinct()
    g = d.select("title", F.explode(trigrams(F.col("title"))).alias("g"))
    df = g.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("title").orderBy("df", "g")
    ranked = g.join(df, "g").withColumn("nth", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("title")))
    p = ranked.where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    pairs = p.select(F.col("title").alias("a"), "g").join(p.select(F.col("title").alias("b"), "g"), "g").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("similarity", trigram_similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= threshold)


def unique_names(notes: DataFrame, title: str = "title", order: str = "ord") -> DataFrame:
    """notes with name: safe, and numbered from the second note of a name on (any case), in order."""
    base = note_name(F.col(title))
    nth = F.row_number().over(Window.partitionBy(F.lower(base)).orderBy(order))
    return notes.withColumn("name", F.when(nth == 1, base).otherwise(F.concat_ws(" ", base, nth.cast("string"))))


def render(notes: DataFrame) -> DataFrame:
    """name, file_name, content of notes (name, kind, summary, links, citations): front matter, heading, fields, summary, quotes."""
    c = F.coalesce("citations", F.array().cast("array<struct<file:string,chunkId:bigint,start:bigint,end:bigint,quote:string>>"))
    sources = F.array_distinct(F.transform(c, lambda x: basename(x["file"])))
    cites = F.transform(c, lambda x: F.concat(F.lit("  - chunk: "), x["chunkId"].cast("string"), F.lit("\n    span: "), x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    some = lambda cond, a: F.when(cond, a).otherwise(F.array().cast("array<string>"))
    front = F.array_join(F.concat(F.array(F.lit("---"), F.concat(F.lit("kind: "), F.col("kind"))), some(F.size(sources) > 0, F.array(F.concat(F.lit("source: "), F.array_join(sources, ", ")))), some(F.size(c) > 0, F.concat(F.array(F.lit("cite:")), cites)), F.array(F.lit("---"))), "\n")
    link = F.filter(F.transform("links", lambda x: F.struct(relation_name(x["relation"]).alias("r"), note_name(x["target"]).alias("t"))), lambda x: x["r"] != "")
    fields = F.concat(F.transform(sources, lambda s: F.concat(F.lit("source:: [["), s, F.lit("]]"))), F.transform(F.coalesce(link, F.array().cast("array<struct<r:string,t:string>>")), lambda x: F.concat(x["r"], F.lit(":: [["), x["t"], F.lit("]]"))))
    quotes = F.transform(F.array_distinct(F.transform(c, lambda x: collapsed(x["quote"]))), lambda q: F.concat(F.lit("> "), q))
    body = F.concat(
        F.array(front, F.lit(""), F.concat(F.lit("# "), F.col("name")), F.lit("")), some(F.size(fields) > 0, F.array(F.array_join(fields, "\n"), F.lit(""))),
        some(F.coalesce("summary", F.lit("")) != "", F.array(F.coalesce("summary", F.lit("")), F.lit(""))), quotes,
    )
    content = F.concat(F.regexp_replace(F.regexp_replace(F.array_join(body, "\n"), r"\n{3,}", "\n\n"), r"\s+$", ""), F.lit("\n"))
    return notes.select("name", F.concat("name", F.lit(".md")).alias("file_name"), content.alias("content"))
