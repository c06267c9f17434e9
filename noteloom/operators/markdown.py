"""Markdown as rows: notes to titles and triples, chunks by heading, map outlines, citations, file trees.

Block structure is sequential within a note, so parsing runs per row in Arrow batches; each note is independent.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*))?$")
_KEY_SIGNS = frozenset("_ -")
_LIST = re.compile(r"^\s*(?:[-*+]|\d{1,9}[.)])\s+")
_QUOTE = re.compile(r"^(?: {0,3}> ?)+")
_SIGN = re.compile(r"\\|`+|\[\[")
_BRACKET = re.compile(r"[\[\]]")


def clean_target(inner: str) -> str:
    return inner.split("|")[0].split("#")[0].strip()


def heading_of(line: str) -> tuple[int, str] | None:
    """(level, text) of a line that starts with one to six # and white space."""
    text = line.lstrip("#")
    level = len(line) - len(text)
    return (level, text.strip()) if 1 <= level <= 6 and text[:1].isspace() else None


def field_of(line: str) -> tuple[str, str] | None:
    """(key, value) of a typed field, key:: value; the key starts with a letter, the value is not blank."""
    key, sign, value = line.partition("::")
    key, value = key.lstrip(" \t>").rstrip(), value.strip()
    plain = key.isascii() and key[:1].isalpha() and all(c.isalnum() or c in _KEY_SIGNS for c in key)
    return (key, value) if sign and plain and value else None


def code_lines(lines: list[str]) -> list[bool]:
    """Whether each line belongs to a fenced or an indented code block."""
    out, fence, paragraph, in_list = [], None, False, False
    for raw in lines:
        line = _QUOTE.sub("", raw)
        m = _FENCE.match(line)
        if fence:
            out.append(True)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence, paragraph = None, False
            continue
        if m and not ("`" in m[2] and m[1][0] == "`"):
            fence, paragraph = m[1], False
            out.append(True)
            continue
        blank = not line.strip()
        indented = line.startswith(("    ", "\t")) and not blank
        code = indented and not paragraph and not in_list
        out.append(code)
        in_list = bool(_LIST.match(line)) or in_list and (blank or line.startswith((" ", "\t")))
        paragraph = not blank and not code and not _HEADING.match(line)
    return out


def inline_links(text: str) -> list[str]:
    """Targets of [[...]] outside code spans and escapes, in order."""
    out, i = [], 0
    while m := _SIGN.search(text, i):
        i = m.start()
        if m[0] == "\\":
            i += 2
        elif m[0] != "[[":
            run = len(m[0])
            close = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(text, i + run)
            i = close.end() if close else i + run
        else:
            end = _BRACKET.search(text, i + 2)
            while end and end[0] == "]" and not text.startswith("]]", end.start()):
                end = _BRACKET.search(text, end.end())
            if end and end[0] == "]" and end.start() > i + 2:
                out.append(text[i + 2 : end.start()])
                i = end.start() + 2
            else:
                i += 1
    return out


def harvest_note(path: str, content: str) -> tuple[str, list[tuple[str, str, str]]]:
    """Title and triples: bare links in document order, then typed fields."""
    name = re.sub(r"(?i)\.md$", "", re.split(r"[/\\]", path)[-1])
    lines = content.split("\n")
    code, title, triples, block = code_lines(lines), "", [], []

    def flush() -> None:
        triples.extend((name, "links_to", clean_target(x)) for x in inline_links("\n".join(block)) if clean_target(x))
        block.clear()

    for raw, is_code in zip(lines, code, strict=True):
        line = _QUOTE.sub("", raw)
        m = _HEADING.match(line)
        if is_code or not line.strip() or m or _LIST.match(line):
            flush()
        if is_code:
            continue
        if m and len(m[1]) == 1 and not title:
            title = (m[2] or "").strip()
        block.append(line)
        if m:
            flush()
    flush()
    for key, value in filter(None, (field_of(raw) for raw, is_code in zip(lines, code, strict=True) if not is_code)):
        if len(value) > 4 and value.startswith("[[") and value.endswith("]]"):
            value = clean_target(value[2:-2])
        if value:
            triples.append((name, key, value))
    return title or name, triples


def harvest(notes: DataFrame) -> DataFrame:
    """path, title, text, triples(subject, relation, object) of notes (path, content)."""

    triples = pa.list_(pa.struct([(c, pa.string()) for c in ("subject", "relation", "object")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [harvest_note(p, c or "") for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True)]
            found = pa.array([[dict(zip(("subject", "relation", "object"), t, strict=True)) for t in x] for _, x in got], triples)
            yield pa.RecordBatch.from_arrays([b["path"], pa.array([t for t, _ in got], pa.string()), b["content"], found], ["path", "title", "text", "triples"])

    return notes.select("path", "content").mapInArrow(run, "path string, title string, text string, triples array<struct<subject:string,relation:string,object:string>>")


def triples_of(harvested: DataFrame) -> DataFrame:
    return harvested.select(F.col("path").alias("source_file"), F.explode("triples").alias("t")).select("t.subject", "t.relation", "t.object", "source_file")


def sections(content: str) -> Iterator[tuple[str, int, list[int]]]:
    """(heading path, start, ends of the lines) of what stands between headings; an end counts the line's break."""
    ends = list(accumulate(len(line) + 1 for line in content.split("\n")))
    path: dict[int, str] = {}
    first, inside = 0, []
    for start, end in zip([0, *ends], ends, strict=False):
        head = heading_of(content[start : end - 1])
        if head is None:
            inside.append(end)
            continue
        yield " > ".join(path[x] for x in sorted(path) if path[x]), first, inside
        path = {x: t for x, t in path.items() if x < head[0]} | {head[0]: head[1]}
        first, inside = end, []
    yield " > ".join(path[x] for x in sorted(path) if path[x]), first, inside


def chunk_markdown(content: str, most: int = 1600) -> list[tuple[str, int, int, str]]:
    """(heading path, start, end, text): lines under one heading, cut before the line that would exceed `most` characters.

    A cut needs text before it, so blank lines and a line longer than `most` stay whole.
    """
    out = []
    for heading, start, ends in sections(content):
        cuts, filled, at = [start], False, start
        for end in ends:
            if filled and end - cuts[-1] > most:
                cuts.append(at)
                filled = False
            filled, at = filled or not content[at:end].isspace() and at < len(content), end
        for x, y in pairwise([*cuts, min(at, len(content))]):
            if text := content[x:y].strip():
                out.append((heading, x, y, text))
    return out


#: Characters of notes whose chunks a Python worker hands over at once.
HANDED = 4 << 20


def chunks(notes: DataFrame, most: int = 1600) -> DataFrame:
    """file, ord, heading, start, end, text, embed_text of notes (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "ord", "heading", "start", "end", "text", "embed_text"]
        for f in frames:
            rows, size = [], 0
            for p, t in zip(f.path, f.content, strict=True):
                rows += [(p, i, *c, f"{c[0]}\n\n{c[3]}" if c[0] else c[3]) for i, c in enumerate(chunk_markdown(t or "", most))]
                size += len(t or "")
                if size >= HANDED:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return notes.select("path", "content").mapInPandas(run, "file string, ord int, heading string, start long, end long, text string, embed_text string")


def pieces(text: str) -> Iterator[tuple[bool, str]]:
    """(is a link, inner text) of the parts of text, in order; a link is [[ ]] around text without ]."""
    at = 0
    while (start := text.find("[[", at)) >= 0:
        end = text.find("]", start + 2)
        if end > start + 2 and text.startswith("]]", end):
            yield False, text[at:start]
            yield True, text[start + 2 : end]
            at = end + 2
        else:
            yield False, text[at : start + 1]
            at = start + 1
    yield False, text[at:]


def shown(text: str) -> str:
    """text with each link replaced by its alias, else its page."""
    alias = lambda x: (x.split("|")[1] if "|" in x else x.split("#")[0]).strip()
    return "".join(alias(x) if is_link else x for is_link, x in pieces(text))


def first_target(text: str) -> str | None:
    return next((clean_target(x) for is_link, x in pieces(text) if is_link), None)


def item_of(line: str) -> tuple[int, str] | None:
    """(indent, text) of a bullet."""
    text = line.lstrip()
    bullet = text[:1] in ("-", "*", "+") and text[1:2].isspace()
    return (len(line) - len(text), text[2:].strip()) if bullet else None


def relation_of(text: str) -> tuple[str, str, str] | None:
    """(source, relation, target) of a text of two links with words between them."""
    parts = list(pieces(text))
    links = [i for i, (is_link, _) in enumerate(parts) if is_link]
    if len(links) < 2 or links[0] != 1 or parts[0][1] or links[-1] != len(parts) - 2 or parts[-1][1]:
        return None
    middle = "".join(f"[[{x}]]" if is_link else x for is_link, x in parts[2:-2])
    if not (middle[:1].isspace() and middle[-1:].isspace() and middle.strip()):
        return None
    return clean_target(parts[1][1]), middle.strip(), clean_target(parts[-2][1])


def parse_map(content: str) -> tuple[str | None, list[tuple], list[tuple]]:
    """Title, nodes (id, parent id, place among siblings, depth, label, target) and edges (source, relation, target).

    Headings part the map; under one named edges, bullets are relations, elsewhere nodes. A node's parent is the
    nearest bullet above, under the same heading, with a smaller indent. A tab is two spaces.
    """
    lines = content.replace("\t", "  ").split("\n")
    heads = [heading_of(x) for x in lines]
    title = next((shown(h[1]) for h in heads if h and h[0] == 1), None)
    part = list(accumulate(h is not None for h in heads))
    of_edges = {p for p, h in zip(part, heads, strict=True) if h and h[1].lower() == "edges"}
    items = [(p, *item) for p, h, item in zip(part, heads, map(item_of, lines), strict=True) if item and not h]
    edges = [e for p, _, text in items if p in of_edges and (e := relation_of(text))]
    outline = [x for x in items if x[0] not in of_edges]
    parents: list[int | None] = []
    for i, (p, indent, _) in enumerate(outline):
        above = i - 1 if i else None
        while above is not None and (outline[above][0] != p or outline[above][1] >= indent):
            above = parents[above] if outline[above][0] == p else None
        parents.append(above)
    nodes, siblings, depths = [], Counter(), []
    for i, (parent, (_, _, text)) in enumerate(zip(parents, outline, strict=True)):
        depths.append(0 if parent is None else depths[parent] + 1)
        nodes.append((i, parent, siblings[parent], depths[i], shown(text), first_target(text)))
        siblings[parent] += 1
    return title, nodes, edges


def map_nodes(maps: DataFrame) -> DataFrame:
    """path, title, node_id, parent_id, ord, depth, label, target of maps (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, t, *n) for p, c in zip(f.path, f.content, strict=True) for t, ns, _ in [parse_map(c or "")] for n in ns]
            yield pd.DataFrame(rows, columns=["path", "title", "node_id", "parent_id", "ord", "depth", "label", "target"]).astype({"parent_id": "Int64"})

    return maps.select("path", "content").mapInPandas(run, "path string, title string, node_id long, parent_id long, ord long, depth long, label string, target string")


def map_edges(maps: DataFrame) -> DataFrame:
    """path, source, relation, target of the edge sections of maps (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *e) for p, c in zip(f.path, f.content, strict=True) for e in parse_map(c or "")[2]]
            yield pd.DataFrame(rows, columns=["path", "source", "relation", "target"])

    return maps.select("path", "content").mapInPandas(run, "path string, source string, relation string, target string")


def citations(notes: DataFrame) -> DataFrame:
    """path, source, chunk, start, end of the spans in the front matter of notes (path, content); spans must not be empty."""
    front = F.regexp_extract("content", r"^---\n([\s\S]*?)\n---", 1)
    source = F.regexp_replace(F.trim(F.split_part(F.regexp_extract(front, r"(?m)^source:\s*(.+)$", 1), F.lit(","), F.lit(1))), r"(?i)\.md$", "")
    item = r"-\s*chunk:\s*(\d+)\s*\n\s*span:\s*(\d+)-(\d+)"
    parts = F.arrays_zip(*[F.regexp_extract_all(front, F.lit(item), F.lit(i)).alias(n) for i, n in ((1, "chunk"), (2, "start"), (3, "end"))])
    rows = notes.select("path", source.alias("source"), F.explode(parts).alias("c"))
    return rows.select("path", "source", *[F.col(f"c.{n}").cast("long").alias(n) for n in ("chunk", "start", "end")]).where("end > start and source <> ''")


def external_links(notes: DataFrame) -> DataFrame:
    """path, label, url of [label](url) and <url> links of notes (path, content)."""
    named = notes.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(r"(?<!!)\[([^\]\[]+)\]\((https?://[^\s)]+)"), F.lit(1)).alias("label"), F.regexp_extract_all("content", F.lit(r"(?<!!)\[([^\]\[]+)\]\((https?://[^\s)]+)"), F.lit(2)).alias("url"))).alias("x")).select("path", "x.label", "x.url")
    bare = notes.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"<(https?://[^\s>]+)>"), F.lit(1))).alias("url")).select("path", F.col("url").alias("label"), "url")
    return named.unionByName(bare)


def file_tree(files: DataFrame) -> DataFrame:
    """folder, name, files, folders for each folder above files (rel): folders with no file and one folder are merged into it.

    name is the merged path below the nearest kept folder; files and folders are what the row's last folder holds.
    """
    segments = F.split("rel", "/")
    paths = files.where(F.size(segments) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(segments) - 1), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"))).alias("folder")).distinct()
    direct = files.where(F.size(segments) > 1).groupBy(F.regexp_replace("rel", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("files"))
    subs = paths.where(F.col("folder").contains("/")).groupBy(F.regexp_replace("folder", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("folders"))
    counted = paths.join(direct, "folder", "left").join(subs, "folder", "left").select("folder", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("folders", F.lit(0)).alias("folders"))
    kept = counted.where((F.col("files") > 0) | (F.col("folders") != 1))
    # the nearest kept ancestor of each kept folder
    parts = F.split("folder", "/")
    up = kept.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("above"))
    near = up.join(kept.select(F.col("folder").alias("above")), "above").groupBy("folder").agg(F.max_by("above", F.length("above")).alias("parent"))
    out = kept.join(near, "folder", "left")
    name = F.when(F.col("parent").isNull(), F.col("folder")).otherwise(F.expr("substring(folder, length(parent) + 2)"))
    return out.select("folder", F.coalesce("parent", F.lit("")).alias("parent"), name.alias("name"), "files", "folders")


def register(spark: SparkSession) -> None:
    """SQL table functions harvest_triples(path, content), chunk_markdown(content) and map_outline(content)."""

    @udtf(returnType="subject string, relation string, object string")
    class HarvestTriples:
        def eval(self, path: str, content: str):
            yield from harvest_note(path, content or "")[1]

    @udtf(returnType="heading string, start long, end long, text string")
    class ChunkMarkdown:
        def eval(self, content: str):
            yield from chunk_markdown(content or "")

    @udtf(returnType="node_id long, parent_id long, ord long, depth long, label string, target string")
    class MapOutline:
        def eval(self, content: str):
            yield from parse_map(content or "")[1]

    for name, f in (("harvest_triples", HarvestTriples), ("chunk_markdown", ChunkMarkdown), ("map_outline", MapOutline)):
        spark.udtf.register(name, f)


def note_spans(content: str) -> list[tuple[int, int, str, str | None, int | None]]:
    """(start, end, kind, target, level) of headings, code spans, links, emphasis outside code blocks, by start; of overlapping ones the first stays."""
    kinds = (
        ("heading", re.compile(r"^ {0,3}(#{1,6})[ \t]+\S.*$")), ("code", re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")), ("wikilink", re.compile(r"\[\[([^\[\]]+)\]\]")), ("link", re.compile(r"(?<!!)\[([^\[\]]+)\]\(([^\s)]+)\)")),
        ("url", re.compile(r"<(https?://[^\s>]+)>")), ("strong", re.compile(r"\*\*(?=\S)(.+?)(?<=\S)\*\*")), ("emphasis", re.compile(r"(?<![*\w])([*_])(?=[^\s*_])(.+?)(?<=[^\s*_])\1(?![*\w])")),
    )
    out, at, lines = [], 0, content.split("\n")
    for line, code in zip(lines, code_lines(lines), strict=True):
        taken = 0
        found = [] if code else sorted((m.start(), -m.end(), i, m) for i, (_, p) in enumerate(kinds) for m in p.finditer(line))
        for s, e, i, m in found:
            kind = kinds[i][0]
            if kind == "heading":
                out.append((at + s, at - e, kind, None, len(m[1])))
            elif s >= taken:
                target = {"wikilink": lambda m: clean_target(m[1]), "link": lambda m: m[2], "url": lambda m: m[1]}.get(kind, lambda m: None)(m)
                out.append((at + s, at - e, kind, target, None))
                taken = -e
        at += len(line) + 1
    return out


def spans(notes: DataFrame) -> DataFrame:
    """path, start, end, kind, target, level of notes (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *s) for p, c in zip(f.path, f.content, strict=True) for s in note_spans(c or "")]
            yield pd.DataFrame(rows, columns=["path", "start", "end", "kind", "target", "level"]).astype({"level": "Int64"})

    return notes.select("path", "content").mapInPandas(run, "path string, start long, end long, kind string, target string, level long")
