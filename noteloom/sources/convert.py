"""Documents to Markdown: PDF pages, EPUB sections, and text files as they are."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from posixpath import dirname, join, normpath
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

TEXT = (".md", ".markdown", ".txt", ".text")


class _Markdown(HTMLParser):
    """Headings, paragraphs, list items, code blocks, links and emphasis of a page's body."""

    BLOCKS = {"p", "div", "section", "article", "blockquote", "ul", "ol", "table", "tr", "pre", "br"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.code: list[str] = []  # texts of pre elements, whose lines stay
        self.skip, self.head, self.pre = 0, False, False
        self.links, self.lists = [], []

    def handle_starttag(self, tag, attrs):
        heading = re.fullmatch("h[1-6]", tag)
        if tag == "body" or heading or tag in self.BLOCKS:
            self.head = False  # a head ends where the body begins, whether it is closed or not
        if tag == "head":
            self.head = True
        elif tag in ("script", "style"):
            self.skip += 1
        elif heading:
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                self.out.append(f"\n{self.lists[-1]}. ")
            else:
                self.out.append("\n- ")
        elif tag == "pre":
            self.pre = True
            self.code.append("")
            self.out.append(f"\n\n\0{len(self.code) - 1}\0\n\n")
        elif tag in self.BLOCKS:
            if tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ol" else None)
            self.out.append("\n" if tag == "br" else "\n\n")
        elif self.pre:
            return
        elif tag in ("em", "i", "strong", "b"):
            self.out.append("_" if tag in ("em", "i") else "**")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self.out.append("[" if self.links[-1] else "")

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        elif tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "pre":
            self.pre = False
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCKS - {"br"}:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.out.append("\n\n")
        elif self.pre:
            return
        elif tag in ("em", "i", "strong", "b"):
            self.out.append("_" if tag in ("em", "i") else "**")
        elif tag == "a" and self.links:
            url = self.links.pop()
            self.out.append(f"]({url})" if url else "")

    def handle_data(self, data):
        if self.skip or self.head:
            return
        if self.pre:
            self.code[-1] += data
        else:
            self.out.append(re.sub(r"\s+", " ", data.replace("\0", "")))


def html_to_markdown(html: str) -> str:
    p = _Markdown()
    p.feed(html or "")
    p.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.out))
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return re.sub("\0(\\d+)\0", lambda m: "```\n" + p.code[int(m[1])].strip("\r\n") + "\n```", text)


def epub_to_markdown(data: bytes) -> str:
    """Sections in spine order, numbered over those with text."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        try:
            container = ElementTree.fromstring(z.read("META-INF/container.xml"))
            opf = next(e.get("full-path") for e in container.iter() if local(e) == "rootfile")
            package = ElementTree.fromstring(z.read(opf))
        except (KeyError, StopIteration, ElementTree.ParseError) as e:
            raise ValueError("not a valid EPUB: no package document") from e
        hrefs = {e.get("id"): unquote((e.get("href") or "").split("#")[0]) for e in package.iter() if local(e) == "item"}
        parts = []
        for ref in (e.get("idref") for e in package.iter() if local(e) == "itemref"):
            name = normpath(join(dirname(opf), hrefs.get(ref) or ""))
            if ref in hrefs and name in z.namelist():
                body = html_to_markdown(z.read(name).decode("utf-8", "replace"))
                if body:
                    parts.append(f"## Section {len(parts) + 1}\n\n{body}")
    if not parts:
        raise ValueError("the EPUB has no text")
    return "\n\n".join(parts) + "\n"


def _pdf_strings(content: bytes) -> str:
    """The text that a page's content stream shows: string operands of Tj, TJ, ' and ", lines at text moves."""
    out: list[str] = []
    token = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|\[|\]|T[dDmjJ*]|ET|['\"]|-?\d+(?:\.\d+)?")
    held, in_array = [], False
    for m in token.finditer(content):
        t = m[0]
        if t.startswith(b"("):
            s = re.sub(rb"\\([0-7]{1,3})", lambda x: bytes([int(x[1], 8) & 255]), t[1:-1])
            s = re.sub(rb"\\(.)", lambda x: {b"n": b"\n", b"r": b"", b"t": b"\t"}.get(x[1], x[1]), s)
            held.append(s.decode("latin-1"))
        elif t.startswith(b"<"):
            held.append(bytes.fromhex(re.sub(rb"\s", b"", t[1:-1]).decode().ljust(2, "0")).decode("latin-1"))
        elif t == b"[":
            in_array = True
        elif t == b"]":
            in_array = False
        elif in_array and re.fullmatch(rb"-?\d+(?:\.\d+)?", t):
            if float(t) < -200:
                held.append(" ")
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            out += (["\n"] if t in (b"'", b'"') else []) + held
            held = []
        elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
    return "\n".join(" ".join(x.split()) for x in "".join(out).split("\n") if x.strip())


def _pdf_stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\nendstream", body, re.S)
    if not m:
        return b""
    try:
        return zlib.decompress(m[1]) if b"FlateDecode" in body[: m.start()] else m[1]
    except zlib.error:
        return b""


def _pdf_objects(data: bytes) -> dict[int, bytes]:
    """The objects of a file by number, those inside of object streams too; the last version of a number counts."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}
    for body in list(objects.values()):
        first = re.search(rb"/First\s+(\d+)", body)
        if first and re.search(rb"/Type\s*/ObjStm\b", body):
            packed = _pdf_stream(body)
            numbers = [int(x) for x in packed[: int(first[1])].split()]
            places = [int(first[1]) + x for x in numbers[1::2]] + [len(packed)]
            for number, a, z in zip(numbers[::2], places, places[1:], strict=False):
                objects.setdefault(number, packed[a:z])
    return objects


def _pdf_pages(objects: dict[int, bytes]) -> list[bytes]:
    """The pages in reading order, which is that of the page tree; without a tree that of the file."""
    refs = lambda body, key: [int(r) for r in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if (m := re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)) else []
    is_page = lambda body: re.search(rb"/Type\s*/Page\b(?!s)", body)
    roots = [r for body in objects.values() if re.search(rb"/Type\s*/Catalog\b", body) for r in refs(body, b"Pages")]
    pages, todo, seen = [], roots[-1:], set()
    while todo:
        number = todo.pop(0)
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        if is_page(body):
            pages.append(body)
        todo = refs(body, b"Kids") + todo
    return pages or [body for body in objects.values() if is_page(body)]


def pdf_to_markdown(data: bytes) -> str:
    """A section per page with text. Reads plain and deflated content and object streams, and simple fonts."""
    objects = _pdf_objects(data)
    parts = []
    for number, body in enumerate(_pdf_pages(objects), 1):
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        text = "\n".join(_pdf_strings(_pdf_stream(objects.get(int(r), b""))) for r in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])) if refs else ""
        if text.strip():
            parts.append(f"## Page {number}\n\n{text.strip()}")
    if not parts:
        raise ValueError("the PDF has no text")
    return "\n\n".join(parts) + "\n"


def convert_bytes(path: str, data: bytes) -> str:
    ending = re.search(r"\.[^./\\]*$", path.lower())
    if ending and ending[0] in TEXT:
        return data.decode("utf-8", "replace")
    if ending and ending[0] == ".pdf":
        return pdf_to_markdown(data)
    if ending and ending[0] == ".epub":
        return epub_to_markdown(data)
    raise ValueError(f"unsupported document: {path}")


def convert(files: DataFrame) -> DataFrame:
    """path, content, error of files (path, content binary): one of content and error is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, d in zip(f.path, f.content, strict=True):
                try:
                    rows.append((p, convert_bytes(p, bytes(d)), None))
                except (ValueError, zipfile.BadZipFile) as e:
                    rows.append((p, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content string, error string")


def html_pages(pages: DataFrame) -> DataFrame:
    """page_id, markdown of pages (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"page_id": f.page_id, "markdown": [html_to_markdown(h) for h in f.html]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, markdown string")
