r"""Substring deduplication: words in a window that also starts in a document of smaller doc_id are removed.

A window is `window` consecutive words ([^\x20\x09-\x0D]+, unchanged) of one document. Rabin-Karp hashes of all windows
of a text come from prefix sums of word hashes times powers of an odd base (64 bits, two bases). Spark counts them:

1. Each window is given to its anchor, the least of the hashed `gram`-word sequences inside it (the leftmost one, if
   several are least). Windows of one anchor follow each other; the words they cover are a block. Equal windows have
   equal anchors, so an anchor that only one document holds rules out all its windows: they are counted by one row.
2. Rows of shared anchors are counted by block. All windows of a block also start in the smallest document with the
   same block, and are removed from every larger one without being looked at singly. Copies of a passage, however many
   there are, are the same blocks, so from here on each different block stands once.
3. Where an anchor has several different blocks, the windows of each block's smallest documents are counted singly, by
   both hashes; those that a smaller document holds are removed.

Removed windows merge into maximal intervals of words. Nothing is capped: every count is a grouped minimum, so a window
of a third of all documents is aggregated before it is shuffled. Equality of windows is that of two 64-bit hashes.

Null text has no words. Texts of fewer words than a window stay whole. A null doc_id counts as larger than all others.
Rows of the same doc_id are the same document: they don't remove each other's words. Repeated rows stay rows. Other
columns are ignored. Memory is in proportion to one text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrow_limits, discard, keep

WINDOW = 50
#: Odd bases of the two rolling hashes, and what spreads the bits of the first for the choice of anchors.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SPREAD = np.uint64(0xFF51AFD7ED558CCD)
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_NO_ID = (1 << 63) - 1
_ROWS = 1 << 18


class _Digests(dict):
    """word -> its place in `table`, which holds two 64-bit digests of each word seen."""

    def __init__(self):
        self.table, self.bytes = np.zeros((1024, 2), np.uint64), 0

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = np.frombuffer(hashlib.blake2b(word, digest_size=16).digest(), "<u8")
        self.bytes += len(word)
        return at


class Hasher:
    """Rolling hashes of one text after the other; digests of words are kept until there are `most`, or `most_bytes` of words."""

    def __init__(self, most: int = 1 << 18, most_bytes: int = 1 << 24):
        self.most, self.most_bytes, self.known = most, most_bytes, _Digests()
        self.up = [np.ones(1, np.uint64) for _ in BASES]
        self.down = [np.ones(1, np.uint64) for _ in BASES]

    def read(self, raw: bytes, step: int = 1 << 20) -> int:
        """Takes a text; returns its number of words."""
        parts, at = [np.zeros((0, 2), np.uint64)], 0
        while at < len(raw):
            seam = _WHITE.search(raw, at + step)
            end = seam.start() if seam else len(raw)
            words = raw[at:end].split()
            places = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            parts.append(self.known.table[places])
            if len(self.known) >= self.most or self.known.bytes >= self.most_bytes:
                self.known = _Digests()
            at = end
        lanes = np.concatenate(parts)
        self.n = len(lanes)
        if len(self.up[0]) < self.n:
            size = 2 * self.n
            for i, base in enumerate(BASES):
                self.up[i] = _powers(base, size)
                self.down[i] = _powers(pow(base, -1, 1 << 64), size)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(lanes[:, i] * self.up[i][: self.n], dtype=np.uint64)]) for i in range(2)]
        return self.n

    def of(self, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        """Hashes of the word sequences from start to end (exclusive)."""
        return (self.sums[lane][end] - self.sums[lane][start]) * self.down[lane][start]

    def blocks(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """anchor, block (hashes), first window and number of windows of every block of the text read last."""
        m, span = self.n - window + 1, window - gram + 1
        if m <= 0:
            none = np.zeros(0, np.uint64)
            return none, none, none.astype(np.int64), none.astype(np.int64)
        at = np.arange(self.n - gram + 1)
        grams = self.of(at, at + gram, 0)
        grams = (grams ^ (grams >> np.uint64(31))) * SPREAD
        grams ^= grams >> np.uint64(29)
        seen = np.lib.stride_tricks.sliding_window_view(grams, span)
        least = np.concatenate([seen[i : i + 4096].argmin(1) + np.arange(i, min(m, i + 4096)) for i in range(0, m, 4096)])
        first = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
        count = np.diff(np.append(first, m))
        return grams[least[first]], self.of(first, first + count - 1 + window, 1), first, count


def _powers(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)


def _identified(docs: DataFrame) -> DataFrame:
    """d (doc_id, the largest number for null), known, t (which text), text."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(_NO_ID)).alias("d"), doc_id.isNotNull().alias("known"), F.xxhash64(text).alias("t"), F.coalesce(text, F.lit("")).alias("text"))


def _packed(text: str) -> Column:
    """A text on its way through a shuffle."""

    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: zlib.compress(x.encode(), 1))

    return F.pandas_udf(pack, "binary")(text)


def blocks(docs: DataFrame, window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """d, t, anchor, block, first, count: every block of windows of docs."""
    gram = gram or max(1, window * 2 // 5)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for frame in frames:
            found = []
            for d, t, text in zip(frame.d, frame.t, frame.text, strict=True):
                hasher.read(text.encode())
                anchor, block, first, count = hasher.blocks(window, gram)
                found.append((np.full(len(first), d, np.int64), np.full(len(first), t, np.int64), anchor.view(np.int64), block.view(np.int64), first.astype(np.int64), count.astype(np.int64)))
            yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))

    names = ["d", "t", "anchor", "block", "first", "count"]
    return _identified(docs).select("d", "t", "text").mapInPandas(run, ", ".join(f"{n} long" for n in names))


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """d, t, first, a, b: both hashes of every window in the ranges of texts (d, t, packed, ranges)."""
    names = ["d", "t", "first", "a", "b"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, found, n = Hasher(), [], 0

        def flush():
            return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))

        for frame in frames:
            for d, t, packed, firsts, counts in zip(frame.d, frame.t, frame.packed, frame.firsts, frame.counts, strict=True):
                hasher.read(zlib.decompress(packed))
                at = np.flatnonzero(_covered(firsts, counts, hasher.n, 0))
                a, b = (hasher.of(at, at + window, lane).view(np.int64) for lane in (0, 1))
                found.append((np.full(len(at), d, np.int64), np.full(len(at), t, np.int64), at.astype(np.int64), a, b))
                n += len(at)
                if n >= _ROWS:
                    yield flush()
                    found, n = [], 0
        if found:
            yield flush()

    return texts.mapInPandas(run, ", ".join(f"{n} long" for n in names))


def _covered(firsts: np.ndarray, counts: np.ndarray, n: int, more: int) -> np.ndarray:
    """Which of n places lie in one of the ranges, each longer by `more`."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.asarray(firsts, np.int64), 1)
    np.add.at(steps, np.asarray(firsts, np.int64) + np.asarray(counts, np.int64) + more, -1)
    return np.cumsum(steps[:n]) > 0


def _by_text(ranges: DataFrame) -> DataFrame:
    """d, t, firsts, counts: the ranges of each text, at most one for each of its words."""
    listed = ranges.groupBy("d", "t").agg(F.collect_list(F.struct("first", "count")).alias("r"))
    return listed.select("d", "t", F.col("r.first").alias("firsts"), F.col("r.count").alias("counts"))


def repeated(docs: DataFrame, window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """d, t, first, count: ranges of windows that also start in a document of smaller doc_id."""
    every = keep(blocks(docs, window, gram), "blocks")
    shared = every.groupBy("anchor").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high").select("anchor")
    shared = keep(shared, "anchors")  # tables on both sides of a join let Spark split an anchor that very many blocks have
    some = keep(every.join(shared, "anchor", "left_semi"), "shared")
    discard(every, shared)
    each = some.groupBy("anchor", "block").agg(F.min("d").alias("owner"))
    mixed = each.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("mixed"))
    judged = some.join(keep(each.join(mixed, "anchor"), "owners"), ["anchor", "block"])
    whole = judged.where("d > owner").select("d", "t", "first", "count")
    single = _by_text(judged.where("d = owner and mixed").select("d", "t", "first", "count"))
    texts = _identified(docs).select("d", "t", _packed("text").alias("packed"))
    windows = keep(_windows(texts.join(single, ["d", "t"]), window), "windows")
    lowest = windows.groupBy("a", "b").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high").select("a", "b", "low")
    lowest = keep(lowest, "lowest")
    lone = windows.join(lowest, ["a", "b"]).where("low < d").select("d", "t", "first", F.lit(1).cast("long").alias("count"))
    return whole.unionByName(lone)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, removed (array of start and end of the maximal intervals, in words), kept (text)."""
    arrow_limits(docs.sparkSession)
    ranges = _by_text(repeated(docs, window, gram))
    texts = _identified(docs).select("d", "known", "t", _packed("text").alias("packed")).join(ranges, ["d", "t"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, known, packed, firsts, counts in zip(frame.d, frame.known, frame.packed, frame.firsts, frame.counts, strict=True):
                words = zlib.decompress(packed).split()
                gone, cut = np.zeros(len(words), bool), []
                if firsts is not None:
                    gone = _covered(firsts, counts, len(words), window - 1)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    cut = [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]
                rows.append((d if known else None, len(words), int(gone.sum()), cut, b" ".join(compress(words, ~gone)).decode()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "removed", "kept"])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return texts.mapInPandas(run, "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in DuckDB.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM repeated
), gaps AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, COALESCE(len(gone), 0)::BIGINT AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM w LEFT JOIN gaps USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
