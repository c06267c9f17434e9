"""Hierarchical multi-length packing of tokenized documents into sequences of at most the longest tier.

Each document's tokens (with an end id) are cut into pieces of the longest tier's length; its remainder goes to the
shortest tier that holds it. Windows of the longest tier are packed first: a remainder opens a window, the gap is
filled with the largest fitting remainders of shorter tiers, and what is left of the gap by cutting one more piece.
So every window is exactly full, and a tier's leftovers move down to the next shorter tier. Only the last tokens of a
task end in a padded sequence. Full windows have the length of their tier, a power of two, and need no padding.

Packing is local to an input partition: no shuffle, no global state, a lost task is repeated with the same result.
Memory is bounded: ids wait as arrays of 16 bits (32 for larger vocabularies) until `buffer_tokens` are there, then all full windows leave.
Step groups: windows of one tier fill groups of equally many tokens, so every optimizer step costs the same. Groups
are those of a task; the last one of each tier in a task is shorter, as is the task's one padded sequence.

Null text counts as empty and has only the end id. Repeated rows are packed once for each row. Empty tables give none.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_right, insort
from collections import ChainMap
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import arrow_limits

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
TIERS = (512, 1024, 2048, 4096)
#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: c for c, b in enumerate((b for b in range(256) if b not in _PRINTABLE), 256)}


#: What a tokenizer file must say for the cache of words to be valid.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def splits_at_spaces(file: dict) -> bool:
    """Whether a tokenizer file normalizes and splits as WordCachedTokenizer's cache assumes."""
    parts = lambda key, of: ((file.get(key) or {}).get("type"), (file.get(key) or {}).get(of))
    model, added = file.get("model") or {}, [x["content"] for x in file.get("added_tokens") or []]
    return (
        parts("normalizer", "normalizers") == ("Sequence", NORMALIZERS) and parts("pre_tokenizer", "pretokenizers") == ("Sequence", SPLITTERS)
        and model.get("type") == "BPE" and not model.get("dropout") and not file.get("truncation") and not file.get("padding")
        and not any(x.isalpha() or any(c.isspace() for c in x) for x in added)
    )


class WordCachedTokenizer:
    """ids of whole texts, equal to the tokenizer's own.

    Where the file's splitter never crosses a space (splits_at_spaces), parts between spaces are cached. Such a
    splitter also always splits a run of letters from a run of other signs without an apostrophe, and lowers ASCII
    letters, so "Word," is put together from the cached ids of "word" and ",". Any other file encodes whole texts.
    Ids take 16 bits if the vocabulary allows it, else 32.

    The cache is bounded by `cached` parts and by `cached_bytes`, counted with what Python needs for an entry, and starts
    anew beyond either. Parts of more than LONGEST characters (whole texts, in scripts without spaces) are never kept.
    """

    SIGNS = ".,;:!?%&*#$"
    LONGEST = 64
    #: Bytes of an entry besides its text and ids: two objects' heads and a place in a dictionary, or two.
    ENTRY = 300

    def __init__(self, path: str, cached: int = 500_000, cached_bytes: int = 200 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.cached_bytes = Tokenizer.from_file(path), cached, cached_bytes
        self.known, self.units, self.used = {}, {"": b""}, 0
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.by_words = splits_at_spaces(json.load(f))
        self.code, self.dtype = ("H", "<u2") if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else ("I", "<u4")

    @classmethod
    def of_process(cls, path: str) -> WordCachedTokenizer:
        """The one of this worker process: its cache serves the tasks that follow."""
        import sys

        kept = sys.__dict__.setdefault("_noteloom_tokenizers", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def learn(self, new: list[str]) -> None:
        made, units = [], self.units
        for x in new:
            core = x.rstrip(self.SIGNS)
            tail = x[len(core) :]
            if core.isalpha():
                made.append((x, core.lower() if core.isascii() else core, tail))
            else:
                made.append((x, x, ""))
        for x in {u for m in made for u in m[1:] if u not in units}:
            units[x] = array(self.code, self.encoded(x)).tobytes()
            self.used += self.ENTRY + 4 * len(x) + len(units[x])
        for x, core, tail in made:
            self.known[x] = units[core] + units[tail]
            self.used += self.ENTRY + 4 * len(x) + len(self.known[x])

    def encoded(self, x: str) -> list[int]:
        """ids of a part. Lower-case words in composed form are past the normalizer and splitter: the model alone reads them."""
        if x.isalpha() and x == x.lower() and is_normalized("NFC", x):
            return [t.id for t in self.model.tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(BYTES))]
        return self.tokenizer.encode(x, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        parts = text.replace("\n", " ").split(" ")
        if len(self.known) > self.cached or self.used > self.cached_bytes:
            self.known.clear()
            self.units.clear()
            self.units[""], self.used = b"", 0
        known, new = self.known, {x for x in set(parts) if x not in self.known}
        if long := {x for x in new if len(x) > self.LONGEST}:
            new -= long
            known = ChainMap({x: array(self.code, self.encoded(x)).tobytes() for x in long}, self.known)
        for i in range(0, len(new := list(new)), 10_000):
            self.learn(new[i : i + 10_000])
        return np.frombuffer(b"".join(map(known.__getitem__, parts)), self.dtype)


class Packer:
    """Pieces wait by length; pack() empties full windows into rows."""

    def __init__(self, task: int, tiers: tuple[int, ...], group_tokens: int):
        self.tiers, self.group_tokens, self.task = tiers, group_tokens, task
        self.waiting: list[tuple[int, int]] = []  # (length, number), sorted
        self.pieces: dict[int, tuple] = {}
        self.n = self.tokens = self.sequences = 0
        self.filled = dict.fromkeys(tiers, 0)
        self.rows: list[tuple] = []

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        insort(self.waiting, (len(ids), self.n))
        self.pieces[self.n] = (doc_id, start, ids, doc_tokens)
        self.n += 1
        self.tokens += len(ids)

    def document(self, doc_id, ids: np.ndarray) -> None:
        top = self.tiers[-1]
        for i in range(0, len(ids), top):
            self.add(doc_id, i, ids[i : i + top], len(ids))

    def take(self, most: int) -> tuple | None:
        """The longest waiting piece of at most `most` ids."""
        i = bisect_right(self.waiting, (most, 1 << 62)) - 1
        if i < 0:
            return None
        n, k = self.waiting.pop(i)
        self.tokens -= n
        return self.pieces.pop(k)

    def window(self, size: int, first_most: int) -> None:
        """One window of exactly `size` ids; the caller knows that there are enough."""
        sequence = (self.task << 36) + self.sequences
        self.sequences += 1
        tier = next(t for t in self.tiers if t >= size)
        group = (self.task << 36) + (tier.bit_length() << 28) + self.filled[tier] // self.group_tokens
        self.filled[tier] += size
        at, most = 0, first_most
        while at < size:
            piece = self.take(min(most, size - at))
            most = size
            if piece is None:  # every piece is longer than the gap: cut the shortest
                doc_id, start, ids, total = self.take(self.waiting[0][0])
                self.add(doc_id, start + size - at, ids[size - at :], total)
                piece = (doc_id, start, ids[: size - at], total)
            doc_id, start, ids, total = piece
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, at, tier, group))
            at += len(ids)

    def pack(self, end: bool) -> None:
        """Full windows of each tier for the pieces routed to it, the longest tier first; at the end all that waits."""
        for size, below in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0], strict=True):
            while self.tokens >= size and self.waiting[-1][0] > below:
                self.window(size, size)
        for size in self.tiers[::-1] if end else ():
            while self.tokens >= size:
                self.window(size, size)
        if end and self.tokens:
            self.window(self.tokens, self.tokens)


def packed_pieces(path: str, end_id: int, tiers: tuple[int, ...], buffer_tokens: int, group_tokens: int):
    """The function of a partition: batches of (doc_id, text) in, batches of pieces out."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, packer = WordCachedTokenizer.of_process(path), Packer(TaskContext.get().partitionId(), tiers, group_tokens)
        end = np.array([end_id], tokenizer.dtype if end_id < 1 << 16 else "<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.document(doc_id, np.concatenate([tokenizer.ids(text.as_py() or ""), end]))
                if packer.tokens >= buffer_tokens or len(packer.waiting) >= 20_000:
                    packer.pack(end=False)  # less than a window of the shortest tier waits on
                    yield out(packer.rows)
                    packer.rows = []
        packer.pack(end=True)
        if packer.rows:
            yield out(packer.rows)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, buffer_tokens: int = 1 << 21, group_tokens: int = 1 << 16) -> DataFrame:
    """One row per piece of docs (doc_id, text; other columns are ignored): see the module's text.

    `tokenizer_path` is a tokenizers file that all executors can read. tiers are powers of two, ascending.
    """
    if list(tiers) != sorted({1 << (t.bit_length() - 1) for t in tiers}):
        raise ValueError("tiers must be ascending powers of two")
    arrow_limits(docs.sparkSession)
    run = packed_pieces(tokenizer_path, end_id, tuple(tiers), buffer_tokens, group_tokens)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)
