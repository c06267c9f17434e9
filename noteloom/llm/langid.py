"""Language identification by a Bloom filter whose slots hold language bitmasks.

Training: all letter n-grams of a bounded sample of each language's labelled documents (the bound is
`docs_per_language`) are inserted into one table of fixed size: an n-gram sets its language's bit in k slots. A lookup
ANDs the k slots, which returns all languages that hold the n-gram at once.

Prediction: all n-grams of the whole text are looked up, a popcount per language gives its hits, and the hits that a
filter of its fill would give by chance are taken off: (hits - n * p) / (1 - p) with p the fill to the power k. The
largest corrected count decides; score is its share of all corrected counts. coverage is its share of the n-grams.

Null text, text without a letter, and every text when nothing could be learned give "und" with score 0. Ties go to the
language that is first by code point. Labels beyond the first `64 * planes` languages raise. Repeated rows are
predicted alike. An empty table gives none. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrow_limits

MAYBE_LETTER = re.compile(r"[^\W\d_]")  # also holds signs such as a half or a superscript
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str, n: int, letters: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of the lower-cased letters, other characters being one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    c = np.where(letters[np.minimum(c, len(letters) - 1)], c, 32)
    c = np.concatenate([[32], c, [32]]).astype(np.uint64)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < n:
        return np.empty(0, np.uint64)
    code = np.zeros(len(c) - n + 1, np.uint64)
    for i in range(n):
        code = (code << np.uint64(21)) ^ (code >> np.uint64(43)) ^ c[i : len(c) - n + 1 + i]
    return code


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


def letter_table() -> np.ndarray:
    """Whether a code point of the basic plane is a letter; those above count as letters."""
    t = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    return np.append(t, True)


def slots_of(codes: np.ndarray, k: int, bits: int) -> list[np.ndarray]:
    h = codes * _MIX
    h ^= h >> np.uint64(32)
    h = h * _MIX
    step = (h >> np.uint64(17)) | np.uint64(1)
    return [((h + np.uint64(i) * step) * _MIX >> np.uint64(64 - bits)).astype(np.int64) for i in range(k)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # slots x planes, uint64
    fill: np.ndarray  # share of slots with a language's bit
    n: int
    k: int

    @property
    def bits(self) -> int:
        return len(self.table).bit_length() - 1

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """Corrected hits per language."""
        found = None
        for s in slots_of(codes, self.k, self.bits):
            found = self.table[s] if found is None else found & self.table[s]
        if len(self.languages) <= 10:
            by = np.bincount(found[:, 0].astype(np.int64), minlength=1 << len(self.languages))
            masks = np.arange(len(by))
            hits = np.array([by[(masks >> i) & 1 == 1].sum() for i in range(len(self.languages))], float)
        else:
            hits = np.array([((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum() for i in range(len(self.languages))], float)
        chance = self.fill**self.k
        return np.maximum((hits - len(codes) * chance) / (1 - chance), 0)

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float, float]:
        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0, 0.0
        codes = grams(text, self.n, letters)
        got = self.counts(codes)
        best, total = int(got.argmax()), float(got.sum())
        return self.languages[best], float(got[best]) / total if total else 0.0, float(got[best]) / max(1, len(codes))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, n: int = 4, k: int = 3, slot_bits: int = 20, docs_per_language: int = 2000, planes: int = 1) -> Model:
    """Learn from the documents that are not held out and have a lang: all of a language that has up to docs_per_language,
    of others a share that comes to about that number, by a digest of doc_id.

    Each task sets bits in a table of its own, and the tables are joined by bit_or over slots, so what reaches the
    driver is at most the table, whatever the number of documents or n-grams.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(64 * planes + 1).collect()}
    languages = sorted(counts, key=lambda x: x.encode())
    if len(languages) > 64 * planes:
        raise ValueError(f"more languages than the {64 * planes} that the bitmasks hold")
    # a language of more documents gives those whose digest is below its share of all digests
    share = F.lit(1.0)
    for lang, many in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, docs_per_language / many)).otherwise(share)
    texts = known.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share * (1 << 32)))

    def fill_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, table = letter_table(), np.zeros((1 << slot_bits, planes), np.uint64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                i = languages.index(lang)
                for s in slots_of(np.unique(grams(text.as_py(), n, letters)), k, slot_bits):
                    table[s, i // 64] |= np.uint64(1 << (i % 64))
        slot, plane = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(plane.astype(np.int32)), pa.array(table[slot, plane].view(np.int64))], ["slot", "plane", "bits"])

    rows = texts.select("lang", "text").mapInArrow(fill_in, "slot int, plane int, bits long").groupBy("slot", "plane").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros((1 << slot_bits, planes), np.uint64)
    table[rows["slot"].to_numpy(), rows["plane"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, table, fill, n, k)


def identify(docs: DataFrame, model: Model, keep_columns: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, coverage for every row; with keep_columns, the columns of docs and the last three.

    Columns of docs named like one of the last three give way to it.
    """
    arrow_limits(docs.sparkSession)
    if keep_columns:
        docs = docs.drop("lang_pred", "score", "coverage")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, letters = model, letter_table()  # of fixed size: slots, not documents
        for b in batches:
            got = [m.predict(t.as_py(), letters) for t in b.column(b.schema.get_field_index("text"))]
            new = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            kept = [i for i, name in enumerate(b.schema.names) if keep_columns or name != "text"]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + new, [b.schema.names[i] for i in kept] + ["lang_pred", "score", "coverage"])

    new = "lang_pred string, score double, coverage double"
    if keep_columns:
        schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
        return docs.mapInArrow(run, f"{schema}, {new}")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, held_out boolean, {new}")
