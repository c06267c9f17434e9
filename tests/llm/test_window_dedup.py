import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from noteloom.llm import window_dedup
from noteloom.llm.queries import ORACLES, QUERIES

from .conftest import DIR, LONG, SCHEMA, document_rows, needs_tables

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(doc_id, n_words, removed intervals, kept) of rows (doc_id, text)."""
    order = lambda d: window_dedup._NO_ID if d is None else d
    texts = [(d, WORDS.findall(t or "")) for d, t in rows]
    low = defaultdict(lambda: window_dedup._NO_ID)
    for d, ws in texts:
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            low[key] = min(low[key], order(d))
    out = []
    for d, ws in texts:
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if low[tuple(ws[i : i + window])] < order(d):
                gone[i : i + window] = [True] * window
        edges = [i for i in range(len(ws) + 1) if (gone[i] if i < len(ws) else False) != (gone[i - 1] if i else False)]
        out.append((d, len(ws), sum(gone), list(zip(edges[::2], edges[1::2], strict=True)), " ".join(w for w, g in zip(ws, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def check(df, window, gram=None):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], [tuple(x) for x in r["removed"]], r["kept"]) for r in window_dedup.without_repeats(df, window, gram).collect()]
    assert sorted(got, key=repr) == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], window)
    return got


def test_odd(odd, empty):
    got = check(odd, 50)
    assert len(got) == odd.count()
    assert window_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize(("window", "gram", "letters"), [(2, None, 2), (3, 1, 2), (5, None, 3), (5, 5, 2), (8, 3, 2)])
def test_few_words_repeat_all_over(spark, window, gram, letters):
    rng = random.Random(window * letters)
    texts = [" ".join(rng.choices("abcdefg"[:letters], k=rng.choice([0, 1, window - 1, window, 20, 60]))) for _ in range(40)]
    rows = [(rng.choice([None, *range(30)]), t) for t in texts]
    check(spark.createDataFrame(document_rows(rows), SCHEMA).repartition(5), window, gram)


def test_passages_copies_and_edits(spark):
    """Passages that cross the bounds of blocks, in many documents, in several orders of doc_id, and copies with an edit."""
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 60, 80, 130, 300)]
    long = text(700)
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(0, 90))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(0, 12)
            parts += [p[cut:], text(rng.randrange(0, 40))]
        if i % 3 == 0:
            copy = list(long)
            for _ in range(i % 4):
                copy[rng.randrange(len(copy))] = "edit"
            parts = [copy]
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    got = check(spark.createDataFrame(document_rows(rows), SCHEMA).repartition(6), 50)
    assert sum(r[2] for r in got) > 20_000


def test_pieces_and_full_caches_change_nothing():
    raw = LONG.encode() + "  é 日本 ".encode() * 50
    whole, small = window_dedup.Hasher(), window_dedup.Hasher(most=7, most_bytes=100)
    assert whole.read(raw) == small.read(raw, 64) == len(raw.split())
    for a, b in zip(whole.blocks(50, 20), small.blocks(50, 20), strict=True):
        assert np.array_equal(a, b)
    words = raw.split()
    assert whole.of(np.array([3]), np.array([53]), 1) == small.of(np.array([3]), np.array([53]), 1)
    same = window_dedup.Hasher()
    same.read(b" ".join(words[3:53]))
    assert same.of(np.array([0]), np.array([50]), 0) == whole.of(np.array([3]), np.array([53]), 0)


@needs_tables
def test_same_rows_as_sql(spark):
    got = QUERIES["op12_substring_dedup"](spark, DIR).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(ORACLES["op12_substring_dedup"]).df()[got.columns].sort_values("doc_id").reset_index(drop=True)
    assert got.values.tolist() == want.values.tolist()
    empty = hashlib.sha256(b"").hexdigest()
    assert (got.n_removed > 0).any() and (got.kept_sha256[got.n_removed < got.n_words] != empty).all()
