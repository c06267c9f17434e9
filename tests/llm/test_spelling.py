import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from noteloom.llm import spelling
from noteloom.llm.queries import ORACLES, QUERIES

from .conftest import DIR, needs_tables


def brute_words(rows, least_n):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_n}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    forms, out = {}, []
    for w, n in words.items():
        around = [x for x in words if near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        out.append([w, forms[w], None, n, len(around), words.get(forms[w])])
    for row in out:
        at = row[0]
        while forms[at] is not None:
            at = forms[at]
        row[2] = at
    return sorted(map(tuple, out), key=repr)


def variants(spark, words, **sizes):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(map(tuple, spelling.variants(df, **sizes).collect()), key=repr)


def some_words(seed, n=400):
    rng = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(rng.choices("abéÿ"[: rng.choice([2, 4])], k=rng.randrange(6, 9)))
        words[w] = rng.choice([5, 6, 30, 200, 1000, 6000, 40_000])
    return words


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"shard_words": 7}), (3, {"shard_words": 40, "round_bytes": 1}), (4, {"shard_words": 1, "round_bytes": 4000})])
def test_shards_and_rounds_change_nothing(spark, seed, sizes):
    words = some_words(seed, 150 if sizes.get("round_bytes") == 1 else 60 if "round_bytes" in sizes else 400)
    got = variants(spark, words, **sizes)
    assert got == brute(words)
    assert any(r[1] for r in got) and any(r[1] and r[1] != r[2] for r in got)


def test_trie_finds_what_comparing_finds():
    rng = random.Random(5)
    for letters in ("ab", "abc", "aé"):
        keys = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(150)})
        trie = spelling.Trie(keys, [1] * len(keys))
        assert [trie.key(i) for i in range(len(keys))] == keys
        for w in [*keys, *("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(100))]:
            for prefix in (0, 1, len(w) // 2, len(w)):
                assert {trie.key(i) for i in trie.near(w, prefix)} == {k for k in keys if near(w, k) and k[:prefix] == w[:prefix]}, (w, prefix)


def test_chains_ties_and_none(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "zzzzzz": 9, "zzzzzy": 45, "azzzzz": 45, "longerword": 6, "longerwords": 29}
    got = {r[0]: r[1:] for r in variants(spark, words)}
    assert got["abcdef"] == ("abcdeg", "abcihg", 5, 1, 25)
    assert got["zzzzzz"] == ("azzzzz", "azzzzz", 9, 2, 45)
    assert got["longerword"] == (None, "longerword", 6, 1, None)
    assert variants(spark, {}) == []


def test_words_of_odd_documents(spark, odd, empty, docs):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = {r["word"]: r["n"] for r in spelling.counted_words(odd, least_n=1).collect()}
    assert got == brute_words(rows, 1)
    texts = [("Größe ÀÉîõÿ× Straßen_weit KELVINK İstanbul naïveté " + "abcdefg hijklmn" * 3) * 4] * 300
    df = docs(*texts)
    assert {r["word"]: r["n"] for r in spelling.counted_words(df).collect()} == brute_words(list(enumerate(texts)), 5)
    assert spelling.variants(spelling.counted_words(empty)).count() == 0


def test_very_long_words(spark):
    long = "ab" * 30_000
    words = {long: 5, long + "c": 50, "x" + long: 500, long[:-1]: 7}
    got = {r[0]: r[1:] for r in variants(spark, words)}
    assert got[long] == ("x" + long, "x" + long, 5, 3, 500)


def test_long_runs_of_one_letter(spark):
    words = {"x" * n: 5 * (n % 7 + 1) for n in range(40_000, 40_030)}
    got = {r[0]: r[1:] for r in variants(spark, words)}
    assert [got["x" * n][3] for n in (40_000, 40_001, 40_029)] == [1, 2, 1]


@needs_tables
def test_same_rows_as_sql_and_brute_force(spark):
    got = sorted(map(tuple, QUERIES["op13_spelling_variants"](spark, DIR).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({ORACLES['op13_spelling_variants']})").fetchall()
    assert got == sorted(want, key=repr)
    assert got == brute(brute_words(con.sql("SELECT doc_id, text FROM documents").fetchall(), 5))
