import random
import re

import pytest
from pyspark.sql import functions as F

from noteloom.llm import jaccard_join as j
from noteloom.llm.base import table

from .conftest import DIR, HOSTILE, needs_tables


def brute(rows, t=80):
    """Component ids of (doc_id, text) by all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= max(len(sets[a]), len(sets[b])) * t and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def check(df):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.similar_components(df).collect()), key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def family(seed, copies, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_all_similarities(docs, seed):
    rng = random.Random(seed)
    texts = [t for k in range(6) for t in family(seed * 100 + k, 12, rng.choice((6, 12, 40, 120, 300)), rng.choice((1, 3, 6)))]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice((10, 60, 100)))) for _ in range(20)]
    # a chain, whose ends are not similar
    chain = [f"c{i}" for i in range(80)]
    for k in range(8):
        texts.append(" ".join(chain[k * 2 :] + [f"d{i}" for i in range(k * 2)]))
    check(docs(*texts))


def test_case_and_space(docs):
    check(docs("The Cat SAT on\tthe\nmat today", "the cat sat on the mat today", "É a b c d", "é a b c d", "one two", "One  TWO", "one", "", None))


def test_odd_and_empty(odd, empty):
    check(odd)
    assert j.similar_components(empty).count() == 0


def test_one_of_each_group_stays(odd):
    kept = j.without_near_copies(odd)
    assert kept.columns == odd.columns
    got = sorted([(r["doc_id"], (r["text"] or "")[:10]) for r in kept.collect()], key=repr)
    assert got == sorted([(1, ""), (2, ""), (3, "one"), (None, "a b c d e f g"[:10]), (5, "word0x0 wo"), (7, "  \n\t "), (8, "x" * 10), (9, "other word"), (10, HOSTILE[:10]), (11, "日本語の文章日本語の")], key=repr)


def test_classes_whose_hashes_agree_keep_their_links(docs, monkeypatch):
    """Links do not rest on parts of the class hash: here one of its two hashes is the same for all sets."""
    plain = j.Join.sets
    monkeypatch.setattr(j.Join, "sets", lambda self, d: plain(self, d).withColumn("k1", F.lit(7).cast("long")))
    check(docs(*[t for k in range(3) for t in family(k, 6, 60, 2)]))


def test_columns_named_like_helpers_stay(odd):
    df = odd.withColumn("__own", F.lit(1)).withColumn("__D", F.lit(2)).withColumn("__h", F.lit(3))
    assert j.without_near_copies(df).columns == df.columns


@needs_tables
def test_whole_table(spark):
    check(table(spark, DIR, "documents"))
