import hashlib
import random

from pyspark.sql import functions as F

from noteloom.llm import order_minhash as o
from noteloom.llm.base import table

from .conftest import DIR, needs_tables

M = (1 << 64) - 1


def xx(*longs):
    """Spark's xxhash64 of long columns, each hashed with the hash before as seed."""
    import xxhash

    seed = 42
    for v in longs:
        seed = xxhash.xxh64_intdigest((v & M).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def words_hash(words):
    import xxhash

    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def tokens(text):
    """Runs without white space; of those longer than 16, the windows of 4 that start at each character."""
    import re

    out = []
    for run in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        out += [run] if len(run) <= 16 else [run[i : i + 4] for i in range(len(run))]
    return out


def brute(text, k=3, tuples=64):
    """The signature without borrowing, by plain loops over tuples of words."""
    w = tokens(text)
    grams = [words_hash(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [words_hash(w)] if w else []
    seen, bins = {}, {}
    for place, g in enumerate(grams):
        key = g >> 28
        occurrence = seen[key] = seen.get(key, -1) + 1
        import xxhash

        h = xxhash.xxh64_intdigest((occurrence & 0xFFFFFFFF).to_bytes(4, "little"), xxhash.xxh64_intdigest((key & M).to_bytes(8, "little"), 42)) & ((1 << 35) - 1)
        b = h >> 28
        bins[b] = min(bins.get(b, (1 << 40, 0)), (h, place))
    out = []
    for j in range(tuples):
        pair = sorted((bins[b] for b in (2 * j, 2 * j + 1) if b in bins), key=lambda x: x[1])
        if pair:
            out.append(f"{(j << 32) | (xx(*[h for h, _ in pair]) & 0xFFFFFFFF):010x}")
    return "".join(out)


def test_signature_against_brute_force(spark, odd):
    rows = odd.select("text", o.as_text(o.signature(F.col("text"), dense=False)).alias("s")).collect()
    for r in rows:
        assert r["s"] == brute(r["text"]), (r["text"] or "")[:40]


def sketches(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(o.likeness(o.signature(F.col("a"), tuples=256), o.signature(F.col("b"), tuples=256))).first()
    return r[0]


def test_order_counts(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    text, edited = " ".join(words), " ".join([*words[:300], "new", *words[300:]])
    swapped = " ".join(words[300:] + words[:300])
    assert sketches(spark, text, text) == 1 and sketches(spark, text, edited) > 0.9
    # the same words in another order share nearly all k-mers, but their order tells them apart
    assert sketches(spark, text, swapped) < 0.8 < sketches(spark, text, edited)
    assert sketches(spark, text, " ".join(f"v{i}" for i in range(600))) == 0 and sketches(spark, "", "") == 1


def borrowed(text, k=3, tuples=64):
    """The dense signature, by plain loops: its numbered k-mers are those of brute()."""
    import xxhash

    w = tokens(text)
    grams = [words_hash(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [words_hash(w)] if w else []
    seen, values = {}, []
    for place, g in enumerate(grams):
        key = g >> 28
        seen[key] = occurrence = seen.get(key, -1) + 1
        values.append((xxhash.xxh64_intdigest((occurrence & 0xFFFFFFFF).to_bytes(4, "little"), xxhash.xxh64_intdigest((key & M).to_bytes(8, "little"), 42)) & ((1 << 35) - 1)) << 28 | place)
    out = []
    for t in range(tuples if values else 0):
        pair = [min((v for v in values if v >> 56 == j), default=None) for j in (2 * t, 2 * t + 1)]
        for i in (0, 1):
            if pair[i] is None:
                pair[i] = min((v for v in values if v != pair[1 - i]), key=lambda v: (v - o.borrower(2 * t + i)) % (1 << 63), default=None)
        members = sorted((v for v in pair if v is not None), key=lambda v: v & ((1 << 28) - 1))
        out.append(f"{(t << 32) | (xx(*[v >> 28 for v in members]) & 0xFFFFFFFF):010x}")
    return "".join(out)


def test_short_texts_keep_order(spark, docs):
    """Every tuple of a short text is an ordered pair, so that swapped halves are told apart."""
    rng = random.Random(3)
    texts = []
    for n in (4, 20, 40, 80) * 6:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [words, words[n // 2 :] + words[: n // 2]]
    got = {r["doc_id"]: r for r in o.fingerprint_documents(docs(*map(" ".join, texts), "", "one", "a b c d")).collect()}
    for i, words in enumerate([*texts, [], ["one"], list("abcd")]):
        assert got[i]["fingerprint"] == borrowed(" ".join(words)), words
    for c in (1, 2, 3):
        near = [got[i]["near_next"] for i in range(2 * c, len(texts), 8)]
        assert sum(near) / len(near) < 0.65, (c, near)


def test_texts_without_spaces(spark):
    """One character more or less, anywhere, keeps the likeness; another text has none of it."""
    rng = random.Random(11)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    other = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    latin = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    for a, b in ((text, "x" + text), (text, text[:1500] + text[1501:]), (latin, "q" + latin), (text[:40], "x" + text[:40])):
        assert sketches(spark, a, b) > 0.5
    assert sketches(spark, text, other) == 0 and sketches(spark, text, text[1500:] + text[:1500]) < 0.8
    got = spark.createDataFrame([(text,), ("x" * 17,), ("x" * 16,), ("a" * 40 + " b",)], "t string").select("t", o.as_text(o.signature(F.col("t"))).alias("s")).collect()
    assert all(r["s"] == borrowed(r["t"]) for r in got)


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        nxt, half = texts[(i + 1) % len(texts)], len(t) // 2
        out.append(t[: len(t) - half] + nxt[:half])
    return out


def test_neighbours_and_edits(spark, odd):
    got = o.fingerprint_documents(odd, buckets=3).collect()
    assert len(got) == odd.count()
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in odd.collect()))
    texts = [r[3] for r in rows]
    want = sorted(((r[1] if r[0] else None), len(t), hashlib.sha256(e.encode()).hexdigest()) for r, t, e in zip(rows, texts, edited(texts), strict=True) if r[0])
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by[3] == by[4] and len(by[9]) == 2


def test_empty_and_single(empty, docs):
    assert o.fingerprint_documents(empty).count() == 0
    one = o.fingerprint_documents(docs("ab cd ef")).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"ab cdab c"[:4] + b"ab c").hexdigest()


@needs_tables
def test_whole_table(spark):
    d = table(spark, DIR, "documents")
    rows = d.orderBy("doc_id").collect()
    want = {r["doc_id"]: hashlib.sha256(e.encode()).hexdigest() for r, e in zip(rows, edited([r["text"] or "" for r in rows]), strict=True)}
    got = o.fingerprint_documents(d).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == want
