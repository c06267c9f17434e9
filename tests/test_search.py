import math

import pytest
from pyspark.sql import functions as F

from noteloom.operators import fusion, links, search, vectors
from noteloom.plans import ask


@pytest.fixture
def notes(spark):
    rows = [(1, "Alpha", "the claim stands and claims again"), (2, "Beta", "nothing here"), (3, "Café claim", "über alles"), (4, "Empty", None)]
    return spark.createDataFrame(rows, "key long, title string, body string")


def test_prefix_and(notes):
    assert {r["key"] for r in search.matching(notes, "clai").collect()} == {1, 3}
    assert {r["key"] for r in search.matching(notes, "CLAIM cafe").collect()} == {3}
    assert search.matching(notes, "--- ").count() == 0
    assert {r["key"] for r in search.matching(notes, "uber").collect()} == {3}


def test_bm25(notes):
    got = {r["key"]: r["score"] for r in search.bm25(notes, "claim").collect()}
    mean = (7 + 3 + 4 + 1) / 4
    idf = max(1e-6, math.log((4 - 2 + 0.5) / (2 + 0.5)))
    want = lambda f, n: idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))
    assert got == pytest.approx({1: want(2, 7), 3: want(1, 4)})


def test_near_scores_are_ties_where_places_say_so(spark):
    """Of notes of nearly one length the shorter scores a little more; rounded, the keys decide, as in the SQL of bm25_search."""
    filler = " ".join(["w"] * 2_000)
    rows = [(1, "", f"thin {filler} w"), (2, "", f"thin {filler}"), (3, "", "none")]
    df = spark.createDataFrame(rows, "key long, title string, body string")
    assert [r["key"] for r in search.search(df, "thin", 1, False).collect()] == [2]
    assert [tuple(r) for r in search.search(df, "thin", 2, False, places=2).select("key", F.col("score") == F.round("score", 2)).collect()] == [(1, True), (2, True)]


def test_snippets(notes):
    hits = {r["key"]: r["snippet"] for r in search.search(notes, "claim").collect()}
    assert hits[1] == "the <mark>claim</mark> stands and <mark>claims</mark> again"
    assert hits[3] == "über alles"
    long = " ".join(f"w{i}" for i in range(30)) + " needle " + " ".join(f"v{i}" for i in range(30))
    s = search.snippet_of(long, ["needle"])
    assert s.startswith("…") and s.endswith("…") and "<mark>needle</mark>" in s


def test_one_folding_for_texts_and_queries(spark):
    import unicodedata

    words = ["tiếng", "ώρα", "résumé", "Ångström", "ЙОГА", "ﬁn", "naïve", "שָׁלוֹם"]
    rows = [(i, unicodedata.normalize(form, w), "") for i, (w, form) in enumerate((w, f) for w in words for f in ("NFC", "NFD"))]
    df = spark.createDataFrame(rows, "key long, title string, body string")
    for i, w in enumerate(words):
        for form in ("NFC", "NFD"):
            q = unicodedata.normalize(form, w)
            assert {2 * i, 2 * i + 1} <= {r["key"] for r in search.matching(df, q).collect()}, (w, form)
            assert search.query_tokens(q) == df.where(f"key = {2 * i}").select(search.tokens(F.col("title"))).first()[0]
    assert search.snippet_of(unicodedata.normalize("NFD", "un résumé"), ["resume"]).endswith("</mark>")


@pytest.mark.parametrize("query", ["claim", "CLAIM cafe", "the claim", "zzz", "--", "claim claim"])
def test_index_gives_what_the_scan_gives(notes, tmp_path, query):
    index = search.build_index(notes, str(tmp_path / "index"))
    assert (index.total, index.mean) == (4, 15 / 4)
    for f in (search.matching, search.bm25, search.search):
        a, b = ([tuple(r) for r in f(x, query).collect()] for x in (notes, index))
        assert sorted(map(repr, a)) == sorted(map(repr, b))
    empty = search.build_index(notes.limit(0), str(tmp_path / "none"))
    assert search.search(empty, query).count() == 0 and search.matching(empty, query).count() == 0


def test_index_reads_the_prefix_only(notes, tmp_path):
    plan = search.matching(search.build_index(notes, str(tmp_path / "i")), "clai")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,clai)" in plan


def test_rrf(spark):
    def fuse(*lists):
        rows = [(i, r, k) for i, ks in enumerate(lists) for r, k in enumerate(ks)]
        return [r["key"] for r in fusion.rrf(spark.createDataFrame(rows, "list_id int, rank int, key string")).collect()]

    assert fuse("ab", "cb") == ["b", "a", "c"]
    assert fuse("xy", "x") == ["x", "y"]
    assert fuse() == [] and fuse("", "a") == ["a"]


def test_vectors(spark):
    df = spark.createDataFrame([("far", [0.0, 1.0, 0.0]), ("near", [1.0, 0.0, 0.0]), ("mid", [0.70710678, 0.70710678, 0.0]), ("back", [-1.0, 0.0, 0.0])], "key string, embedding array<float>")
    assert [r["key"] for r in vectors.top_cosine(df, [1, 0, 0]).collect()] == ["near", "mid", "far"]
    assert [r["key"] for r in vectors.top_cosine(df, [1, 0, 0], least=0.5).collect()] == ["near", "mid"]
    assert [r["key"] for r in vectors.nearest_l2(df, [1, 0, 0], 2).collect()] == ["near", "mid"]
    e = vectors.semantic_edges(df.withColumnRenamed("key", "file"), 1, blocks=3).collect()
    assert {(r["source"], r["target"]) for r in e} == {("near", "mid"), ("mid", "far"), ("far", "mid"), ("back", "far")}
    c = vectors.centroids(df.select(F.lit("n").alias("file"), "embedding").where("key <> 'back'")).first()["embedding"]
    assert sum(x * x for x in c) == pytest.approx(1)


def test_hashed_embedder(spark):
    df = spark.createDataFrame([(1, "Hello hello world"), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in vectors.hashed_embedding(df).collect()}
    assert len(got[1]) == 384 and sorted(x for x in got[1] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert not any(got[2]) and not any(got[3])
    assert vectors.word_hash("a") == 97 and vectors.word_hash("zzzzzzz") < 2**31


def test_hybrid_and_ask(spark, notes):
    chunks = vectors.hashed_embedding(notes.where("body is not null").select(F.col("key").alias("file"), F.lit(0).alias("ord"), F.col("body").alias("text")))
    q = vectors.embed_text("claim stands", 384, {})
    got = {r["key"]: r for r in fusion.hybrid_notes(notes, chunks, "claim", q).collect()}
    assert got[1]["semantic"] and got[1]["score"] > got[3]["score"]
    plain = fusion.hybrid_notes(notes, chunks.limit(0), "claim", q).collect()
    assert [r["key"] for r in plain] == [r["key"] for r in search.search(notes, "claim").collect()] and not any(r["semantic"] for r in plain)
    keyed = chunks.select(F.col("file").alias("key"), F.col("file").cast("string").alias("file"), F.lit("").alias("heading"), "text", "embedding")
    text, files = ask.ask(keyed, "claim stands")
    assert text and files[0] == "1"


def test_links(spark):
    t = spark.createDataFrame([("A", "links_to", "B", "A.md"), ("A", "links_to", "B", "A.md"), ("B", "links_to", "B", "B.md"), ("C", "cites", "sub/B", "C.md")], "subject string, relation string, object string, source_file string")
    assert [tuple(r) for r in links.backlinks(t, "B").collect()] == [("A.md", "links_to"), ("B.md", "links_to")]
    assert [tuple(r) for r in links.outbound(t, "A.md").collect()] == [("links_to", "B")]
    assert {(r["relation"], tuple(r["files"])) for r in links.connections(t, "B", "sub/B").collect()} == {("links_to", ("A.md", "B.md")), ("cites", ("C.md",))}
    f = spark.createDataFrame([("sub/B.md", "B"), ("Zed.md", "Zed")], "path string, title string")
    assert {r["object"]: r["resolvable"] for r in links.resolvable(t, f).collect()} == {"B": True, "sub/B": True}
    assert [r["name"] for r in links.complete_name(f, "x [[z").collect()] == ["Zed"]
    assert links.complete_name(f, "x [[z]] y").count() == 0
