import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators import search, text_index

SCHEMA = "key long, title string, body string"
QUERIES = ["alp", "beta gam", "eps z"]


def make(rng, n, first=0):
    words = ["alpha", "alps", "beta", "gamma", "delta", "épsilon", "zeta", "the", "of"]
    return [(first + i, " ".join(rng.choices(words, k=rng.randrange(3))), rng.choice([None, "", "  ", " ".join(rng.choices(words, k=40))]) if i % 3 else " ".join(rng.choices(words, k=8)) + "!") for i in range(n)]


def results(index, query):
    rows = [tuple(r) for r in search.search(index, query).collect()]
    return [(k, t, round(s, 9), x) for k, t, s, x in rows], sorted(r["key"] for r in search.matching(index, query).collect())


def same(spark, index, rows, place):
    fresh = text_index.build(spark.createDataFrame(rows, SCHEMA), place)
    assert (index.total, index.mean) == (fresh.total, pytest.approx(fresh.mean))
    counts = lambda i: {tuple(r) for r in i.postings.groupBy("token", "field").agg(F.count(F.lit(1)), F.sum(text_index.frequency())).collect()}
    assert counts(index) == counts(fresh)
    for q in QUERIES:
        assert results(index, q) == results(fresh, q), q


def test_changes_give_what_a_fresh_build_gives(spark, tmp_path):
    rng, base = random.Random(1), str(tmp_path / "i")
    rows = {r[0]: r for r in make(rng, 60)}
    frame = lambda rs: spark.createDataFrame(rs, SCHEMA)
    files = lambda ks: spark.createDataFrame([(k,) for k in ks], "file long")
    index = text_index.build(frame(list(rows.values())), base)
    for step in range(3):
        changed = rng.sample(sorted(rows), 8)
        gone, fresh = changed[:3], [(k, "new", f"alpha step{step}") for k in changed[3:]] + make(rng, 3, 1000 + 10 * step)
        for _ in range(1 + step % 2):  # twice is as good as once
            index = text_index.update(base, frame(fresh), files([*changed, *(r[0] for r in fresh)]), compact_at=3)
        rows = {k: v for k, v in rows.items() if k not in gone} | {r[0]: r for r in fresh}
    assert text_index._state(spark, base).since > 1  # it has been compacted on the way
    same(spark, index, list(rows.values()), str(tmp_path / "fresh"))
    index = text_index.update(base, frame([]), files(rows))
    assert index.total == 0 and search.search(index, "alp").count() == 0


def test_an_update_writes_its_own_notes_only(spark, tmp_path):
    base = tmp_path / "i"
    text_index.build(spark.createDataFrame(make(random.Random(2), 300), SCHEMA), str(base))
    before = {f: f.stat().st_mtime_ns for f in base.rglob("*.parquet")}
    text_index.update(str(base), spark.createDataFrame([(5, "a b", "c d c"), (6, "", "e")], SCHEMA), spark.createDataFrame([(5,), (6,), (7,)], "file long"))
    after = {f: f.stat().st_mtime_ns for f in base.rglob("*.parquet")}
    assert all(after[f] == t for f, t in before.items())
    assert spark.read.parquet(str(base / "postings")).where("segment = 2").count() == 5  # a, b, c, d, e


@pytest.mark.parametrize("last", ["gone", "notes", "postings"])
def test_an_update_that_ends_early_changes_nothing(spark, tmp_path, monkeypatch, last):
    base, rows = str(tmp_path / "i"), make(random.Random(3), 40)
    index = text_index.build(spark.createDataFrame(rows, SCHEMA), base)
    want = [results(index, q) for q in QUERIES]
    write = text_index._write

    def ends(df, place, table, segment):
        write(df, place, table, segment)
        if table == last:
            raise KeyboardInterrupt

    monkeypatch.setattr(text_index, "_write", ends)
    new = spark.createDataFrame([(1, "x", "alpha alpha")], SCHEMA)
    with pytest.raises(KeyboardInterrupt):
        text_index.update(base, new, spark.createDataFrame([(1,), (2,)], "file long"))
    monkeypatch.undo()
    assert [results(text_index.open_index(spark, base), q) for q in QUERIES] == want
    again = text_index.update(base, new, spark.createDataFrame([(1,)], "file long"))
    same(spark, again, [(1, "x", "alpha alpha"), *(r for r in rows if r[0] != 1)], str(tmp_path / "fresh"))


def test_readers_of_the_state_before_are_not_disturbed(spark, tmp_path):
    base = str(tmp_path / "i")
    old = text_index.build(spark.createDataFrame([(1, "", "alpha"), (2, "", "alpha beta")], SCHEMA), base)
    text_index.update(base, spark.createDataFrame([(1, "", "beta")], SCHEMA), spark.createDataFrame([(1,)], "file long"), compact_at=1)
    assert [r["key"] for r in search.matching(old, "alpha").orderBy("key").collect()] == [1, 2]
    assert [r["key"] for r in search.matching(text_index.open_index(spark, base), "beta").orderBy("key").collect()] == [1, 2]
    text_index.compact(spark, base)
    assert not list((tmp_path / "i").rglob("segment=1/*.parquet"))
    with pytest.raises(FileNotFoundError):
        text_index.open_index(spark, str(tmp_path / "none"))


def test_parts_of_a_file_are_replaced_with_it(spark, tmp_path):
    schema = "key string, file string, title string, body string"
    base = str(tmp_path / "i")
    text_index.build(spark.createDataFrame([("a#0", "a", "", "one two"), ("a#1", "a", "", "two"), ("b#0", "b", "", "two")], schema), base)
    index = text_index.update(base, spark.createDataFrame([("a#0", "a", "", "three")], schema), spark.createDataFrame([("a",)], "file string"))
    assert {r["key"] for r in search.matching(index, "t").collect()} == {"a#0", "b#0"} and index.total == 2 and index.mean == 1.0


def test_snippets_are_those_of_a_plain_version(spark, tmp_path):
    rng = random.Random(7)
    words = ["claim", "claims", "stand", "résumé", "résumé", "x1", "—", "the", "of", "it", "́"]
    bodies = [(i, "", "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.choice([0, 3, 12, 80])))) for i in range(80)]
    bodies += [(100, "claim", ""), (101, "claim", " .. "), (102, "claim", None)]
    notes = spark.createDataFrame(bodies, SCHEMA)
    index = text_index.build(notes, str(tmp_path / "i"))
    for q in ("claim", "resume the", "sta claim claim"):
        want = {k: search.snippet_of(b or "", search.query_tokens(q)) for k, _, b in bodies}
        for source in (notes, index):
            got = {r["key"]: r["snippet"] for r in search.search(source, q, limit=200).collect()}
            assert got and got == {k: want[k] for k in got}
    plan = search.search(index, "claim")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


NOTES = [("a.md", "# A\n\nalpha [[B]]\n\n" + "para alpha\n\n" * 3, 1), ("b.md", "# B\n\nbeta", 1), ("c.md", "gamma beta", 1)]


def test_batches_keep_all_tables_together(spark, tmp_path, monkeypatch):
    from noteloom.operators import store, vectors
    from noteloom.streaming import index as stream_index

    base, schema = str(tmp_path / "i"), "path string, content string, mtime long"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    stream_index.apply_batch(batch(*NOTES), base)
    find = lambda table, q: {r["key"] for r in search.matching(text_index.open_index(spark, f"{base}/{table}"), q).collect()}
    assert find("text", "beta") == {"b.md", "c.md"} and find("chunk_text", "alpha") == {"a.md#0"}
    stream_index.put_vectors(base, vectors.hashed_embedding(stream_index.pending(spark, base)))
    assert stream_index.pending(spark, base).count() == 0

    publish = store.update_table

    def ends(place, *args, **kw):  # the last step of the batch never comes
        if place.endswith("/files"):
            raise KeyboardInterrupt
        publish(place, *args, **kw)

    changed = [("a.md", "# A\n\nbeta now", 2), ("b.md", None, 2), ("d.md", "delta", 2)]
    monkeypatch.setattr(store, "update_table", ends)
    with pytest.raises(KeyboardInterrupt):
        stream_index.apply_batch(batch(*changed), base)
    monkeypatch.undo()
    assert {tuple(r) for r in stream_index.indexed_files(spark, base).collect()} == {("a.md", 1), ("b.md", 1), ("c.md", 1)}  # so it is done again
    stream_index.apply_batch(batch(*changed), base)
    assert {tuple(r) for r in stream_index.indexed_files(spark, base).collect()} == {("a.md", 2), ("c.md", 1), ("d.md", 2)}
    assert find("text", "beta") == {"a.md", "c.md"} and find("text", "alpha") == set() and find("chunk_text", "b") == {"a.md#0", "c.md#0"}
    assert {r["file"] for r in stream_index.pending(spark, base).collect()} == {"a.md", "d.md"}
    assert {r["file"] for r in store.read_table(spark, f"{base}/vectors").collect()} == {"c.md"}
    stream_index.put_vectors(base, vectors.hashed_embedding(stream_index.pending(spark, base)))
    assert {r["file"] for r in store.read_table(spark, f"{base}/vectors").collect()} == {"a.md", "c.md", "d.md"}


def test_a_changed_table_is_indexed_again(spark, tmp_path):
    from noteloom.plans import indexed

    source = str(tmp_path / "t.parquet")
    rows = lambda: spark.read.parquet(source)
    open_index = lambda: indexed.text_index(spark, "test", source, rows)
    spark.createDataFrame([(1, "", "alpha")], SCHEMA).write.parquet(source)
    assert open_index().total == 1
    place = indexed._places[spark.sparkContext.applicationId, "test", source][1]
    assert open_index().total == 1 and indexed._places[spark.sparkContext.applicationId, "test", source][1] == place
    spark.createDataFrame([(2, "", "beta")], SCHEMA).write.mode("append").parquet(source)
    assert open_index().total == 2


def test_postings_are_whole_before_they_are_shuffled(spark, monkeypatch):
    """A row travels for each word of a note, whatever the number of its occurrences."""
    monkeypatch.setattr(text_index, "SORTED", 7)
    rows = [(5, "B a", "a b a  Ä a"), (2, None, None), (3, "", "x"), (1, "z", "a " * 50)]
    notes = spark.createDataFrame(rows, "key long, title string, body string").coalesce(1)
    _, posted = text_index._rows(notes)
    plan = posted._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    got = {(r["token"], r["key"], r["file"], r["n"], r["field"]): r["positions"] for r in posted.collect()}
    assert got == {
        ("b", 5, 5, 7, "title"): [0], ("a", 5, 5, 7, "title"): [1], ("a", 5, 5, 7, "body"): [0, 2, 3, 4], ("b", 5, 5, 7, "body"): [1],
        ("x", 3, 3, 1, "body"): [0], ("z", 1, 1, 51, "title"): [0], ("a", 1, 1, 51, "body"): list(range(50)),
    }
