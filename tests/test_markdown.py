from pyspark.sql import functions as F

from noteloom.operators import markdown as m


def harvest(content, path="v/Note.md"):
    return m.harvest_note(path, content)


def test_title_is_the_first_h1_or_the_name():
    assert harvest("# My Title\n\nbody")[0] == "My Title"
    assert harvest("no heading", "Some File.md")[0] == "Some File"
    assert harvest("#\n\n## x\n\n# Real")[0] == "Real"


def test_links_in_order_without_alias_and_heading():
    assert harvest("see [[A|x]] and [[B#top]]")[1] == [("Note", "links_to", "A"), ("Note", "links_to", "B")]


def test_fields_come_after_links():
    got = harvest("author:: [[Jane Doe]]\nstatus:: draft\n> kind:: book\n- not:: field")[1]
    assert got == [("Note", "links_to", "Jane Doe"), ("Note", "author", "Jane Doe"), ("Note", "status", "draft"), ("Note", "kind", "book")]


def test_code_hides_links_and_fields():
    assert harvest("```\n[[No]]\nin:: code\n```\nsee [[Yes]]")[1] == [("Note", "links_to", "Yes")]
    assert harvest("`[[no]]` and [[yes]]")[1] == [("Note", "links_to", "yes")]
    assert harvest("text\n\n    [[indented]]\n\n[[yes]]")[1] == [("Note", "links_to", "yes")]


def test_link_grammar():
    assert m.inline_links("[[a [b]] [[]] [[c\nd]] \\[[e]]") == ["c\nd"]
    assert harvest("x:: [[A]] and [[B]]")[1][-1] == ("Note", "x", "A]] and [[B")


def test_chunks_follow_headings():
    got = m.chunk_markdown("# Title\n\nintro\n\n## Section A\n\nbody")
    assert [(h, t) for h, _, _, t in got] == [("Title", "intro"), ("Title > Section A", "body")]
    assert m.chunk_markdown("# only") == []
    text = "# Title\n\nintro\n\n## Section A\n\nbody"
    assert all(text[s:e].strip() == t for _, s, e, t in got)


def test_chunks_are_packed():
    got = m.chunk_markdown("# H\n\n" + "\n\n".join("x" * 40 for _ in range(3)), 60)
    assert len(got) > 1 and {h for h, *_ in got} == {"H"}


def test_map():
    title, nodes, edges = m.parse_map("# The [[Map|map]]\n- [[A|first]]\n  - b\n\t- c\n- [[D#x]]\n## Edges\n- [[A]] leads to [[D]]\n- junk")
    assert title == "The map"
    assert [(n[4], n[5], n[1], n[3]) for n in nodes] == [("first", "A", None, 0), ("b", None, 0, 1), ("c", None, 0, 1), ("D", "D", None, 0)]
    assert edges == [("A", "leads to", "D")]


def test_citations(spark):
    note = "---\nkind: concept\nsource: book.md, other\ncite:\n  - chunk: 3\n    span: 10-20\n  - chunk: 4\n    span: 50-50\n---\n# x\n"
    df = spark.createDataFrame([("a.md", note), ("b.md", "no front matter")], "path string, content string")
    assert [tuple(r) for r in m.citations(df).collect()] == [("a.md", "book", 3, 10, 20)]


def test_table_functions(spark):
    m.register(spark)
    rows = spark.sql("SELECT * FROM harvest_triples('N.md', 'a:: [[B]]')").collect()
    assert {tuple(r) for r in rows} == {("N", "links_to", "B"), ("N", "a", "B")}
    assert spark.sql("SELECT heading FROM chunk_markdown('# H\n\nx')").first()[0] == "H"
    assert spark.sql("SELECT count(*) FROM map_outline('- a\n  - b')").first()[0] == 2


def test_file_tree(spark):
    df = spark.createDataFrame([("a/b/c/Note.md",), ("d/x.md",), ("d/e/y.md",), ("root.md",)], "rel string")
    got = {r["folder"]: (r["parent"], r["name"], r["files"], r["folders"]) for r in m.file_tree(df).collect()}
    assert got == {"a/b/c": ("", "a/b/c", 1, 0), "d": ("", "d", 1, 1), "d/e": ("d", "e", 1, 0)}


def test_external_links(spark):
    df = spark.createDataFrame([("a.md", "see [site](https://x.org/a) ![i](https://x.org/i.png) <https://y.org>")], "path string, content string")
    assert {tuple(r)[1:] for r in m.external_links(df).collect()} == {("site", "https://x.org/a"), ("https://y.org", "https://y.org")}


def test_spans(spark):
    text = "# Head\n**b** and *i* `co*d*e` [[A|x]] [l](u)\n```\n**no**\n```\n"
    got = [(text[a:b], k, t, n) for a, b, k, t, n in m.note_spans(text)]
    assert got == [("# Head", "heading", None, 1), ("**b**", "strong", None, None), ("*i*", "emphasis", None, None), ("`co*d*e`", "code", None, None), ("[[A|x]]", "wikilink", "A", None), ("[l](u)", "link", "u", None)]
    df = spark.createDataFrame([("n.md", text), ("o.md", None)], "path string, content string")
    assert m.spans(df).count() == 6


def test_chunks_are_handed_over_in_bounded_parts(monkeypatch):
    """What a worker holds does not grow with the texts of an Arrow batch."""
    taken = []

    class Notes:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            taken.append(run)

    monkeypatch.setattr(m, "HANDED", 100)
    m.chunks(Notes())
    f = m.pd.DataFrame({"path": list("abcdef"), "content": ["x" * 60, None, "y" * 60, "", "z" * 60, "w" * 60]})
    parts = list(taken[0](iter([f])))
    assert [len(x) for x in parts] == [2, 2, 0]
    assert [(r.file, r.ord, r.text) for x in parts for r in x.itertuples()] == [(p, 0, c * 60) for p, c in (("a", "x"), ("c", "y"), ("e", "z"), ("f", "w"))]


def test_notes_of_one_small_file_are_dealt_to_all_cores(spark, tmp_path):
    from noteloom.plans.queries import QUERIES

    spark.createDataFrame([(i, f"part {i}", f"Brand#{i % 5}", "LARGE") for i in range(500)], "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["typed_fields"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    assert got.count() == 2000 and got.select("task").distinct().count() == 4


def test_inline_links_against_a_walk_over_characters():
    import random
    import re

    def plain(text):
        out, i = [], 0
        while i < len(text):
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                run = len(re.match("`+", text[i:])[0])
                close = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(text, i + run)
                i = close.end() if close else i + run
            elif link := re.match(r"\[\[((?:[^\[\]]|\](?!\]))+)\]\]", text[i:]):
                out.append(link[1])
                i += link.end()
            else:
                i += 1
        return out

    r = random.Random(5)
    for _ in range(20_000):
        text = "".join(r.choice("[[]]]`\\ab|") for _ in range(r.randrange(16)))
        assert m.inline_links(text) == plain(text), text
