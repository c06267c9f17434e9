import io
import time
import zipfile
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noteloom.functions import text as tx
from noteloom.operators import markdown, store, telemetry
from noteloom.sources import convert, settings, vault
from noteloom.streaming import index as stream_index
from noteloom.streaming import telemetry as stream_telemetry


def test_merge_and_undo(spark):
    v = spark.createDataFrame([("a.md", "A")], "path string, content string")
    run = spark.createDataFrame([("x.md", "X"), ("y.md", "Y")], "file_name string, content string")
    merged, manifest = store.merge_run(v, run, "almanac")
    assert {r["path"] for r in merged.collect()} == {"a.md", "Distilled/almanac/x.md", "Distilled/almanac/y.md"}
    assert store.undo_merge(merged, manifest, "almanac").collect() == v.collect()


def test_rechunk_only_what_changed(spark):
    n = lambda rows: spark.createDataFrame(rows, "path string, content string")
    old = n([("a.md", "one"), ("b.md", "two"), ("gone.md", "x")])
    chunks, known = markdown.chunks(old), store.hashes(old)
    vec = chunks.select("file", "ord", F.array(F.lit(1.0)).alias("embedding"))
    new = n([("a.md", "one"), ("b.md", "two!"), ("c.md", "three")])
    chunks, vec, known = store.rechunk(chunks, vec, known, new, markdown.chunks)
    assert {(r["file"], r["text"]) for r in chunks.collect()} == {("a.md", "one"), ("b.md", "two!"), ("c.md", "three")}
    assert {r["file"] for r in vec.collect()} == {"a.md"} and {r["file"] for r in store.pending(chunks, vec).collect()} == {"b.md", "c.md"}
    with pytest.raises(Exception, match="2 elements"):
        store.put_vectors(vec, vec, 2).collect()
    assert store.put_vectors(vec, vec, 1).count() == 1


def test_upsert_repath_relation(spark):
    t = spark.createDataFrame([("d/a.md", 1), ("d2/b.md", 1)], "path string, mtime long")
    assert {tuple(r) for r in store.upsert(t, spark.createDataFrame([("d/a.md", 3)], "path string, mtime long"), "path", "mtime").collect()} == {("d/a.md", 3), ("d2/b.md", 1)}
    assert {r["path"] for r in store.repath(t, "d", "e").collect()} == {"e/a.md", "d2/b.md"}
    n = spark.createDataFrame([("a.md", "text")], "path string, content string")
    assert store.add_relation(n, "a.md", "cites", "B").first()["content"] == "text\ncites:: [[B]]\n"
    with pytest.raises(ValueError):
        store.add_relation(n, "a.md", "9x", "B")


def test_versions(spark, tmp_path):
    base = str(tmp_path / "t")
    for k in (1, 2):
        store.write_table(spark.range(k), base)
        assert store.read_table(spark, base).count() == k


def test_states_are_whole_and_few(spark, tmp_path):
    base, kind = str(tmp_path / "t"), "path string, v int"
    df = lambda *rows: spark.createDataFrame(list(rows), kind)
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, base)
    first = [(f"n{i}", i) for i in range(200)]
    store.update_table(base, df(*first), df(*first), buckets=8)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = store.read_table(spark, base)
    for _ in range(2):  # twice is as good as once
        store.update_table(base, df(("n3", 33), ("new", 1)), df(("n3", 0), ("new", 0), ("n7", 0)))
        want = {**dict(first), "n3": 33, "new": 1}
        del want["n7"]
        assert dict(map(tuple, store.read_table(spark, base).collect())) == want
        if _ == 0:
            assert before.count() == 200  # a reader of the state before is not disturbed
    left = {f for f in files if f.exists()}
    assert 0 < len(left) < len(files) and all(files[f] == f.stat().st_mtime_ns for f in left)  # untouched buckets stay where they are
    assert len(list((tmp_path / "t").glob("manifest-*"))) == 2
    store.update_table(base, df().limit(0), df(*first, ("new", 0)))
    assert store.read_table(spark, base).count() == 0
    store.write_table(df(("a", 1)), str(tmp_path / "chunks"))
    store.drop_tables(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, str(tmp_path / "chunks"))


def test_vault_changes(spark, tmp_path):
    root, base = str(tmp_path / "v"), str(tmp_path / "i")
    vault.write(spark, root, "a.md", "# A\n\n[[B]]")
    vault.write(spark, root, "d/b.md", "# B")
    vault.write(spark, root, "_c.md", "c")
    titles = lambda: {(r["path"], r["title"]) for r in store.read_table(spark, f"{base}/files").collect()}
    assert stream_index.refresh(spark, root, base, 0) == 3 and titles() == {("a.md", "A"), ("d/b.md", "B"), ("_c.md", "_c")}
    assert stream_index.refresh(spark, root, base, 0) == 0
    time.sleep(0.05)
    vault.write(spark, root, "a.md", "# A2")
    assert vault.delete(spark, root, "_c.md")
    assert stream_index.refresh(spark, root, base, 0) == 2 and titles() == {("a.md", "A2"), ("d/b.md", "B")}
    assert store.read_table(spark, f"{base}/triples").count() == 0
    stream_index.rename(spark, root, base, "d", "e/f")
    assert titles() == {("a.md", "A2"), ("e/f/b.md", "B")} and stream_index.refresh(spark, root, base, 0) == 0
    for bad in (lambda: vault.write(spark, root, "../x.md", ""), lambda: vault.delete(spark, root, "/x"), lambda: stream_index.rename(spark, root, base, "a.md", "../b.md"), lambda: vault.move(spark, root, "a.md", "e/f/b.md")):
        with pytest.raises(ValueError):
            bad()
    assert [r["content"] for r in vault.note(spark, root, "e/f/b.md").collect()] == ["# B"] and vault.note(spark, root, "none.md").count() == 0
    told = []
    vault.write(spark, root, "new.md", "# New")
    q = stream_index.watch(spark, root, base, str(tmp_path / "cp"), 1, told.append)
    for _ in range(120):
        if told:
            break
        time.sleep(0.5)
    q.stop()
    assert told == [1] and ("new.md", "New") in titles()
    assert {r["path"] for r in vault.notes(spark, "file://" + root).collect()} == {"a.md", "e/f/b.md", "new.md"}


def test_the_driver_lists_no_folder_that_workers_can(spark, tmp_path, monkeypatch):
    """Few folders may hold most of the files, so their number does not say who lists them; nor does Spark's scan, whose list is the driver's."""
    (tmp_path / "d" / "_e").mkdir(parents=True)
    for i in range(50):
        (tmp_path / "d" / f"n{i}.md").write_text(f"n{i}")
    (tmp_path / "d" / "_e" / "o.MD").write_bytes(b"\xc3\xa4")
    (tmp_path / "d" / ".no.md").write_text("")
    monkeypatch.setattr(vault, "_list", None)
    monkeypatch.setattr(vault, "_relative", None)
    got = {r["path"]: r["content"] for r in vault.notes(spark, str(tmp_path)).collect()}
    assert got == {f"d/n{i}.md": f"n{i}" for i in range(50)} | {"d/_e/o.MD": "ä"}
    assert vault.scan(spark, str(tmp_path)).count() == 51 and vault.folders(spark, str(tmp_path)).count() == 2


def test_only_changed_notes_are_opened(spark, tmp_path):
    root = tmp_path / "v"
    for i in range(40):  # enough folders for executors to list
        (root / f"d{i}" / "e").mkdir(parents=True)
        (root / f"d{i}" / "e" / "n.md").write_text("x" * 50_000)
    (root / "d1" / "_odd.md").write_text("y" * 50_000)
    (root / ".git").mkdir()
    (root / ".git" / "no.md").write_text("z")
    known = vault.notes(spark, str(root)).select("path", "mtime")
    known = spark.createDataFrame(known.collect(), known.schema)
    assert known.count() == 41 and vault.changes(spark, str(root), known).count() == 0
    spread = {tuple(r) for r in vault.listing(spark, str(root)).collect()}
    assert spread == {tuple(r) for r in vault.listing(spark, str(root), 10_000).collect()} and len(spread) == 40 * 3 + 1
    (root / "d3" / "e" / "n.md").write_text("changed")
    (root / "d4" / "e" / "n.md").unlink()
    (root / "d5" / "e" / "new.md").write_text("new")
    opened = spark.sparkContext.accumulator(0)
    opener = vault._opener

    def counted(place):
        system, top = opener(place)

        class System:
            def open_input_stream(self, path):
                opened.add(1)
                return system.open_input_stream(path)

            def get_file_info(self, what):
                return system.get_file_info(what)

        return System(), top

    vault._opener = counted
    try:
        got = {(r["path"], r["content"]) for r in vault.changes(spark, str(root), known).collect()}
    finally:
        vault._opener = opener
    assert got == {("d3/e/n.md", "changed"), ("d4/e/n.md", None), ("d5/e/new.md", "new")} and opened.value == 2


def test_settings_are_edited_in_place():
    text = '# mine\ntheme = "dark"  # so\n\n[chat]\nmodel = "x"\n\n[telemetry]\nenabled = true\n'
    one = settings.edited(text, "chat.model", 'y "z"')
    assert settings.parse(one).chat.model == 'y "z"' and one.replace('model = "y \\"z\\""', 'model = "x"') == text
    assert settings.parse(settings.edited(text, "theme", "light")).theme == "light"
    assert settings.parse(settings.edited(text, "chat.provider", "openai")).chat.provider == "openai"
    assert settings.parse(settings.edited(text, "semantic.min_score", 0.7)).semantic.min_score == 0.7
    assert settings.parse(settings.edited("", "telemetry.enabled", True)).telemetry.enabled is True


def test_sparkline(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 15.0)], "at int, ms double")
    assert {r["at"]: r["level"] for r in telemetry.sparkline(df).collect()} == {1: 0, 2: 16, 3: 8}
    assert {r["level"] for r in telemetry.sparkline(df.where("at = 1")).collect()} == {8}


def test_vault_scan(spark, tmp_path):
    for name, text in {"b.md": "# B", "sub/A.MD": "[[b]]", "_x.md": "u", ".hidden/c.md": "no", "sub/n.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r["rel"] for r in vault.scan(spark, str(tmp_path)).collect()} == {"b.md", "sub/A.MD", "_x.md"}
    assert {(r["path"], r["content"]) for r in vault.notes(spark, str(tmp_path)).collect()} == {("b.md", "# B"), ("sub/A.MD", "[[b]]"), ("_x.md", "u")}
    assert [r["rel"] for r in vault.folders(spark, str(tmp_path)).collect()] == ["sub"]
    assert [vault.inside(p) for p in ("a/b.md", "../x", "/x", "a/.git/x", "")] == [True, False, False, False, False]


def test_stream_index(spark, tmp_path):
    src, base = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "path string, content string, mtime long"
    spark.createDataFrame([("a.md", "# A\n\n[[B]]", 1), ("b.md", "x", 1)], schema).coalesce(1).write.parquet(str(src / "1"))
    run = lambda: stream_index.start(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src)), base, str(tmp_path / "cp"))
    q = run()
    q.processAllAvailable()
    spark.createDataFrame([("a.md", "# A2", 2), ("b.md", None, 2)], schema).coalesce(1).write.parquet(str(src / "2"))
    time.sleep(0.1)
    q.processAllAvailable()
    q.stop()
    assert [(r["path"], r["title"]) for r in store.read_table(spark, f"{base}/files").collect()] == [("a.md", "A2")]
    assert store.read_table(spark, f"{base}/triples").count() == 0


def test_telemetry(spark):
    now = datetime(2026, 1, 1, 23, 58)
    df = spark.createDataFrame([(now + timedelta(minutes=i), float(ms)) for i, ms in enumerate((0.2, 0.5, 1.5, 3, 5000))], "at timestamp, ms double")
    s = telemetry.summary(df).first()
    assert (s["count"], s["max"], s["p99"]) == (5, 5000, 5000) and s["mean"] == pytest.approx(1001.04)
    assert {r["bucket"]: r["n"] for r in telemetry.histogram(df).collect() if r["n"]} == {0: 2, 1: 1, 2: 1, 13: 1}
    ms = spark.createDataFrame([(float(x),) for x in (0, 0.4, 1, 1.9, 2, 4096, 8192, 60000)], "ms double")
    assert [r[0] for r in ms.select(tx.lag_bucket(F.col("ms"))).collect()] == [0, 0, 1, 1, 2, 13, 14, 14]
    hundred = spark.range(100).select(F.current_timestamp().alias("at"), F.col("id").cast("double").alias("ms"))
    assert telemetry.summary(hundred).first()["p99"] == 99
    assert [r["n"] for r in telemetry.rolling(df, 2).orderBy("at").collect()] == [1, 2, 3, 3, 3]  # over midnight too
    assert telemetry.summary(df.limit(0)).first()["count"] == 0
    assert [r["ms"] for r in telemetry.worst(df, 2).collect()] == [5000, 3]


def test_rolling_stream(spark, tmp_path):
    rows = [(datetime(2026, 1, 1, 0, m), float(v)) for m, v in ((1, 1), (2, 9000), (40, 2), (59, 1))]
    spark.createDataFrame(rows, "at timestamp, ms double").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("at timestamp, ms double").parquet(str(tmp_path / "in"))
    q = stream_telemetry.rolling_histogram(src, slide="5 minutes").writeStream.format("memory").queryName("lag").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["bucket"], r["n"]) for r in spark.table("lag").where("window.start = '2026-01-01 00:00:00'").collect()} == {(1, 1), (14, 1)}


def test_progress_and_recents(spark):
    p = lambda rows: spark.createDataFrame(rows, "loaded long, total long").agg(telemetry.progress(F.col("loaded"), F.col("total"))).first()[0]
    assert p([(50, 100), (10, 10)]) == pytest.approx(60 / 110) and p([]) is None and p([(120, 100)]) == 1
    r = spark.createDataFrame([(f"p{i}", i) for i in range(10)], "path string, at long")
    got = [x["path"] for x in store.merge_recents(r, spark.createDataFrame([("p3", 99)], "path string, at long")).collect()]
    assert got[0] == "p3" and len(got) == 10
    assert "p0" not in [x["path"] for x in store.merge_recents(r, spark.createDataFrame([("new", 99)], "path string, at long")).collect()]


def epub(order, pages):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{k}" href="{k}.xhtml#x"/>' for k in pages)
        z.writestr("o/p.opf", f"<package><manifest>{items}</manifest><spine>{''.join(f'<itemref idref=%r/>' % k for k in order)}</spine></package>")
        for k, t in pages.items():
            z.writestr(f"o/{k}.xhtml", f"<html><head><title>t</title></head><body>{t}</body></html>")
    return out.getvalue()


def pdf(text):
    s = zlib.compress(f"BT /F1 12 Tf ({text}) Tj ET".encode())
    return b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <</Filter /FlateDecode /Length " + str(len(s)).encode() + b">>\nstream\n" + s + b"\nendstream\nendobj\n"


def test_convert(spark):
    data = epub(["b", "a", "e"], {"a": "<h1>One</h1><p>x <b>y</b></p>", "b": "<p>first</p>", "e": ""})
    assert convert.epub_to_markdown(data) == "## Section 1\n\nfirst\n\n## Section 2\n\n# One\n\nx **y**\n"
    assert convert.pdf_to_markdown(pdf("Hello")) == "## Page 1\n\nHello\n"
    rows = [("a.md", b"# x"), ("b.pdf", pdf("")), ("c.epub", b"zip?"), ("d.doc", b""), ("e.epub", data)]
    got = {r["path"]: r for r in convert.convert(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.md"]["content"] == "# x" and all(got[k]["error"] and got[k]["content"] is None for k in ("b.pdf", "c.epub", "d.doc")) and got["e.epub"]["error"] is None


def test_pdf_pages_follow_the_page_tree():
    text = lambda n, t: f"{n} 0 obj <</Length 9>>\nstream\nBT ({t}) Tj ET\nendstream\nendobj\n"
    page = lambda c: f"<</Type /Page /Contents {c} 0 R>>"
    tree = "1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [5 0 R 6 0 R] /Count 3>> endobj\n6 0 obj <</Type /Pages /Parent 2 0 R /Kids [4 0 R 3 0 R]>> endobj\n"
    plain = "%PDF-1.4\n" + "".join(f"{n} 0 obj {page(n + 10)} endobj\n" for n in (3, 4, 5)) + "".join(text(n + 10, t) for n, t in ((3, "last"), (4, "middle"), (5, "first")))
    assert convert.pdf_to_markdown((plain + tree).encode()) == "## Page 1\n\nfirst\n\n## Page 2\n\nmiddle\n\n## Page 3\n\nlast\n"
    assert convert.pdf_to_markdown(plain.encode()).split("\n")[2] == "last"  # no tree: the file's order
    inner = [page(13), "<</Type /Catalog /Pages 2 0 R>>", "<</Type /Pages /Kids [3 0 R]>>"]
    starts = [0, len(inner[0]) + 1, len(inner[0]) + len(inner[1]) + 2]
    head = " ".join(f"{n} {at}" for n, at in zip((3, 1, 2), starts)) + " "
    packed = zlib.compress((head + " ".join(inner)).encode())
    stream = f"9 0 obj <</Type /ObjStm /N 3 /First {len(head)} /Filter /FlateDecode /Length {len(packed)}>>\nstream\n".encode() + packed + b"\nendstream\nendobj\n"
    assert convert.pdf_to_markdown(b"%PDF-1.5\n" + stream + text(13, "packed").encode()) == "## Page 1\n\npacked\n"


def test_html_heads_code_and_numbers():
    assert convert.html_to_markdown("<html><head><title>x</title><body><h1>T</h1><p>hi there</p>") == "# T\n\nhi there"
    assert convert.html_to_markdown("<head><title>x</title><meta a><p>text</p>") == "text"
    assert convert.html_to_markdown("<pre>a  b\n   c <b>d</b>\n</pre><p>e</p>") == "```\na  b\n   c d\n```\n\ne"
    assert convert.html_to_markdown("<ol><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ol><ul><li>e</li></ul>").split() == "1. a 2. b - c 3. d - e".split()


def test_settings_values_of_several_lines():
    text = 'a = [\n [1, 2],  # ]\n "k = 3",\n]\nk = 1\n[t]\ns = """\n[x]\nk = 9\n"""\nk = 2\n'
    assert settings.edited(text, "k", 5) == text.replace("\nk = 1\n", "\nk = 5\n")
    assert settings.edited(text, "t.k", 5) == text.replace("\nk = 2\n", "\nk = 5\n")
    assert settings.edited(text, "a", True) == "a = true\n" + text.partition("]\nk")[1][2:] + text.partition("]\nk")[2]
    assert settings.edited("a = [\n1,\n]\n", "b", 2) == "a = [\n1,\n]\nb = 2\n"


def test_settings():
    s = settings.parse('theme = "dark"\n[semantic]\nenabled = true\nmin_score = 7\n[chat]\nprovider = "odd"\nmodel = "m"')
    assert s.theme == "dark" and s.semantic.enabled and s.semantic.min_score == 0.5 and s.chat.provider == "ollama" and s.chat.model == "m"
    assert settings.parse("not toml [") == settings.Settings()


def test_recents_list():
    assert settings.recents('["a", 1, "b", "gone"]', lambda p: p != "gone") == ["a", "b"]
    assert settings.recents("{") == settings.recents('{"a": 1}') == []


def test_vector_status(spark):
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "file string, ord int")
    have = spark.createDataFrame([("a", 0, [1.0])], "file string, ord int, embedding array<double>")
    assert tuple(store.vector_status(chunks, have).first()) == (3, 1, 2)
    assert store.set_dims(have, 1, 1).count() == 1 and store.set_dims(have, 1, 2).count() == 0
