import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.functions import text as tx
from noteloom.operators import distill
from noteloom.plans.chat import StubChat, answer, event_payloads, payload_text, probe
from noteloom.plans.distill import distill_documents


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_cluster_count(spark):
    assert [distill.cluster_count(n) for n in (60, 400, 10, 3, 0)] == [8, 24, 4, 3, 0]
    df = spark.createDataFrame([(60,), (400,), (10,), (3,), (0,)], "n int")
    assert [r[0] for r in df.select(tx.choose_k(F.col("n"))).collect()] == [8, 24, 4, 3, 0]


def test_kmeans():
    ids, x = [1, 2, 3, 10, 11, 12], np.array([[0, 0], [1, 0], [0.4, 0], [10, 10], [11, 10], [10.4, 10]])
    got = distill.kmeans(ids, x, 2)
    assert [m for m, _ in got] == [[1, 2, 3], [10, 11, 12]]
    assert distill.kmeans(ids, x, 2, representatives=1)[0][1] == [3]
    assert [m for m, _ in distill.kmeans(ids, x, 9)] == [[i] for i in ids]
    assert sum(len(m) for m, _ in distill.kmeans(ids, np.ones((6, 2)), 3)) == 6
    assert distill.kmeans(list(reversed(ids)), x[::-1], 2) == got


def test_parse_extraction():
    ok, items = distill.parse_extraction('Sure:\n```json\n{"items": [{"title": "T", "kind": "odd", "evidence": [{"chunkId": "3", "quote": "q"}, {"quote": "x"}]}, {"kind": "claim"}]}\n```')
    assert ok and items == [{"kind": "concept", "title": "T", "summary": "", "evidence": [{"chunkId": 3, "quote": "q"}], "links": []}]
    assert [distill.parse_extraction(t) for t in ("prose", "{not json", '{"x": 1}', None)] == [(False, [])] * 4


def test_locate(spark):
    at = lambda s, q: one(spark, distill.locate(F.lit(s), F.lit(q)))
    assert tuple(at("a long\n  walk home", "long walk")) == (2, 13)
    assert at("abc", "x") is None and at("abc", "  ") is None
    assert tuple(at("a (b) c", "(b)")) == (2, 5)


def test_ground(spark):
    items = spark.createDataFrame([("i", [(5, "hello there world")]), ("j", [(5, "absent"), (9, "hello")])], "item_id string, evidence array<struct<chunkId:long,quote:string>>")
    chunks = spark.createDataFrame([(5, "f.md", 1000, "hello there world and more")], "chunk_id long, file string, start long, text string")
    assert [(r["item_id"], r["start"], r["end"]) for r in distill.ground(items, chunks).collect()] == [("i", 1000, 1017)]


def test_trigrams(spark):
    s = lambda a, b: one(spark, tx.trigram_similarity(F.lit(a), F.lit(b)))
    assert s("same", "same") == 1 and s("", "") == 1
    assert s("Political lantern", "Political lanterns") > 0.5 and s("apple", "quantum field") < 0.2


def note(title, *spans, links=()):
    return {"kind": "concept", "title": title, "summary": "", "links": [{"relation": "r", "target": t} for t in links], "citations": [{"file": "f", "chunkId": 1, "start": a, "end": b, "quote": "q"} for a, b in spans]}


def test_dedup():
    got, merged = distill.dedup_notes([note("Lantern", (0, 5), links="x"), note("Lantern", (10, 15), links="xy")])
    assert merged == 1 and len(got[0]["citations"]) == 2 and len(got[0]["links"]) == 2
    assert len(distill.dedup_notes([note("One", (0, 5)), note("Entirely else", (0, 5))])[0]) == 1
    assert len(distill.dedup_notes([note("One", (0, 5)), note("Entirely else", (6, 9))])[0]) == 2
    assert len(distill.dedup_notes([note("One"), note("Entirely else")], similarity=lambda a, b: 0.95)[0]) == 1
    assert distill.dedup_notes([note("Lanterns", (0, 1)), note("Lantern", (3, 4), (5, 6))])[0][0]["title"] == "Lantern"


def test_emit(spark):
    rows = [(0, "Lantern", "concept", "S", [("is-a/kind", "Tool: x")], [("d/Almanac.md", 2, 5, 9, "a\n b")]), (1, "lantern", "claim", "", [("9", "y")], [])]
    df = spark.createDataFrame(rows, "ord int, title string, kind string, summary string, links array<struct<relation:string,target:string>>, citations array<struct<file:string,chunkId:long,start:long,end:long,quote:string>>")
    a, b = distill.render(distill.unique_names(df)).orderBy("name").collect()
    assert a["content"] == "---\nkind: concept\nsource: Almanac\ncite:\n  - chunk: 2\n    span: 5-9\n---\n\n# Lantern\n\nsource:: [[Almanac]]\nis-a_kind:: [[Tool x]]\n\nS\n\n> a b\n"
    assert b["file_name"] == "lantern 2.md" and b["content"] == "---\nkind: claim\n---\n\n# lantern 2\n"


def test_names(spark):
    assert one(spark, tx.note_name(F.lit("Checks/balances: ambition #1"))) == "Checks balances ambition 1"
    assert one(spark, tx.note_name(F.lit("///"))) == "untitled"
    assert [one(spark, tx.is_safe_run_id(F.lit(x))) for x in ("../evil", "a/b", ".hidden", "a..b", "", "sapiens")] == [False] * 5 + [True]
    assert one(spark, tx.run_id(F.lit("x/Old Almanac (2).pdf"))) == "Old-Almanac-2"


def test_run(spark):
    text = "# Almanac\n\n" + "\n\n".join(f"## Part {i}\n\nThe {w} of part {i} is told here at length." for i, w in enumerate(("river", "mountain", "harbour", "forest", "desert", "city")))
    run = distill_documents(spark.createDataFrame([("b/almanac.md", text)], "path string, content string"))
    names = {r["name"]: r["content"] for r in run.rendered.collect()}
    assert names and all("source:: [[almanac]]" in c for c in names.values())
    assert run.stats()["chunks"] == 6 and run.stats()["failed"] == 0
    starts = [(c["start"], c["end"], c["quote"]) for r in run.notes.collect() for c in r["citations"]]
    lead = 1  # spans count from the chunk's first line, whose blank start the text has lost
    assert all(text[s + lead : e + lead] == q for s, e, q in starts)


def test_model_streams():
    lines = ["event: x", 'data: {"delta": {"text": "a"}}', "data: oops", 'data: {"choices": [{"delta": {"content": "b"}}]}', "data: [DONE]", 'data: {"delta": {"text": "c"}}']
    assert [payload_text(x) for x in event_payloads(iter(lines))] == ["a", "b"]
    assert probe(StubChat(), 5)
    assert answer(StubChat(), "what\n\nctx") == answer(StubChat(), "what\n\nctx")


def test_similar_titles(spark):
    df = spark.createDataFrame([("red widget",), ("red widgets",), ("blue",), (None,), ("red widget",)], "title string")
    assert [(r["a"], r["b"]) for r in distill.similar_titles(df).collect()] == [("red widget", "red widgets")]
    assert distill.similar_titles(df.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ["no json", '{"items": 3}'])
def test_extract_retries_once(spark, bad):
    df = spark.createDataFrame([("f", 0, "p")], "file string, cluster int, prompt string")
    replies = {"p": bad}
    got = distill.extract(df, lambda p: replies.get(p, '{"items": [{"title": "T"}]}')).first()
    assert got["ok"] and got["items"][0]["title"] == "T"


def plain_dedup(notes, threshold=0.6):
    """Groups by comparing every note with every member of every group."""

    def grams(t):
        t = f"  {t.strip().lower()} "
        return {t[i : i + 3] for i in range(len(t) - 2)} if t.strip() else set()

    def alike(a, b):
        x, y = grams(a["title"]), grams(b["title"])
        same = (len(x & y) / len(x | y) if x | y else 1.0) >= threshold
        return same or any(c["file"] == d["file"] and c["start"] < d["end"] and d["start"] < c["end"] for c in a["citations"] for d in b["citations"])

    groups = []
    for n in notes:
        home = next((g for g in groups if any(alike(m, n) for m in g)), None)
        groups.append([n]) if home is None else home.append(n)
    return [max(enumerate(g), key=lambda p: (len(p[1]["citations"]), -p[0]))[1]["title"] for g in groups]


def test_dedup_against_plain_loops():
    import random

    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "alphas", "betas", "", " "]
    for _ in range(20):
        notes = [{"title": " ".join(r.choice(words) for _ in range(r.randrange(1, 4))), "links": [], "citations": [{"file": r.choice("ab"), "chunkId": 0, "start": (at := r.randrange(200)), "end": at + r.randrange(1, 8)} for _ in range(r.randrange(3))]} for _ in range(60)]
        got, merged = distill.dedup_notes(notes)
        assert [n["title"] for n in got] == plain_dedup(notes) and merged == 60 - len(got)


def test_broken_chunk_numbers_ground_nothing():
    ok, items = distill.parse_extraction('{"items": [{"title": "t", "evidence": [{"chunkId": 1.5, "quote": "q"}, {"chunkId": "2", "quote": "q"}, {"chunkId": true, "quote": "q"}]}]}')
    assert ok and [e["chunkId"] for e in items[0]["evidence"]] == [2]


def test_cancel_ends_tagged_jobs(spark):
    import threading

    from noteloom.plans.distill import cancel, cancellable

    threading.Timer(3, lambda: cancel(spark, "run-1")).start()
    with pytest.raises(Exception, match="(?i)cancel"), cancellable(spark, "run-1"):
        spark.range(4, numPartitions=4).rdd.foreach(lambda _: __import__("time").sleep(60))


@pytest.mark.parametrize(("dialect", "variable"), [("messages", ""), ("completions", ""), ("completions", "NOTE_TEST_KEY")])
def test_dialects(dialect, variable, monkeypatch):
    import http.server
    import json
    import threading

    from noteloom.plans.chat import HttpChat, answer

    seen = {}

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.update(path=self.path, headers={k.lower(): v for k, v in self.headers.items()}, body=json.loads(self.rfile.read(int(self.headers["content-length"]))))
            piece = (lambda t: {"delta": {"text": t}}) if dialect == "messages" else (lambda t: {"choices": [{"delta": {"content": t}}]})
            self.send_response(200)
            self.end_headers()
            for t in ("one ", "two"):
                self.wfile.write(f"event: x\ndata: {json.dumps(piece(t))}\n\n".encode())
            self.wfile.write(b"data: [DONE]\n\n")

        def log_message(self, *a):
            pass

    monkeypatch.setenv("NOTE_TEST_KEY", "from the environment")
    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert answer(HttpChat(dialect, "m", f"http://127.0.0.1:{server.server_port}/", key="k", key_variable=variable, headers={"x-more": "1"}), "hi") == "one two"
    finally:
        server.shutdown()
    assert seen["body"]["model"] == "m" and seen["body"]["messages"][0]["content"] == "hi" and seen["headers"]["x-more"] == "1"
    sent = seen["headers"].get("x-api-key") or seen["headers"]["authorization"].removeprefix("Bearer ")
    assert sent == ("from the environment" if variable else "k")
    with pytest.raises(ValueError, match="dialect"):
        HttpChat("other", "m", "http://localhost").request("hi")


def test_the_rule_comes_with_every_prompt(spark):
    asked = spark.sparkContext.accumulator(0)

    def ask(prompt):
        asked.add(distill.RULE in prompt and "JSON" in prompt and prompt.endswith(("text", "broken")))
        return "broken"

    rows = spark.createDataFrame([("a", 0, "[chunk 1] h\ntext")], "file string, cluster int, prompt string")
    assert [tuple(r) for r in distill.extract(rows, ask).select("ok", "items").collect()] == [(False, [])]
    assert asked.value == 2
    assert "[chunk " not in distill.RULE


def test_counters_and_phases_of_a_run(spark):
    documents = spark.createDataFrame([(f"b/{i}.md", "\n\n".join(f"# Part {j}\n\nThing {j} of {i} is made of matter {j * i}." for j in range(5))) for i in range(3)], "path string, content string")
    asked = spark.sparkContext.accumulator(0)

    def ask(prompt):
        from noteloom.plans.chat import StubChat, answer

        asked.add(1)
        return answer(StubChat(), prompt)

    told = []
    run = distill_documents(documents, ask).execute(lambda phase, done, of: told.append((phase, done, of)))
    assert told == [("embed", 0, 6), ("cluster", 1, 6), ("extract", 2, 6), ("ground", 3, 6), ("merge", 4, 6), ("emit", 5, 6), ("done", 6, 6)]
    n = run.stats()
    want = {"chunks": run.chunks.count(), "clusters": run.clusters.count(), "failed": 0, "extracted": run.each.count(), "grounded": run.cited.count(), "notes": run.notes.count()}
    assert n == want | {"dropped": want["extracted"] - want["grounded"], "merged": want["grounded"] - want["notes"]} and n["chunks"] == 15
    assert run.rendered.count() == n["notes"]
    assert asked.value == n["clusters"]  # the model was asked once for each cluster, whatever was counted
    run.release()


def test_vector_model(spark, tmp_path):
    import numpy as np

    from noteloom.operators import vector_model

    path = str(tmp_path / "m.npz")
    np.savez(path, tokens=np.array(["dimension", "a", "b"]), vectors=np.array([[1, 1, 0], [3, 0, 0], [0, 4, 0]], np.float32))
    opens = spark.sparkContext.accumulator(0)

    class Model(vector_model.TokenTable):
        def token_vectors(self, texts):
            assert len(texts) <= 32
            return super().token_vectors(texts)

    def open_model():
        opens.add(1)
        return Model.load(path)

    texts = ["a", "A b", "b unknown", "unknown", "", None] + ["a a b"] * 200
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    assert vector_model.probed_dims(spark, "test", open_model) == 3
    for _ in range(2):
        got = {r["i"]: r["embedding"] for r in vector_model.embedded(df, "text", "test", open_model).collect()}
        assert got[0] == [1, 0, 0] and got[1] == pytest.approx([0.6, 0.8, 0]) and got[2] == [0, 1, 0]
        assert got[3] == got[4] == got[5] == [0, 0, 0] and got[205] == pytest.approx([6 / 52**0.5, 4 / 52**0.5, 0])
    assert opens.value <= 4  # at most once per Python worker, of which the session has four
    with pytest.raises(Exception, match="its probe 2"):
        vector_model.embedded(df, "text", "test", open_model, dims=2).count()
    run = distill_documents(spark.createDataFrame([("n.md", "# T\n\na b\n\n# U\n\nb")], "path string, content string"), embed=lambda c: vector_model.embedded(c, "embed_text", "test", open_model))
    assert sorted([round(v, 6) for v in r["embedding"]] for r in run.chunks.select("embedding").collect()) == [[0, 1, 0], [0.6, 0.8, 0]]
    run.release()


def test_groups_over_arrow_batches(spark):
    """Small groups share batches, a group of many batches is whole, and rows come in order."""
    from noteloom.operators.workspace import grouped

    sizes = {"a": 1, "b": 7, None: 5, "c": 1, "d": 23}
    df = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in reversed(range(n))], "k string, v long")
    run = lambda t: [{"k": t["k"][0].as_py(), "vs": t["v"].to_pylist()}]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 3, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = grouped(df, "k", ["v"], run, "k string, vs array<long>").collect()
            assert len(got) == 5 and {r["k"]: r["vs"] for r in got} == {k: list(range(n)) for k, n in sizes.items()}
            assert grouped(df.limit(0), "k", ["v"], run, "k string, vs array<long>").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_documents_share_python_batches(spark):
    """No step of a run makes a pandas frame for each document."""
    run = distill_documents(spark.createDataFrame([("n.md", "# T\n\na b\n\n# U\n\nb")], "path string, content string"))
    for _, df in run.phases:
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    run.release()
