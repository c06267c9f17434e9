import time

import pytest

from noteloom.operators.markdown import chunk_markdown
from noteloom.streaming import stateful

SCHEMA = "path string, content string, mtime long"


def until(ready, seconds=90):
    for _ in range(seconds * 5):
        if ready():
            return
        time.sleep(0.2)
    raise AssertionError("nothing came")


@pytest.fixture
def stream(spark, tmp_path):
    source, got = tmp_path / "in", []
    source.mkdir()

    def put(*rows):
        put.n = getattr(put, "n", 0) + 1
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(str(source / str(put.n)))

    def start(settle_ms):
        changes = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(source))
        q = stateful.upkeep(changes, settle_ms, batch=32, most=40).writeStream.foreachBatch(lambda df, _: got.extend(df.collect()))
        return q.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()

    return put, start, got


def test_settle_rechunk_once_and_exact_batches(stream):
    put, start, got = stream
    long = "\n\n".join(f"paragraph number {i} of a note" for i in range(70))
    chunks = chunk_markdown(long, 40)
    assert len(chunks) == 70
    put(("a.md", "draft", 1), ("b.md", "text of b", 1))
    q = start(6000)
    try:
        time.sleep(2)
        put(("a.md", "older", 0), ("a.md", long, 2), ("a.md", "older still", 1))  # twice within the settle time
        until(lambda: sum(r["op"] == "embed" for r in got) == 71)
        assert [r["path"] for r in got if r["op"] == "replace"].count("a.md") == 1
        mine = [r for r in got if r["path"] == "a.md" and r["op"] == "embed"]
        assert [sum(r["batch"] == i for r in mine) for i in range(4)] == [32, 32, 6, 0]
        assert [(r["heading"], r["start"], r["end"], r["text"]) for r in sorted(mine, key=lambda r: r["ord"])] == chunks
    finally:
        q.stop()


def test_hashes_live_in_the_checkpoint(stream):
    put, start, got = stream
    put(("a.md", "one", 1), ("b.md", "two", 1))
    q = start(100)
    until(lambda: sum(r["op"] == "embed" for r in got) == 2)
    q.stop()
    got.clear()
    put(("a.md", "one", 5), ("b.md", "changed", 5), ("c.md", None, 5))  # a is what it was, c was never there
    q = start(100)
    try:
        until(lambda: any(r["op"] == "embed" for r in got))
        assert [(r["path"], r["op"], r["text"]) for r in got] == [("b.md", "replace", None), ("b.md", "embed", "changed")]
        got.clear()
        put(("b.md", None, 6))
        until(lambda: got)
        put(("b.md", "changed", 7))  # it comes back, and is chunked again
        until(lambda: len(got) == 3)
        assert [(r["path"], r["op"]) for r in got] == [("b.md", "delete"), ("b.md", "replace"), ("b.md", "embed")]
    finally:
        q.stop()
