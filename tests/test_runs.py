import pytest

from noteloom.operators import markdown
from noteloom.plans import runs


def test_staged_runs(spark, tmp_path):
    base = str(tmp_path / "runs")
    rendered = spark.createDataFrame([("Lantern.md", "# Lantern\n\nsource:: [[Almanac]]\nis:: [[Tool]]\n")], "file_name string, content string")
    runs.write_run(base, "one", "Almanac", "# Almanac\n\ntext", rendered, {"k": 1})
    runs.write_run(base, "two", "Other", "x", rendered.limit(0), {})
    runs.write_run(base, "one", "Almanac", "# Almanac\n\ntext", rendered, {"k": 2})
    assert runs.list_runs(spark, base) == ["one", "two"] and runs.meta(spark, base, "one") == {"k": 2}
    own = runs.notes(spark, base, "one")
    assert {r["path"] for r in own.collect()} == {"Almanac.md", "Lantern.md"}
    n, e = runs.run_graph(own)
    assert {(r["source"], r["target"], r["relation"]) for r in e.collect()} == {("Lantern", "Almanac", "source"), ("Lantern", "Tool", "is")}
    vault = spark.createDataFrame([("Lantern.md", "see [[Vault]]")], "path string, content string")
    sides = {r["id"]: r["side"] for r in runs.run_overlay(vault, own)[0].collect()}
    assert sides == {"Lantern": "both", "Vault": "vault", "Almanac": "run", "Tool": "run"}
    runs.remove_run(spark, base, "two")
    assert runs.list_runs(spark, base) == ["one"]
    for bad in ("../evil", "a/b", ".hidden", "a..b", ""):
        with pytest.raises(ValueError):
            runs.remove_run(spark, base, bad)


def test_reveal(spark):
    notes = spark.createDataFrame([("n.md", "---\nsource: Almanac.md\ncite:\n  - chunk: 0\n    span: 2-5\n---\n"), ("lib/Almanac.md", "0123456789")], "path string, content string")
    assert [r["text"] for r in runs.reveal(markdown.citations(notes), notes).collect()] == ["234"]
