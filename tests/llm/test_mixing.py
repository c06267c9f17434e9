from collections import Counter

import pytest

from noteloom.llm import mixing
from noteloom.llm.base import table

from .conftest import DIR, SCHEMA, needs_tables


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over


def make(spark, counts):
    rows, i = [], 0
    for source, sizes in counts.items():
        for n in sizes:
            rows.append((i, " ".join(["w"] * n) if n is not None else None, "en", source, n, 1, 2, "n", "z", 3))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("counts", [{"a": [10] * 300, "b": [1, 2, 3] * 20, "c": [100, 5], None: [7, None, 0]}, {"a": [0, None]}, {"z": [5] * 2000, "b": [9] * 3, "c": [4] * 4, "d": [1]}])
def test_targets_and_copies(spark, counts):
    got = mixing.mix_documents(make(spark, counts)).collect()
    sizes = {s: sum(n or 0 for n in ns) for s, ns in counts.items()}
    want = brute_targets(sizes)
    assert len(got) == sum(map(len, counts.values()))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[r["source"]] += r["taken"]
    for s in counts:
        assert abs(taken[s] - want[s]) <= 2 * max([n or 0 for n in counts[s]])
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_documents(make(spark, counts)).collect()), key=repr)


def test_odd_and_empty(odd, empty):
    assert mixing.mix_documents(odd).count() == odd.count()
    assert mixing.mix_documents(empty).count() == 0


def test_mixed_rows(odd, docs):
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns
    want = Counter()
    for r in mixing.mix_documents(odd).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in rows.collect()) == +want


@needs_tables
def test_words_come_near_targets(spark):
    got = mixing.mix_documents(table(spark, DIR, "documents")).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 1.5 * r["max(size)"]
