from collections import defaultdict

from noteloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, block int, place string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA)


def brute(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        convs[c].add((t, r, x))
    key = lambda v: tuple((p is not None, p or (0 if i == 0 else "")) for i, p in enumerate(v))
    said = {c: tuple((r, x) for _, r, x in sorted(ts, key=key)) for c, ts in convs.items()}
    kept = {}
    for c, s in sorted(said.items(), key=lambda p: (p[0] is not None, p[0] or 0)):
        if not any(len(o) > len(s) and o[: len(s)] == s for o in said.values()) and s not in kept.values():
            kept[c] = s
    return {c: "".join(f"<|{r or 'unknown'}|>\n{x or ''}\n<|end|>\n" for r, x in s) for c, s in kept.items()}


def run(df, **options):
    out = defaultdict(str)
    for r in chat.render_conversations(df, **options).orderBy("conv_id", "part").collect():
        out[r["conv_id"]] += r["text"]
    return dict(out)


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (4, 0, "user", "hi"), (4, 1, "assistant", "yes"), (5, 0, "user", None), (6, 0, "user", ""), (7, None, None, None), (7, 1, "a", "b"), (2, 0, "user", "hi")]
    assert run(frame(spark, rows)) == brute(rows)
    assert set(run(frame(spark, rows))) == {2, 3, 5, 6, 7}


def test_long_conversation_is_split_by_turns(spark):
    rows = [(9, t, "user", f"t{t}") for t in range(1000)] + [(8, t, "user", f"t{t}") for t in range(999)]
    df = frame(spark, rows)
    assert run(df) == brute(rows) and chat.render_conversations(df).count() == 4


def test_empty(spark):
    assert chat.render_conversations(frame(spark, [(1, 0, "u", "x")]).limit(0)).count() == 0
