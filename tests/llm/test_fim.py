import hashlib
import re

import duckdb
import numpy as np
import pytest
from tokenizers import Regex, pre_tokenizers

from noteloom.llm import fim
from noteloom.llm.base import table
from noteloom.llm.queries import ORACLES, QUERIES

from .conftest import DIR, needs_tables


def brute(doc_id, text):
    """n, form, prefix and middle lengths, output of one text."""
    text = text or ""
    tokens = re.findall(fim.TOKEN, text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df):
    got = sorted(fim.transform(df).collect(), key=repr)
    want = sorted(((r["doc_id"], *brute(r["doc_id"], r["text"])) for r in df.collect()), key=repr)
    assert [tuple(r) for r in sorted(got, key=lambda r: repr(tuple(r)))] == want
    texts = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in df.collect())
    assert sorted(r["restored_sha256"] for r in fim.digests(fim.transform(df)).collect()) == texts
    return got


def test_odd(odd, empty):
    assert len(check(odd)) == odd.count()
    assert fim.transform(empty).count() == 0


def test_forms_and_marks(docs):
    words = "  Ein Wört\tund 日本 more \n"
    df = docs(*[words * (i % 7) for i in range(300)], *[f"a {m} b c d" for m in fim.MARKS] * 20, "<P", "S> <M", "tail   ", " \x1c \x85 x ", "a\x00b c")
    assert {r["form"] for r in check(df)} == {"plain", "spm", "psm"}


def test_slices_that_look_like_marks(docs):
    check(docs(*["<P <S <M >P> P>S> <<P <" * (1 + i % 3) for i in range(60)]))


@pytest.mark.parametrize("block", [1, 2, 5, 17, 10_000])
def test_blocks_change_nothing(block):
    splitter = pre_tokenizers.Split(Regex(fim.TOKEN), "isolated")
    for text in ("", " ", "a", "  a  bb \n\n c", "日本 語  \t", "x" * 50, " " * 50, "ab " * 40):
        want = np.cumsum([0, *map(len, re.findall(fim.TOKEN, text))])
        assert fim.bounds(text, splitter, block).tolist() == want.tolist()


@needs_tables
def test_same_rows_as_sql(spark):
    got = QUERIES["op11_fill_in_middle"](spark, DIR).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(ORACLES["op11_fill_in_middle"]).df()[got.columns].sort_values("doc_id").reset_index(drop=True)
    assert len(got) == table(spark, DIR, "documents").count()
    assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()
