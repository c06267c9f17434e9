"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
#: Runs that overflow the stack or take quadratic time where a pattern is careless.
HOSTILE = " ".join(["x@y" + ".a" * 50_000, "1" + ".1" * 50_000, "+1" + " (2" * 20_000, "token" + "=" * 20_000, "a-" * 20_000, "<a x='" * 5000])
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, rid long, node string, size string, h int"


def document_rows(texts):
    return [(i, t, "en", "s", len(t or ""), 1, 2, "n", "z", 3) for i, t in texts]


@pytest.fixture
def odd(spark):
    """Documents of all kinds, with columns named like those that operators use inside."""
    texts = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "one"), (None, "a b c d e f g"), (5, LONG), (6, LONG + " tail"), (7, "  \n\t "), (8, "x" * 50_000), (9, "a b c d e f g"), (9, "other words of the same number"), (10, HOSTILE), (11, "日本語の文章" * 2000)]
    return spark.createDataFrame(document_rows(texts), SCHEMA)


@pytest.fixture
def docs(spark):
    """Makes documents of texts."""
    return lambda *texts: spark.createDataFrame(document_rows(list(enumerate(texts))), SCHEMA)


@pytest.fixture
def empty(odd):
    return odd.limit(0)
