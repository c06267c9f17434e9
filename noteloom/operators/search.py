"""Full-text search: an index of postings, prefix-AND matching, BM25 ranks and snippets.

notes: key, title, body. A query's tokens are prefixes; a note matches if each occurs in title or body. The score is
sum of idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / average length)), idf = ln((N - n + 0.5) / (n + 0.5)) of at
least 1e-6, f counting all tokens with the prefix in both columns.

Every function takes notes, which are then tokenized, or a TextIndex, which is read where the query's prefixes stand.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKS, RAW_TOKEN, folded, tokens
from .text_index import TextIndex, build as build_index, frequency, open_index  # noqa: F401  the index is part of search
from .workspace import few

_TOKEN = re.compile(rf"[{MARKS}]*[^\W_](?:[^\W_]|[{MARKS}])*")
_FOLDED = re.compile(r"[^\W_]+")


def query_tokens(query: str) -> list[str]:
    return _FOLDED.findall(folded(query))


def postings(notes: DataFrame) -> DataFrame:
    """key, field, token, pos (from 0) of every token."""
    each = lambda f: notes.select("key", F.lit(f).alias("field"), F.posexplode(tokens(F.col(f))).alias("pos", "token"))
    return each("title").unionByName(each("body")).select("key", "field", "token", "pos")


def lengths(notes: DataFrame | TextIndex) -> DataFrame:
    if isinstance(notes, TextIndex):
        return notes.notes.select("key", "n")
    return notes.select("key", (F.size(tokens(F.col("title"))) + F.size(tokens(F.col("body")))).cast("long").alias("n"))


def _counted(notes: DataFrame | TextIndex, terms: list[str]) -> DataFrame:
    """key, n (tokens) and f0, f1, ... of at least the notes that hold a term."""
    names = [f"f{i}" for i in range(len(terms))]
    if isinstance(notes, TextIndex):
        started = [F.col("token").startswith(q) for q in terms]
        some = notes.postings.where(reduce(Column.__or__, started))
        return some.groupBy("key").agg(F.max("n").alias("n"), *[F.sum(F.when(c, frequency()).otherwise(0)).alias(x) for c, x in zip(started, names, strict=True)])
    t = notes.select("key", F.concat(tokens(F.col("title")), tokens(F.col("body"))).alias("tokens"))
    hits = F.struct(F.size("tokens").alias("n"), *[F.size(F.filter("tokens", _prefixed(q))).alias(x) for q, x in zip(terms, names, strict=True)])
    return t.select("key", F.explode(F.array(hits)).alias("c")).select("key", "c.*")  # no filter goes below explode, which would tokenize again


def _prefixed(term: str):
    return lambda x: x.startswith(term)


def _matched(terms: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"f{i}") > 0 for i in range(len(terms))])


def matching(notes: DataFrame | TextIndex, query: str) -> DataFrame:
    """Keys of the notes that hold every query token as a prefix; none for a query without tokens."""
    terms = list(dict.fromkeys(query_tokens(query)))
    if not terms:
        return lengths(notes).select("key").limit(0)
    return _counted(notes, terms).where(_matched(terms)).select("key")


def bm25(notes: DataFrame | TextIndex, query: str) -> DataFrame:
    """key, score of all matching notes."""
    terms = query_tokens(query)
    if not terms:
        return lengths(notes).select("key", F.lit(0.0).alias("score")).limit(0)
    c = _counted(notes, terms)
    held = [F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))]
    if isinstance(notes, TextIndex):
        total = c.agg(*held).select("*", F.lit(notes.total).alias("total"), F.lit(notes.mean).alias("mean"))
    else:
        total = c.agg(F.count(F.lit(1)).alias("total"), F.avg("n").alias("mean"), *held)
    all_in = c.where(_matched(terms)).crossJoin(F.broadcast(total))  # total is one row

    def part(i: int) -> Column:
        idf = F.greatest(F.log((F.col("total") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(1e-6))
        return idf * F.col(f"f{i}") * 2.2 / (F.col(f"f{i}") + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("mean")))

    return all_in.select("key", reduce(Column.__add__, map(part, range(len(terms)))).alias("score"))


def search(notes: DataFrame | TextIndex, query: str, limit: int = 50, snippet: bool = True, places: int | None = None) -> DataFrame:
    """key, title, score and snippet of the best `limit` notes, best first, ties by key. places: scores that agree when rounded to so many are ties."""
    scored = bm25(notes, query)
    best = few((scored if places is None else scored.withColumn("score", F.round("score", places))).orderBy(F.desc("score"), "key").limit(limit))
    rows = notes.notes if isinstance(notes, TextIndex) else notes
    keys = [r["key"] for r in best.collect()]  # at most `limit`: the scan skips row groups without them
    hits = rows.select("key", "title", *(["body"] if snippet else [])).where(F.col("key").isin(keys) if keys else F.lit(False)).join(F.broadcast(best), "key")
    if not snippet:
        return hits.orderBy(F.desc("score"), "key")
    return hits.join(F.broadcast(snippets(hits, _places(notes, keys, query_tokens(query)))), "key").select("key", "title", "score", "snippet").orderBy(F.desc("score"), "key")


def _places(notes: DataFrame | TextIndex, keys: list, terms: list[str]) -> DataFrame:
    """key, pos, term: the tokens of the given notes' bodies that start with a term, with the first such term."""
    here = F.col("key").isin(keys) if keys else F.lit(False)
    term = F.coalesce(*[F.when(F.col("token").startswith(q), F.lit(i)) for i, q in enumerate(terms)], F.lit(None).cast("int"))
    if isinstance(notes, TextIndex):
        found = notes.postings.where(reduce(Column.__or__, [F.col("token").startswith(q) for q in terms], F.lit(False))).where(here & (F.col("field") == "body"))
        return found.select("key", F.explode("positions").alias("pos"), term.alias("term"))
    return notes.where(here).select("key", F.posexplode(tokens(F.col("body"))).alias("pos", "token")).select("key", "pos", term.alias("term")).where("term is not null")


def snippets(bodies: DataFrame, places: DataFrame, size: int = 10) -> DataFrame:
    """key, snippet: of each body (key, body) the earliest window of `size` tokens with the most terms, then the most tokens of terms, those marked.

    places: key, pos (number of the body's token), term. A body without any gives its start, one without tokens itself.
    Windows count where a token of a term is in them, so a body has at most `size` for each of those.
    """
    gaps, cut = F.split("body", RAW_TOKEN, -1), F.regexp_extract_all("body", F.lit(RAW_TOKEN), F.lit(0))
    t = bodies.select("key", F.coalesce("body", F.lit("")).alias("body")).select("key", "body", cut.alias("tokens"), gaps.alias("gaps"))
    n = F.size("tokens")
    last = F.greatest(F.lit(0), n - size)
    near = places.join(F.broadcast(t.select("key", last.alias("last"))), "key")
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - size + 1), F.least("pos", "last")))
    windows = near.where("pos - last < " + str(size)).select("key", "pos", "term", start.alias("start")).groupBy("key", "start").agg(F.count_distinct("term").alias("terms"), F.count("term").alias("hits"))
    best = windows.groupBy("key").agg(F.min_by("start", F.struct(-F.col("terms"), -F.col("hits"), "start")).alias("start"))
    marked = places.join(best, "key").where(F.col("pos").between(F.col("start"), F.col("start") + size - 1)).groupBy("key").agg(F.collect_set("pos").alias("marks"))
    whole = t.join(best, "key", "left").join(marked, "key", "left").withColumn("start", F.coalesce("start", F.lit(0))).withColumn("to", F.least(n, F.col("start") + size))

    def shown(i: Column) -> Column:
        word = F.get("tokens", i)
        word = F.when(F.array_contains(F.coalesce("marks", F.array().cast("array<int>")), i), F.concat(F.lit("<mark>"), word, F.lit("</mark>"))).otherwise(word)
        return F.concat(F.when(i > F.col("start"), F.get("gaps", i)).otherwise(""), word)

    text = F.array_join(F.transform(F.sequence(F.col("start"), F.col("to") - 1), shown), "")
    before = F.when(F.col("start") > 0, "…").otherwise(F.get("gaps", F.lit(0)))
    after = F.when(F.col("to") < n, "…").otherwise(F.get("gaps", n))
    return whole.select("key", F.when(n == 0, F.col("body")).otherwise(F.concat(before, text, after)).alias("snippet"))


def snippet_of(body: str, terms: list[str], size: int = 10) -> str:
    """The earliest window of `size` tokens with the most query terms, those marked; the body's start if none match."""
    places = [(m.start(), m.end(), query_tokens(m[0])) for m in _TOKEN.finditer(body)]
    if not places:
        return body
    which = [next((i for i, q in enumerate(terms) if any(t.startswith(q) for t in ts)), None) for _, _, ts in places]
    best, at = (0, 0), 0
    for i in range(max(1, len(places) - size + 1)):
        got = [w for w in which[i : i + size] if w is not None]
        if (len(set(got)), len(got)) > best:
            best, at = (len(set(got)), len(got)), i
    out, last = ["…"] if at else [], places[at][0] if at else 0
    end = min(len(places), at + size)
    for i in range(at, end):
        s, e, _ = places[i]
        out += [body[last:s], f"<mark>{body[s:e]}</mark>" if which[i] is not None else body[s:e]]
        last = e
    return "".join(out) + ("…" if end < len(places) else body[last:])
