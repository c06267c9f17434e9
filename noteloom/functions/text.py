"""Scalar text functions as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marks() -> tuple[dict[str, str], str]:
    """Characters that decompose into a base and combining marks, with their base; and the marks themselves."""
    based, marks = {}, []
    for c in map(chr, range(0x10000)):
        if unicodedata.combining(c):
            marks.append(c)
        elif len(d := unicodedata.normalize("NFD", c)) > 1 and all(map(unicodedata.combining, d[1:])):
            based[c] = d[0]
    return based, "".join(marks)


#: Derived from the Unicode tables, for code points of the basic plane.
BASED, MARKS = _marks()
_FOLD = str.maketrans(BASED | dict.fromkeys(MARKS, ""))
TOKEN = r"([\p{L}\p{N}]+)"
#: The same runs in a text that is not folded: its i-th match is the i-th token of the folded text.
RAW_TOKEN = rf"[{MARKS}]*[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}{MARKS}]*"


def fold(text: Column) -> Column:
    """Lower case without marks, whether they are composed or not: the form in which texts and queries meet."""
    low = F.lower(text)
    return F.when(F.length(text) == F.octet_length(text), low).otherwise(F.translate(low, "".join(BASED) + MARKS, "".join(BASED.values())))


def folded(text: str) -> str:
    """fold() of a plain string."""
    return text.lower().translate(_FOLD)


def tokens(text: Column) -> Column:
    """array<string>: maximal runs of letters and digits of the folded text. Null text has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def basename(path: Column) -> Column:
    """Last path segment without .md (any case)."""
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(?i)\.md$", "")


def note_name(title: Column) -> Column:
    """A title as a safe note name: characters that paths or links use become one space; blank gives untitled."""
    n = F.trim(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|#\[\]]+', " "), r"(?U)\s+", " "))
    return F.when(F.coalesce(n, F.lit("")) == "", F.lit("untitled")).otherwise(n)


def relation_name(relation: Column) -> Column:
    """A relation that a typed field can carry, or empty if it starts with no letter."""
    clean = F.regexp_replace(F.trim(relation), r"[^A-Za-z0-9_ -]", "_")
    return F.when(clean.rlike("^[A-Za-z]"), clean).otherwise("")


def run_id(path: Column) -> Column:
    """A run's identifier from a document's path: at most 80 safe characters, run if nothing is left."""
    stem = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]*$", "")
    clean = F.left(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_-]+", "-"), r"^-+|-+$", ""), F.lit(80))
    return F.when(clean == "", F.lit("run")).otherwise(clean)


def is_safe_run_id(run: Column) -> Column:
    """One plain path segment: not empty, not hidden, without separators or dots in a row."""
    return F.coalesce((run != "") & ~run.rlike(r"[/\\]") & ~run.startswith(".") & ~run.contains(".."), F.lit(False))


def clean_target(inner: Column) -> Column:
    """The page of a wikilink: before the alias, before the heading, trimmed."""
    return F.trim(F.split_part(F.split_part(inner, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the lower-cased, space-padded text."""
    t = F.concat(F.lit("  "), F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(" "))
    pieces = F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(pieces))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigrams; 1 for two blank texts."""
    x, y = trigrams(a), trigrams(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def lag_bucket(ms: Column) -> Column:
    """Octave of a lag: 0 below 1 ms, then one per doubling, 14 from 8192 ms on."""
    return F.size(F.filter(F.array(*[F.lit(float(1 << i)) for i in range(14)]), lambda t: ms >= t))


def lag_label(ms: Column) -> Column:
    return F.when(ms < 1, F.lit("<1ms")).when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_number(ms / 1000, 1), F.lit("s")))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def choose_k(n: Column, per: int = 8, least: int = 4, most: int = 24) -> Column:
    """Clusters for n chunks: one per `per`, between least and most, never more than n."""
    return F.when(n <= 0, 0).otherwise(F.least(n, F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(n / per))))).cast("int")
