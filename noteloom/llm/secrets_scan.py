"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of key characters of `least` or more with a digit and a letter. A candidate belongs to the
narrowest character class that holds it (hexadecimal, upper-case alphanumeric, base64), which sets the window and the
entropy it must reach. The window slides one character at a time: the counts c of its characters, and the sum of
c * log2(c), are carried along and change only for the leaving and the entering character. The largest window entropy
decides. Suppressed by the allow-list: UUIDs, runs of consecutive characters (alphabets), strings
marked as examples, plain decimal numbers. Candidates that overlap a span of the fixed patterns add nothing.

Spans are in code points, end exclusive. Null text counts as empty: no spans. Repeated rows stay; empty tables give
none. Only DataFrame functions are used; memory is in proportion to one text, work nearly so (see base.prefix_sums).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import let, matches

#: Fixed patterns, in the order in which kinds with equal starts are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
#: Character class, window, and bits of entropy to reach.
CLASSES = ((r"^[0-9a-fA-F]+$", 16, 2.75), (r"^[0-9A-Z]+$", 20, 3.4), (r"^[A-Za-z0-9+/_=-]+$", 20, 3.7))
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh|qwertz|qwerty",
    r"^[0-9+/_=-]+$",
)
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def window_entropy(s: Column, width: int) -> Column:
    """The largest Shannon entropy (bits per character) of any `width` consecutive characters; of s itself if shorter.

    The accumulator holds the count of each distinct character of s inside the window (at most as many as the class
    has characters), and the entropy's sum; a step changes the counts of the leaving and the entering one.
    """
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)

    def slide(chars: Column, letters: Column, codes: Column) -> Column:
        w = F.least(F.lit(width), F.size(chars))
        entropy = lambda t: F.log2(w.cast("double")) - t / w

        def step(acc: Column, i: Column) -> Column:
            out, new = F.get(codes, i - w), F.get(codes, i)
            gone, come = F.get(acc["counts"], out), F.get(acc["counts"], new)
            t = F.when(out == new, acc["t"]).otherwise(acc["t"] - term(gone) + term(gone - 1) - term(come) + term(come + 1))
            counts = F.transform(acc["counts"], lambda c, j: F.when(out == new, c).when(j == out, c - 1).when(j == new, c + 1).otherwise(c))
            return F.struct(counts.alias("counts"), t.alias("t"), F.greatest(acc["best"], entropy(t)).alias("best"))

        def run(counts: Column) -> Column:
            total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + term(c))
            first = F.struct(counts.alias("counts"), total.alias("t"), entropy(total).alias("best"))
            steps = F.when(F.size(chars) > w, F.sequence(w, F.size(chars) - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, first, step, lambda acc: acc["best"])

        start = F.slice(codes, F.lit(1), w)
        return let(F.transform(letters, lambda _, j: F.size(F.filter(start, lambda x: x == j))), run)

    coded = lambda chars, letters: F.transform(chars, lambda ch: (F.array_position(letters, ch) - 1).cast("int"))
    return let(F.split(s, ""), lambda chars: let(F.array_distinct(chars), lambda letters: let(coded(chars, letters), lambda codes: slide(chars, letters, codes))))


def is_secret(s: Column) -> Column:
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | s.rlike(p)
    high = F.lit(False)
    for p, width, bits in reversed(CLASSES):
        high = F.when(s.rlike(p), window_entropy(s, width) >= bits).otherwise(high)
    return s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~allowed & high


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start, then kind."""
    none = F.array().cast(SPANS)
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    span = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))
    assign = F.when(named, F.transform(F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x["part"]) >= 6), span(0))).otherwise(none)
    access = F.when(text.contains("AKIA"), F.transform(matches(text, ACCESS), span(1))).otherwise(none)
    return F.sort_array(F.concat(assign, access, F.transform(matches(text, HEX), span(2))))


def entropy_spans(text: Column, base: Column, least: int = 20) -> Column:
    """Spans that only the entropy finds. base: the spans that they must not overlap."""
    free = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    found = F.filter(matches(text, CANDIDATE % least), lambda x: free(x) & is_secret(x["hit"]))
    out = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike("[0-9]"), out).otherwise(F.array().cast(SPANS))


def as_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, least: int = 20) -> DataFrame:
    """docs with base and spans: arrays of (start, kind, end), sorted by start, then kind (an index of KINDS)."""
    found = docs.withColumn("base", base_spans(F.coalesce(F.col("text"), F.lit(""))))
    return found.withColumn("spans", F.sort_array(F.concat("base", entropy_spans(F.coalesce(F.col("text"), F.lit("")), F.col("base"), least))))


def scan(docs: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, counts by kind, the digest of the fixed patterns' spans, and all spans, for every row of docs (doc_id, text)."""
    f = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), least)
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return f.select("doc_id", n(0), n(1), n(2), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), n(3))


def masked(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """text with every span replaced by mark; overlapping or touching spans become one."""

    def cut(acc: Column, x: Column) -> Column:
        """acc: pieces kept so far and where the last span ends."""
        piece = F.when(x["start"] > acc["at"], F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark)))
        first = F.when((x["start"] == 0) & (acc["at"] == 0), F.lit(mark))
        return F.struct(F.concat(acc["kept"], F.filter(F.array(F.coalesce(piece, first)), lambda p: p.isNotNull())).alias("kept"), F.greatest(acc["at"], x["end"]).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("long").alias("at"))
    whole = F.aggregate(spans, start, cut, lambda acc: F.concat(F.array_join(acc["kept"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact(docs: DataFrame, least: int = 20, mark: str = "[REDACTED]") -> DataFrame:
    """docs with its columns, every secret in text replaced by mark. Documents without secrets, and null texts, stay as they are."""
    names = docs.columns
    s = with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text")), least)
    text = masked(F.col("text"), F.col("spans"), mark)
    return s.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
