"""Order MinHash fingerprints: sketches whose agreement follows edit distance, not only set overlap.

A text is cut into tokens: its runs without ASCII white space, and inside a run longer than `token_chars` the windows
of `window` characters that start at each of its characters, so that one character put in front of a text without
spaces changes a few tokens and not all. Every k consecutive tokens form a k-mer, numbered by its occurrence in the
text, so that repeats differ. A hash deals the numbered k-mers over 2 * tuples bins; each bin selects its minimal one.
Two neighbouring bins form a tuple whose members keep their text order, and the hash of the ordered tuple is one part
of the signature. Moving a passage changes the order and so the tuples, which a plain MinHash would not see. A bin that
is empty borrows the k-mer whose hash is the first from a random number of the bin's own on, cyclically: the minimal
one of an order of the bin's own. So every tuple is an ordered pair as soon as the text has two k-mers. (Without
`dense` empty bins stay empty, and a tuple of one bin has no order.)

Everything is one column expression over a row: no explode, no shuffle, memory in proportion to one text.
Null text counts as empty. A text without tokens has an empty signature; one with fewer than k tokens is one k-mer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import let, words_of

POS = 28  # bits for a k-mer's place


def borrower(number: int) -> int:
    """The random number of a bin: 63 bits, of which those of the place are 1, which no k-mer's are."""
    x = (number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return (x ^ x >> 31) >> 1 | (1 << POS) - 1


def marks_of(bins: int, bits: int) -> dict[str, np.ndarray]:
    """values: the sorted marks, that is one below each bin's first value (and the end) and each bin's random number; begins, numbers: where they stand."""
    begins, numbers = [(j << bits) - 1 for j in range(bins + 1)], [borrower(j) for j in range(bins)]
    values = np.sort(np.array(begins + numbers))
    return {"values": values, "begins": np.searchsorted(values, begins).astype(np.int32), "numbers": np.searchsorted(values, numbers).astype(np.int32)}


def tokens(text: Column, token_chars: int = 16, window: int = 4) -> Column:
    """array<string>: runs of at most token_chars; of longer ones, the windows that start at each character."""
    long = lambda w: F.length(w) > token_chars

    def windows(run: Column) -> Column:
        return let(F.split(run, ""), lambda c: F.transform(c, lambda x, i: F.concat(x, *[F.coalesce(F.get(c, i + d), F.lit("")) for d in range(1, window)])))

    return let(words_of(text), lambda w: F.when(F.exists(w, long), F.flatten(F.transform(w, lambda x: F.when(long(x), windows(x)).otherwise(F.array(x))))).otherwise(w))


def signature(text: Column, k: int = 3, tuples: int = 64, token_chars: int = 16, dense: bool = True, window: int = 4) -> Column:
    """array<long>: for each tuple its number (above bit 32) and the hash of its ordered members; none of a text without tokens.

    dense: empty bins borrow, so that a text with two k-mers has every tuple, each an ordered pair.
    """
    bin_bits = (2 * tuples - 1).bit_length()
    if 2 * tuples != 1 << bin_bits or bin_bits > 16:
        raise ValueError("tuples must be a power of two up to 32768")
    place = (1 << POS) - 1
    hash_bits = 63 - POS

    def kmers(w: Column) -> Column:
        at = lambda i, d: F.get(w, i + d)
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[at(i, d) for d in range(k)]).bitwiseAND(~place).bitwiseOR(i.cast("long")))
        return F.when(F.size(w) >= k, each).when(F.size(w) > 0, F.array(F.xxhash64(w).bitwiseAND(~place))).otherwise(F.array().cast("array<long>"))

    def numbered(s: Column) -> Column:
        """s: sorted by k-mer, then place. Runs of one k-mer give the occurrence numbers."""
        of = lambda i: F.shiftright(F.get(s, i), POS)
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (of(i - 1) != of(i)))

        def run(starts: Column) -> Column:
            def one(a: Column, j: Column) -> Column:
                last = F.coalesce(F.get(starts, j + 1), F.size(s)) - 1
                return F.transform(F.sequence(a, last), lambda i: F.shiftleft(F.xxhash64(of(i), i - a).bitwiseAND((1 << hash_bits) - 1), POS).bitwiseOR(F.get(s, i).bitwiseAND(place)))

            return F.flatten(F.transform(starts, one))

        return F.when(F.size(s) == 0, F.array().cast("array<long>")).otherwise(let(first, run))

    bin_of = lambda x: F.shiftright(x, 63 - bin_bits)

    def minima(v: Column) -> Column:
        return F.filter(v, lambda x, i: (i == 0) | (bin_of(F.get(v, i - 1)) != bin_of(x)))

    def hashed(number: Column, a: Column, b: Column) -> Column:
        key = lambda x: F.shiftright(x, POS)
        where = lambda x: x.bitwiseAND(place)
        h = F.when(b.isNull(), F.xxhash64(key(a))).when(where(a) < where(b), F.xxhash64(key(a), key(b))).otherwise(F.xxhash64(key(b), key(a)))
        return F.shiftleft(number.cast("long"), 32).bitwiseOR(h.bitwiseAND((1 << 32) - 1))

    def ordered(m: Column) -> Column:
        number = lambda x: F.shiftright(x, 64 - bin_bits)
        pairs = F.transform(m, lambda x, i: F.struct(x.alias("a"), F.when(number(F.get(m, i + 1)) == number(x), F.get(m, i + 1)).alias("b"), ((i == 0) | (number(F.get(m, i - 1)) != number(x))).alias("lead")))

        return F.transform(F.filter(pairs, lambda p: p["lead"]), lambda p: hashed(number(p["a"]), p["a"], p["b"]))

    def completed(v: Column) -> Column:
        """All tuples of the sorted values; a bin without one borrows.

        Marks (where bins begin, and the bins' random numbers) are sorted in among the values; the place of a mark less
        the marks before it is the number of values below it.
        """
        n = F.size(v)
        known = lambda name, i: F.get(F.lit(marks[name]), i.cast("int"))

        def tuples_of(below: Column) -> Column:
            def pair(t: Column) -> Column:
                first = lambda j: F.get(below, known("begins", j))
                own = lambda j: F.when(first(j) < first(j + 1), F.get(v, first(j)))

                def borrowed(j: Column, other: Column) -> Column:
                    other_than = lambda x: F.when(other.isNull() | (x != other), x)
                    return let(F.get(below, known("numbers", j)), lambda i: F.coalesce(other_than(F.get(v, i % n)), other_than(F.get(v, (i + 1) % n))))

                both = lambda a, y: hashed(t, a, F.coalesce(F.when(y != a, y), borrowed(2 * t + 1, a)))
                return let(own(2 * t + 1), lambda y: let(F.coalesce(own(2 * t), borrowed(2 * t, y), y), lambda a: both(a, y)))

            return F.transform(F.sequence(F.lit(0), F.lit(tuples - 1)).cast("array<long>"), pair)

        at = lambda all_: F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: F.get(all_, i).bitwiseAND(place) == place)
        below = let(F.sort_array(F.concat(v, F.lit(marks["values"]))), lambda all_: F.transform(at(all_), lambda p, k: p - k))
        return F.when(n == 0, F.array().cast("array<long>")).otherwise(let(below, tuples_of))

    packed = let(tokens(F.coalesce(text, F.lit("")), token_chars, window), kmers)
    values = let(F.sort_array(packed), numbered)
    if not dense:
        return let(F.sort_array(values), lambda v: let(minima(v), ordered))
    marks = marks_of(2 * tuples, 63 - bin_bits)
    return let(F.sort_array(values), completed)


def as_text(sig: Column) -> Column:
    """Ten hexadecimal digits for each tuple, in the order of their numbers."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among those that either text has; 1 for two empty texts."""
    numbers = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(numbers(a), numbers(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprint_documents(docs: DataFrame, k: int = 3, tuples: int = 64, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text and its likeness to both its neighbours in doc_id order.

    docs needs doc_id and text; other columns are ignored. The edited text is the text whose last floor(n / 2) code
    points give way to the first as many of the next document's. Order: doc_id ascending, null first, equal doc_ids by
    text, null first; after the last document comes the first. Repeated rows stay and are each other's neighbours. An empty table gives none.

    doc_id ranges (by approximate quantiles, whose number is bounded by `buckets`) split the table, and the first
    document of a range is also sent to the range before, so one shuffle of the texts gives every row its neighbour
    and no task holds more than a range.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    n = buckets or min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    marks = base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10000).alias("q"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    cuts = sorted({x for x in marks["q"] or [] if x > marks["least"]})
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<long>"), lambda c: c <= F.col("doc_id"))))
    first = F.col("doc_id").isNull() if marks["nulls"] else F.col("doc_id") == F.lit(marks["least"])
    also = F.when(first, F.lit(len(cuts))).when(F.col("doc_id").isin(cuts) if cuts else F.lit(False), F.col("bucket") - 1)
    dealt = base.withColumn("bucket", bucket).withColumn(
        "to", F.explode(F.filter(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")), F.struct(also.alias("b"), F.lit(True).alias("guest"))), lambda x: x["b"].isNotNull()))
    )
    dealt = dealt.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("to.b").alias("bucket"), F.col("to.guest").alias("guest"), F.col("text").isNull().alias("was_null"))
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.col("was_null").desc(), "text")
    size, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    cut = dealt.withColumn("next", F.lead("text").over(w)).withColumn("n_chars", size.cast("long"))
    cut = cut.withColumn("edited", F.when(~F.col("guest"), F.concat(F.substring("text", F.lit(1), size - half), F.substring("next", F.lit(1), half))))
    signed = cut.select(
        "doc_id", "bucket", "guest", "was_null", "n_chars", F.monotonically_increasing_id().alias("nth"),
        F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("text"), k, tuples).alias("sig"), F.when(~F.col("guest"), signature(F.col("edited"), k, tuples)).alias("edited_sig"),
    )
    v = Window.partitionBy("bucket").orderBy("nth")
    both = signed.withColumn("next_sig", F.lead("sig").over(v)).where(~F.col("guest"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
