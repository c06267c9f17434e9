"""Mixing sources to target weights by systematic sampling.

Targets: every source gets its weight's share of all words, but at most `most` times its own words; the excess is
shared again by weight until no source is above. Sorted by size over weight, the capped sources are a prefix, so one
running sum over the (few) sources finds them all.

Copies: each document of a source is expected target / size copies. Within the source, documents stand in order of
size classes and a digest of their id; their expected copies are summed up, one random offset is added, and each
integer crossed emits one copy. Neighbours in that order are alike in size, so words taken come near the target.

The running sum never puts a source into one task: ranks are taken inside (source, size class, digest prefix) cells
and added to the cell's offset: a running sum over the cells of the class (of which there are at most 4096 however
many documents there are) and one over the classes of the source. Offsets come from a digest of seed and source: reruns agree.

Null text has size 0; null source is a source of its own, last in order; equal rows (also equal or null doc_ids) are
separate documents in the order of their ids; an empty table gives no rows. Sources with no words have target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import keep, n_words, unused


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) of sizes (source, size): a running sum over one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((nth - 1) % len(weights) + 1).cast("int"))
    out = by.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = out.withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    # with all smaller ratios capped, what a unit of weight would get here
    out = out.withColumn("unit", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    out = out.withColumn("fits", F.col("unit") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "unit"))).over(Window.partitionBy())
    out = out.withColumn("level", level["unit"])
    return out.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", cells: int = 3) -> DataFrame:
    """docs' doc_id, source, h (a hash of the text) and size with source_size, target and copies. cells: hexadecimal digits of the digest prefix."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("h"), n_words(F.col("text")).alias("size"))
    sized = keep(narrow, "sizes")
    targets = source_targets(sized, weights, most)
    # size classes: the leading three bits of the size
    bits = F.length(F.bin("size"))
    step = F.pow(F.lit(2.0), F.greatest(bits - 3, F.lit(0))).cast("long")
    cell = ["source", "class", "prefix"]
    placed = sized.withColumn("class", F.col("size") - F.col("size") % step).withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, cells))
    offsets = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_class = offsets.groupBy("source", "class").agg(F.sum("n").alias("n"))  # a few dozen rows per source
    by_class = by_class.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), before(["source"], "class").alias("classes_before"))
    offsets = offsets.withColumn("in_class", before(["source", "class"], "prefix"))
    offsets = offsets.join(by_class, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class"))).withColumn("before", F.col("in_class") + F.col("classes_before"))
    t = targets.withColumnRenamed("source", "t_source")
    offsets = offsets.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*cell).orderBy("digest", "doc_id", "h")))
    o = offsets.select(F.col("source").alias("o_source"), F.col("class").alias("o_class"), F.col("prefix").alias("o_prefix"), "before", "source_size", "target")
    both = ranked.join(o, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("class") == F.col("o_class")) & (F.col("prefix") == F.col("o_prefix")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("\x00"))).cast("binary")), 1, 5), 16, 10).cast("double") / (1 << 20)
    place = F.col("before") + F.col("nth")
    copies = F.floor(place * rate + start) - F.floor((place - 1) * rate + start)
    return both.select("doc_id", "source", "h", "size", "source_size", "target", F.greatest(F.lit(0), F.least(copies, F.lit(most))).cast("long").alias("copies"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """One row per row of docs (doc_id, text, source; other columns are ignored): what the mix takes of it."""
    out = with_copies(docs, weights, most, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """docs with its columns, each row as often as the mix takes it (not at all, once, or repeated).

    Rows equal in doc_id, source and text are taken as one row with the sum of their copies.
    """
    key = ["doc_id", "source", "h"]
    copies = keep(with_copies(docs, weights, most, seed).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")), "copies")
    own, d, s, h, times, nth = (unused(docs, x) for x in ("own", "d", "s", "h", "times", "nth"))
    c = copies.where("copies > 0").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("h").alias(h), F.col("copies").cast("int").alias(times))
    left = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    if copies.where("rows > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", "source", own])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(s)) & (F.col(own) == F.col(h))
    out = left.join(c, same).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])


#: The same rows in DuckDB.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM by_source
), unit AS (
  SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / SUM(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS unit FROM weighed
), level AS (
  SELECT unit AS level FROM unit WHERE unit * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, LEAST(cap::DOUBLE, level * weight) AS target FROM unit, level
), placed AS (
  SELECT *, md5(COALESCE(doc_id::VARCHAR, '')) AS digest,
    size - size % (2 ** GREATEST(CASE WHEN size = 0 THEN 1 ELSE floor(log2(size)) + 1 END - 3, 0))::BIGINT AS class FROM sized
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, digest, doc_id) AS place FROM placed
), rated AS (
  SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix:' || COALESCE(r.source, chr(0))), 1, 5))::BIGINT::DOUBLE / 1048576 AS start
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, GREATEST(0, LEAST(3, floor(place * rate + start) - floor((place - 1) * rate + start)))::BIGINT AS copies FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM copied
"""
