"""Chat formatting: logged snapshots of one conversation collapse into the longest, which is then rendered.

A turn's hash covers its place, role and text; the running XOR of a conversation's turn hashes (two independent
64-bit ones) is the hash of each of its prefixes. A conversation whose whole hash is a proper prefix hash of another
is a snapshot of it and goes, by an anti-join on (number of turns, hash). Of equal conversations the smallest conv_id stays.

Places are taken in blocks of turns and added to the turns before the block, and running hashes likewise, so a
conversation with very many turns is spread over tasks; it is rendered in parts of `part_turns` turns for the same
reason, each of which holds whole turns. No turn is cut or dropped.

Order: turn ascending (null first), then role, then text. Rows equal in all four columns are repeated log lines and
count once. Null role renders as "unknown", null text as empty, but both differ from those texts when hashed. Rows
with null conv_id are one conversation. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import keep

BLOCK = 256


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, and h1, h2: the hashes of the conversation up to that turn."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    t = t.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def offset(df: DataFrame, *aggregates) -> DataFrame:
        """The running aggregates over the blocks before each block, one row per block."""
        per = df.groupBy("conv_id", "block").agg(*[f.alias(n) for n, f in aggregates])
        return per.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce((F.sum(n) if n == "n" else F.bit_xor(n)).over(before), F.lit(0)).alias(n) for n, _ in aggregates])

    def joined(df: DataFrame, o: DataFrame) -> DataFrame:
        return df.join(o, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")

    t = joined(t, offset(t, ("n", F.count(F.lit(1)))))
    t = t.withColumn("place", F.col("n") + F.row_number().over(inside)).drop("n")
    own = ["place", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    t = t.withColumn("a1", F.xxhash64(F.lit(1), *own)).withColumn("a2", F.xxhash64(F.lit(2), *own))
    t = joined(t, offset(t, ("x1", F.bit_xor("a1")), ("x2", F.bit_xor("a2"))))
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select("conv_id", "place", "role", "text", F.col("x1").bitwiseXOR(F.bit_xor("a1").over(run)).alias("h1"), F.col("x2").bitwiseXOR(F.bit_xor("a2").over(run)).alias("h2"))


def render_conversations(turns: DataFrame, part_turns: int = 256) -> DataFrame:
    """conv_id, part (from 0), n_turns of the conversation, and text, for each maximal conversation of turns (conv_id, turn, role, text)."""
    p = keep(turn_prefixes(turns), "prefixes")
    whole = p.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("end")).select("conv_id", F.col("end.place").alias("place"), F.col("end.h1").alias("h1"), F.col("end.h2").alias("h2"))
    key = ["place", "h1", "h2"]
    one = whole.groupBy(*key).agg(F.min("conv_id").alias("kept"), F.max(F.col("conv_id").isNull()).alias("or_null"))
    ends = whole.select(F.col("conv_id").alias("c"), F.col("place").alias("n"))
    proper = p.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).where(F.col("place") < F.col("n")).select(*key).distinct()
    kept = one.join(proper, key, "left_anti").select(F.col("kept").alias("c"), F.col("place").alias("n_turns"))
    body = p.join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    parts = body.groupBy("conv_id", "n_turns", F.floor((F.col("place") - 1) / part_turns).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("place", said.alias("said")))).alias("all"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.transform("all", lambda x: x["said"]), "").alias("text"))


#: The same rows in DuckDB.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), c AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY place) AS said FROM t GROUP BY conv_id
), one AS (
  SELECT n, said, min(conv_id) AS conv_id FROM c GROUP BY n, said
), prefix AS (
  SELECT DISTINCT k AS n, said[1:k] AS said FROM (SELECT said, unnest(range(1, n)) AS k FROM c)
), kept AS (
  SELECT conv_id, n FROM one ANTI JOIN prefix USING (n, said)
)
SELECT t.conv_id, (place - 1) // 256 AS part, kept.n AS n_turns,
  string_agg('<|' || COALESCE(role, 'unknown') || '|>' || chr(10) || COALESCE(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS text
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY ALL
"""
