"""Lag samples (at, ms): octave histograms, maxima, p99, worst samples, and rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lag_bucket


def histogram(samples: DataFrame) -> DataFrame:
    """bucket, n for all 15 buckets."""
    counts = samples.where("ms is not null").groupBy(lag_bucket(F.col("ms")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return samples.sparkSession.range(15).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def ordered_bits(value: Column) -> Column:
    """A double as a long of the same order: its bits, those of negative numbers turned round. -0.0 is 0.0, NaN comes last."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits < 0, F.bitwise_not(bits).bitwiseXOR(F.lit(-(1 << 63)))).otherwise(bits)


def nth_value(values: DataFrame, nth: int, bits: int = 16) -> float | None:
    """The nth (from 0) of the sorted values (one column of doubles without nulls), or None beyond the last.

    Radix selection: values are counted by the leading bits of their ordered_bits(), then those of the bucket that holds
    the nth by the next ones, until a bucket's values are all the same. Each of the at most 64 / bits rounds is one grouped
    count, of which at most 2 ** bits rows come back; no value is sorted, and no task gets a bucket.
    """
    (name,) = values.columns
    left, inside = values.select(F.col(name).cast("double").alias("v"), ordered_bits(F.col(name)).alias("k")), F.lit(True)
    for shift in range(64 - bits, -1, -bits):
        top = F.shiftright("k", shift)
        buckets = left.where(inside).groupBy(top.alias("top")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("top").collect()
        for r in buckets:
            if nth < r["c"]:
                break
            nth -= r["c"]
        else:
            return None
        if r["lo"] == r["hi"]:
            return r["lo"]
        inside = top == r["top"]
    return r["lo"]


def summary(samples: DataFrame) -> DataFrame:
    """count, max, mean and p99, one row: p99 is the sorted element at least(n - 1, floor(0.99 n)), by radix selection."""
    s = samples.where("ms is not null").select(F.col("ms").cast("double").alias("ms"))
    total = s.agg(F.count(F.lit(1)).alias("count"), F.max("ms").alias("max"), F.avg("ms").alias("mean"))
    n = s.count()
    p99 = nth_value(s, min(n - 1, n * 99 // 100)) if n else None
    return total.withColumn("p99", F.lit(p99).cast("double"))


def worst(samples: DataFrame, k: int = 6) -> DataFrame:
    return samples.orderBy(F.desc("ms"), "at").limit(k)


def rolling(samples: DataFrame, minutes: int = 5, block_minutes: int = 60) -> DataFrame:
    """samples with n, mean and worst over the window that ends at each sample.

    Blocks of time are separate tasks: a row near a block's start also needs the end of the block before, so each
    sample is also sent to the next block if it can matter there. A block is at least as long as the window.
    """
    span = minutes * 60 * 1_000_000
    size = max(minutes, block_minutes) * 60 * 1_000_000
    t = samples.withColumn("_t", F.unix_micros(F.col("at").cast("timestamp")))
    block = F.floor(F.col("_t") / size)
    t = t.withColumn("_b", F.explode(F.array_distinct(F.array(block, F.floor((F.col("_t") + span) / size))))).withColumn("_own", F.col("_b") == block)
    w = Window.partitionBy("_b").orderBy("_t").rangeBetween(-span, Window.currentRow)
    out = t.withColumn("n", F.count("ms").over(w)).withColumn("mean", F.avg("ms").over(w)).withColumn("worst", F.max("ms").over(w))
    return out.where("_own").drop("_t", "_b", "_own")


def sparkline(samples: DataFrame, height: int = 16, by: str = "at") -> DataFrame:
    """by, level: ms scaled between its least and largest value to 0..height; the middle if all are equal."""
    ends = samples.agg(F.min("ms").alias("_lo"), F.max("ms").alias("_hi"))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("ms") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    return samples.crossJoin(F.broadcast(ends)).select(by, F.round(share * height).cast("int").alias("level"))  # one row


def progress(loaded: Column, total: Column) -> Column:
    """Share of bytes loaded, at most 1; null without a total. Aggregates over rows."""
    return F.when(F.sum(total) > 0, F.least(F.lit(1.0), F.sum(loaded) / F.sum(total)))


def usage(samples: DataFrame) -> DataFrame:
    """at, cpu, memory summed over processes."""
    return samples.groupBy("at").agg(F.sum("cpu").alias("cpu"), F.sum("memory").alias("memory"))
