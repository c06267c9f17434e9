"""Telemetry as a stream of (at, ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lag_bucket


def rolling_histogram(samples: DataFrame, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """window, bucket, n: counts by octave in sliding windows; later rows than the watermark are dropped."""
    return samples.withWatermark("at", late).groupBy(F.window("at", window, slide), lag_bucket(F.col("ms")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def rolling_summary(samples: DataFrame, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return samples.withWatermark("at", late).groupBy(F.window("at", window, slide)).agg(F.count("ms").alias("n"), F.avg("ms").alias("mean"), F.max("ms").alias("worst"))
