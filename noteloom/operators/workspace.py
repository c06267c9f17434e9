"""Tables between steps: a folder that driver and executors share, and cuts of long lineages."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset, a temporary folder serves local sessions, whose executors are this process; a cluster without
    the setting raises, since a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    set_by_cluster = sc.getConf().get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("noteloom.work.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="noteloom-")
        spark.conf.set("noteloom.work.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def few(df: DataFrame) -> DataFrame:
    """A result that a limit bounds, computed once: its rows become a local table."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df with a column of numbers from 0 in the given total order, without bringing all rows to one task.

    Rows are dealt into ranges of the order; a range's rows are numbered inside, after the counts of the ranges before.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    both = ranged.withColumn("_nth", inside).join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return both.withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_range", "_nth", "_before")


def grouped(df: DataFrame, by: str, order: list[str], run: Callable[[pa.Table], list[dict]], schema: str) -> DataFrame:
    """The rows that run makes of the rows of each value of `by`, in order.

    Partitions are sorted and pass in Arrow batches of many values, so that small groups cost no batch of their own; a
    worker holds one batch and the rows of one value.
    """
    made = to_arrow_schema(StructType.fromDDL(schema))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            keys, out = b.column(b.schema.get_field_index(by)).to_pylist(), []
            changes = [i for i in range(len(keys)) if keys[i] != (keys[i - 1] if i else last)]
            last = keys[-1] if keys else last
            for x, y in pairwise(sorted({0, *changes, len(keys)})):
                if held and (x or changes[:1] == [0]):
                    out += run(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(x, y - x))
            yield pa.RecordBatch.from_pylist(out, schema=made)
        if held:
            yield pa.RecordBatch.from_pylist(run(pa.Table.from_batches(held)), schema=made)

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(parts, schema)


def dealt(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df in parts of about `rows` rows, at least one per core: a small file of many rows is one task, however long each row takes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))
