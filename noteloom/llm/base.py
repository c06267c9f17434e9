"""What the operators of this package share: reading tables, shared work folders, and column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a small table's file.
ROWS_PER_FILE = 100_000
_kept: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below sf_dir, read by Spark alone, so any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

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


def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage and survives the loss of any executor.

    rows: about how many rows it has or comes from, if known; few rows then go into few files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_PER_FILE)
    path = f"{shared_dir(spark)}/noteloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _kept.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._noteloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables written by keep() that no later step reads."""
    for df in frames:
        _delete(df.sparkSession, df._noteloom_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _kept[:] = [x for x in _kept if x[1] != path]


@atexit.register
def _delete_all() -> None:
    for spark, path in list(_kept):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the shared folder's owner clears what is left
            return


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas see it as a bound variable."""
    return F.transform(F.array(value), body).getItem(0)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is the faster way for a text of ASCII alone."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _ASCII, _ASCII.lower()))


def words_of(text: Column) -> Column:
    """The words of the text in order: WORD's matches, by a split at single spaces."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def split_words(text: Column) -> Column:
    """words_of(text) with A-Z lowered."""
    return words_of(lower_ascii(text))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefixes(values: Column, zero: Column, join, block: int = 256) -> Column:
    """What join, which is associative with zero as its neutral element, makes of the elements before each element of an array<long>.

    In blocks, so that no step copies the whole array.
    """

    def run(items: Column, first: Column) -> Column:
        return F.aggregate(items, F.array(first.cast("long")), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))

    def of_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, zero.cast("long"), join))
        return let(run(whole, zero), lambda offs: F.flatten(F.transform(blocks, lambda b, i: let(run(b, F.get(offs, i)), lambda r: F.slice(r, F.lit(1), F.size(b))))))

    def whole(v: Column) -> Column:
        n = F.ceil(F.size(v) / F.lit(block)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        return F.when(F.size(v) == 0, F.array().cast("array<long>")).otherwise(let(blocks, of_blocks))

    return let(values, whole)


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Sums of the elements before each element of an array<long>."""
    return prefixes(values, F.lit(0), lambda a, x: a + x, block)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start:long, end:long, hit:string, part:string>>: leftmost non-overlapping matches of pattern.

    start and end count code points, end exclusive; part is the given group. Between two matches split() gives
    the gaps of the same matcher, so running sums of lengths give the offsets.
    """
    p = F.lit(pattern)

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
        ends = let(steps, lambda s: F.zip_with(prefix_sums(s), s, lambda a, b: a + b))
        parts = hits if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
        return F.transform(
            F.arrays_zip(ends.alias("e"), hits.alias("h"), parts.alias("p")),
            lambda x: F.struct((x["e"] - F.length(x["h"])).alias("start"), x["e"].alias("end"), x["h"].alias("hit"), x["p"].alias("part")),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,part:string>>")
    return let(F.regexp_extract_all(text, p, F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(placed(hits)))


def arrow_limits(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that many very long texts do not meet in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
