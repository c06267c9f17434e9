"""Incremental tables: replace, remove and re-chunk by key, snapshot differences, and merge or undo of a run.

Tables are DataFrames; each function returns the table's next state, which the caller writes to a new place and
publishes (write_table, update_table). A table's folder holds versions and numbered manifests that name the parts of
each state. A manifest appears by one rename to a name that is new, and readers take the one of highest number, so
there is always a whole state to read. The two newest states stay readable; what only older ones used is deleted. One
writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .workspace import numbered


def replace(table: DataFrame, rows: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """table without the rows of keys, and with rows. Doing it twice changes nothing."""
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def remove(table: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def upsert(table: DataFrame, rows: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return table.unionByName(rows).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def hashes(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("path").alias("file"), F.sha1(F.coalesce("content", F.lit("")).cast("binary")).alias("hash"))


def changed_files(known: DataFrame, now: DataFrame) -> DataFrame:
    """file, change (added, modified, deleted) between two tables of (file, hash)."""
    k = known.select(F.col("file").alias("f"), F.col("hash").alias("h"))
    both = now.join(k, F.col("file") == F.col("f"), "full_outer")
    change = F.when(F.col("f").isNull(), "added").when(F.col("file").isNull(), "deleted").when(F.col("hash") != F.col("h"), "modified")
    return both.select(F.coalesce("file", "f").alias("file"), change.alias("change")).where("change is not null")


def rechunk(chunks: DataFrame, vectors: DataFrame, known: DataFrame, notes: DataFrame, make) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next chunks, vectors and hashes: only files whose content changed are chunked (by make) and lose their vectors."""
    now = hashes(notes)
    diff = changed_files(known, now)
    dirty, fresh = diff.select("file"), diff.where("change <> 'deleted'").select(F.col("file").alias("path"))
    new = make(notes.join(fresh, "path", "left_semi"))
    return replace(chunks, new, dirty, "file"), remove(vectors, dirty, "file"), now


def pending(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector."""
    return chunks.join(vectors.select("file", "ord"), ["file", "ord"], "left_anti")


def pending_batches(chunks: DataFrame, vectors: DataFrame, size: int = 32) -> DataFrame:
    """pending() with a column batch: by file and place, `size` chunks each, the last one perhaps fewer."""
    return numbered(pending(chunks, vectors), "batch", "file", "ord").withColumn("batch", F.floor(F.col("batch") / size))


def unchunked(files: DataFrame, known: DataFrame) -> DataFrame:
    return files.join(known.select(F.col("file").alias("path")), "path", "left_anti")


def put_vectors(vectors: DataFrame, rows: DataFrame, dims: int) -> DataFrame:
    """vectors with rows in place of those of the same chunk; every vector must have dims elements."""
    checked = rows.withColumn("embedding", F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector does not have {dims} elements"))))
    return vectors.join(rows.select("file", "ord").distinct(), ["file", "ord"], "left_anti").select(*vectors.columns).unionByName(checked.select(*vectors.columns))


def set_dims(vectors: DataFrame, known: int | None, dims: int) -> DataFrame:
    """vectors as they are if their length stays; none, so that all chunks wait for new ones, if it changes."""
    return vectors if known == dims else vectors.limit(0)


def vector_status(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks, embedded and pending: counts, one row."""
    have = vectors.select("file", "ord", F.lit(1).alias("_have")).dropDuplicates(["file", "ord"])
    both = chunks.select("file", "ord").join(have, ["file", "ord"], "left")
    return both.agg(F.count(F.lit(1)).alias("chunks"), F.count("_have").alias("embedded"), (F.count(F.lit(1)) - F.count("_have")).alias("pending"))


def repath(table: DataFrame, old: str, new: str, key: str = "path") -> DataFrame:
    """Renames a file or a folder with all below it."""
    inside = (F.col(key) == old) | F.col(key).startswith(old + "/")
    return table.withColumn(key, F.when(inside, F.concat(F.lit(new), F.expr(f"substring({key}, {len(old) + 1})"))).otherwise(F.col(key)))


def add_relation(notes: DataFrame, path: str, relation: str, target: str) -> DataFrame:
    """notes with a typed link appended to one note."""
    import re

    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_ -]*", relation):
        raise ValueError("a relation starts with a letter and holds letters, digits, spaces, - and _")
    line = f"{relation}:: [[{target}]]\n"
    text = F.col("content")
    grown = F.when((text == "") | text.endswith("\n"), F.concat(text, F.lit(line))).otherwise(F.concat(text, F.lit("\n" + line)))
    return notes.withColumn("content", F.when(F.col("path") == path, grown).otherwise(text))


def merge_run(vault: DataFrame, run: DataFrame, run_id: str, folder: str = "Distilled") -> tuple[DataFrame, DataFrame]:
    """The vault with a run's notes (file_name, content) under folder/run_id, and the manifest (run_id, path) of what was added."""
    rows = run.select(F.concat_ws("/", F.lit(folder), F.lit(run_id), F.col("file_name")).alias("path"), "content")
    return replace(vault.select("path", "content"), rows, rows), rows.select(F.lit(run_id).alias("run_id"), "path")


def undo_merge(vault: DataFrame, manifest: DataFrame, run_id: str) -> DataFrame:
    """The vault without exactly the files of the run's manifest."""
    return vault.join(manifest.where(F.col("run_id") == run_id).select("path"), "path", "left_anti").select(*vault.columns)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _fs(spark, folder)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def _manifests(spark: SparkSession, base: str) -> list[str]:
    return [n for n in _names(spark, base) if n.startswith("manifest-")]


def _manifest(spark: SparkSession, base: str, name: str) -> dict:
    return json.loads(spark.read.text(f"{base}/{name}").first()[0])


def _publish(spark: SparkSession, base: str, manifest: dict) -> None:
    """Make manifest the newest state, and delete what neither it nor the state before uses."""
    old = _manifests(spark, base)
    number = int(old[-1][9:-5]) + 1 if old else 0
    tmp, fs = _fs(spark, f"{base}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(json.dumps(manifest).encode())
    out.close()
    if not fs.rename(tmp, _fs(spark, f"{base}/manifest-{number:010d}.json")[0]):
        raise RuntimeError(f"another writer has published state {number} of {base}")
    used = set(manifest["parts"].values())
    if old:
        used |= set(_manifest(spark, base, old[-1])["parts"].values())
    versions = {p.split("/")[0] for p in used}
    for name in _names(spark, base):
        if name in old[:-1] or name.startswith("v-") and name not in versions:
            fs.delete(_fs(spark, f"{base}/{name}")[0], True)
        elif name.startswith("v-") and name not in used:
            for part in _names(spark, f"{base}/{name}"):
                if part.startswith("_bucket=") and f"{name}/{part}" not in used:
                    fs.delete(_fs(spark, f"{base}/{name}/{part}")[0], True)


def write_table(df: DataFrame, base: str) -> str:
    """Writes df as the table's next state; returns the version's path."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{version}")
    _publish(df.sparkSession, base, {"schema": df.schema.json(), "parts": {"whole": version}})
    return f"{base}/{version}"


def exists(spark: SparkSession, base: str) -> bool:
    return bool(_manifests(spark, base))


def read_table(spark: SparkSession, base: str) -> DataFrame:
    names = _manifests(spark, base)
    if not names:
        raise FileNotFoundError(f"no table at {base}")
    m = _manifest(spark, base, names[-1])
    schema = StructType.fromJson(json.loads(m["schema"]))
    parts = [f"{base}/{p}" for p in m["parts"].values()]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def update_table(base: str, rows: DataFrame, keys: DataFrame, key: str = "path", buckets: int = 64) -> None:
    """The table's next state: without the rows of keys, and with rows, whose keys are among them.

    Rows lie in buckets by a hash of their key. Only buckets of keys are read and written anew; the others are taken
    over from the state before as they are. Doing it twice changes nothing. The number of buckets is the table's, from
    its first state on.
    """
    spark = rows.sparkSession
    names = _manifests(spark, base)
    m = _manifest(spark, base, names[-1]) if names else {"schema": rows.schema.json(), "parts": {}, "buckets": buckets}
    if "buckets" not in m:
        raise ValueError(f"{base} was written whole; it has no buckets")
    bucket = F.pmod(F.xxhash64(key), F.lit(m["buckets"])).cast("int")
    touched = [str(r["b"]) for r in keys.select(bucket.alias("b")).distinct().collect()]  # at most as many as there are buckets
    if not touched:
        return
    schema = StructType.fromJson(json.loads(m["schema"]))
    here = [f"{base}/{m['parts'][b]}" for b in touched if b in m["parts"]]
    now = spark.read.schema(schema).parquet(*here) if here else spark.createDataFrame([], schema)
    version = f"v-{uuid.uuid4().hex}"
    replace(now, rows, keys, key).withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{base}/{version}")
    written = {n.partition("=")[2]: f"{version}/{n}" for n in _names(spark, f"{base}/{version}") if n.startswith("_bucket=")}
    kept = {b: p for b, p in m["parts"].items() if b not in touched}
    _publish(spark, base, {**m, "parts": kept | written})


def drop_tables(spark: SparkSession, base: str, names: tuple[str, ...] = ("chunks", "vectors", "hashes")) -> None:
    """Drops a layer: the tables of those names below base are gone, whatever their state; others stay."""
    for name in names:
        p, fs = _fs(spark, f"{base}/{name}")
        fs.delete(p, True)


def merge_recents(recents: DataFrame, opened: DataFrame, cap: int = 10) -> DataFrame:
    """path, at: the cap most recently opened paths."""
    return recents.unionByName(opened).groupBy("path").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "path").limit(cap)
