"""Vaults: folders of Markdown files as DataFrames, on any file system that Spark reads."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.workspace import cut


#: From so many folders on a level of the tree is listed by executors: all levels, since one folder may hold most of the files.
SPREAD = 1
#: Files in a batch that a Python worker hands over, and about how many bytes of content.
FILES, BYTES = 10_000, 8 << 20


def _list(spark: SparkSession, root: str, folders: list[str]) -> list[tuple[str, bool, int]]:
    """(path relative to root, is a folder, mtime ms) of what stands in the folders; names that start with a dot are left out."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path, out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    for rel in folders:
        for st in fs.listStatus(path(f"{root.rstrip('/')}/{rel}") if rel else top):
            name = st.getPath().getName()
            if not name.startswith("."):
                out.append((f"{rel}/{name}" if rel else name, st.isDirectory(), st.getModificationTime()))
    return out


def _opener(root: str):
    """What lists the folders of root in a Python worker: (file system, path of root), or None where only the JVM can."""
    from pyarrow import fs

    try:
        system, top = fs.FileSystem.from_uri(root) if re.match("[a-z0-9]+:", root) else (fs.LocalFileSystem(), root)
        return (system, top.rstrip("/")) if system.get_file_info(top.rstrip("/")).type == fs.FileType.Directory else None
    except (OSError, ValueError, NotImplementedError):
        return None


def _list_spread(folders: DataFrame, root: str) -> DataFrame:
    """_list() by executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, top = _opener(root)
        for f in frames:
            rows = []
            for rel in f.rel:
                for x in system.get_file_info(fs.FileSelector(f"{top}/{rel}" if rel else top)):
                    if not x.base_name.startswith("."):
                        rows.append((f"{rel}/{x.base_name}" if rel else x.base_name, x.type == fs.FileType.Directory, x.mtime_ns // 1_000_000))
                    if len(rows) >= FILES:
                        yield pd.DataFrame(rows, columns=["rel", "is_dir", "mtime"])
                        rows = []
            yield pd.DataFrame(rows, columns=["rel", "is_dir", "mtime"])

    return folders.select("rel").mapInPandas(run, "rel string, is_dir boolean, mtime long")


def listing(spark: SparkSession, root: str, spread: int = SPREAD) -> DataFrame:
    """rel, is_dir, mtime (ms) of all files and folders below root, level by level; no content is read.

    Folders whose names start with a dot are left out with all below them. A level of `spread` folders or more is listed
    by executors, a folder a task, and only its number comes back. That needs a file system that Python workers can open
    (local and mounted ones, and those that pyarrow knows); any other is listed through the driver's Hadoop client.
    """
    schema = "rel string, is_dir boolean, mtime long"
    able = _opener(root) is not None
    folders, found = [""], []
    while folders and not (able and len(folders) >= spread):
        below = _list(spark, root, folders)
        found += below
        folders = [r for r, is_dir, _ in below if is_dir]
    every = spark.createDataFrame(found, schema)
    level = spark.createDataFrame([(r,) for r in folders], "rel string")
    while folders:
        here = cut(_list_spread(level.repartition(max(1, min(10_000, len(folders) if isinstance(folders, list) else folders))), root))
        every, level = every.unionByName(here), here.where("is_dir").select("rel")
        folders = level.count()
    return every


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """rel, mtime of all notes below root."""
    return listing(spark, root).where(~F.col("is_dir") & F.lower("rel").endswith(".md")).select("rel", "mtime")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, name, rel, mtime of all .md files (any case) below root, in language-aware order of rel."""
    df = _listed(spark, root).select(F.concat(F.lit(root.rstrip("/") + "/"), "rel").alias("path"), "rel", "mtime")
    name = F.regexp_replace(F.element_at(F.split("rel", "/"), -1), r"(?i)\.md$", "")
    return df.select("path", name.alias("name"), "rel", "mtime").orderBy(F.collate("rel", "UNICODE"), "rel")


def folders(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).where("is_dir").select("rel")


def _relative(path: Column, root: str) -> Column:
    """A file's path below root, whatever scheme either is written with."""
    top = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z0-9]+:/+", "/")
    return F.substring(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"), F.length(top) + 2, F.length(path))


def notes(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content, mtime of all notes below root; executors list the folders and open the files.

    Where Python workers can't open the file system, files are found and read by Spark's recursive scan, whose list is the
    driver's. It passes over names with a leading underscore; those are listed, and read by their paths.
    """
    if _opener(root) is not None:
        return _read(cut(_listed(spark, root)), root)
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][dD]").option("recursiveFileLookup", "true").load(root.rstrip("/"))
    read = df.select(_relative(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("content"), F.unix_millis("modificationTime").alias("mtime"))
    shown = read.where(~F.col("path").rlike(r"(^|/)[._]"))
    odd = _listed(spark, root).where(F.col("rel").rlike("(^|/)_"))
    return shown.unionByName(_read(odd, root))


def _read(found: DataFrame, root: str) -> DataFrame:
    """path, content, mtime of the notes found (rel, mtime; read twice), of which each is opened once, by the executors.

    Where Python workers can't open the file system, the paths go to Spark's reader of binary files; it can't see those with
    a leading underscore, which are few and are read through the driver.
    """
    spark = found.sparkSession
    if _opener(root) is not None:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            system, top = _opener(root)
            rows, size = [], 0
            for f in frames:
                for rel, mtime in zip(f.rel, f.mtime, strict=True):
                    try:
                        with system.open_input_stream(f"{top}/{rel}") as stream:
                            content = stream.read()
                    except FileNotFoundError:
                        continue  # deleted since it was listed; the next listing says so
                    rows.append((rel, content.decode("utf-8", "replace"), mtime))
                    size += len(content)
                    if size >= BYTES or len(rows) >= FILES:
                        yield pd.DataFrame(rows, columns=["path", "content", "mtime"])
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "content", "mtime"])

        # opening is slow and names are short, so files are dealt by number, not by the size of their rows
        n = max(spark.sparkContext.defaultParallelism, min(found.count() // 1000, 10_000))
        return found.select("rel", "mtime").repartition(n).mapInPandas(run, "path string, content string, mtime long")
    rows = [(r["rel"], r["mtime"]) for r in found.collect()]
    odd = [(r, m) for r, m in rows if any(p.startswith("_") for p in r.split("/"))]
    out = _each(spark, root.rstrip("/"), odd)
    if plain := [f"{root.rstrip('/')}/{r}" for r, _ in rows if (r, _) not in set(odd)]:
        df = spark.read.format("binaryFile").load(plain)
        out = out.unionByName(df.select(_relative(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("content"), F.unix_millis("modificationTime").alias("mtime")))
    return out


def _each(spark: SparkSession, base: str, found: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(r, _text(spark, f"{base}/{r}"), m) for r, m in found], "path string, content string, mtime long")


def note(spark: SparkSession, root: str, path: str) -> DataFrame:
    """path, content, mtime of one note; no row if it is not there. What index upkeep takes for a single file."""
    if not inside(path):
        raise ValueError(f"not a path of the vault: {path!r}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return _each(spark, root.rstrip("/"), [(path, fs.getFileStatus(at).getModificationTime())] if fs.exists(at) else [])


def changes(spark: SparkSession, root: str, known: DataFrame, settle_ms: int = 0) -> DataFrame:
    """path, content, mtime of the notes that are new or have another mtime than known (path, mtime) says; null content: deleted.

    Paths and times are compared first; only the changed notes are opened. A file changed less than settle_ms ago may
    still be written to; it waits for the next call.
    """
    newest = int(time.time() * 1000) - settle_ms
    both = _listed(spark, root).withColumnRenamed("rel", "path").join(known.select("path", F.col("mtime").alias("known")), "path", "full_outer")
    changed = cut(both.where((F.col("mtime").isNull()) | ((F.col("mtime") <= newest) & ~F.col("mtime").eqNullSafe(F.col("known")))))
    gone = changed.where("mtime is null").select("path", F.lit(None).cast("string").alias("content"), F.col("known").alias("mtime"))
    return _read(changed.where("mtime is not null").select(F.col("path").alias("rel"), "mtime"), root).unionByName(gone)


def write(spark: SparkSession, root: str, path: str, content: str) -> None:
    """Creates a note, or replaces it by one rename."""
    if not inside(path):
        raise ValueError(f"not a path of the vault: {path!r}")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    at, tmp = hadoop.fs.Path(f"{root.rstrip('/')}/{path}"), hadoop.fs.Path(f"{root.rstrip('/')}/.{uuid.uuid4().hex}")
    fs = at.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(content.encode())
    out.close()
    fs.mkdirs(at.getParent())
    options = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    options[0] = hadoop.fs.Options.Rename.OVERWRITE
    hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(tmp), fs.makeQualified(at), options)


def delete(spark: SparkSession, root: str, path: str) -> bool:
    """Deletes a note, or a folder with all below it."""
    if not inside(path):
        raise ValueError(f"not a path of the vault: {path!r}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move(spark: SparkSession, root: str, old: str, new: str) -> None:
    """Renames a note or a folder; a target that exists raises."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    a, b = path(f"{root.rstrip('/')}/{old}"), path(f"{root.rstrip('/')}/{new}")
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        raise ValueError(f"cannot move {old!r} to {new!r}")


def _text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def note_stream(spark: SparkSession, root: str) -> DataFrame:
    """New notes as a stream of (path, content, mtime), with paths as notes() has them. Changes and deletions: streaming.index.watch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[mM][dD]").option("recursiveFileLookup", "true").load(root)
    return df.select(_relative(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("content"), F.unix_millis("modificationTime").alias("mtime"))


def inside(path: str) -> bool:
    """Whether a relative path stays below the vault and enters no hidden folder."""
    parts = path.replace("\\", "/").split("/")
    return bool(path) and not path.startswith("/") and all(p and not p.startswith(".") for p in parts)
