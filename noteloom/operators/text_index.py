"""A stored text index that follows its notes: positional postings in segments, replaced files, running totals.

Below the index's folder four tables are partitioned by segment: `notes` (key, file, title, body, n tokens), `postings`
(token, key, file, n, field, positions from 0), `gone` (files that the segment replaces or deletes) and `totals`. A
build writes segment 1. An update of m notes writes the postings of those m notes into the next segment and their files
into `gone`, which hides every earlier row of these files; nothing written before is touched. Its row of `totals` comes
last and makes the segment count: a reader takes the newest row there, so an update that ended before it has changed
nothing, and writing it again overwrites what it left. Totals run along (notes, tokens), so a search needs no count.
compact() writes the live rows as one segment; what the compaction before had replaced is deleted then, so that readers
of the state before are not disturbed. One writer at a time.

Postings are clustered by token: a prefix is a range of few row groups in each segment, and a frequent token spreads
over several files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

TOTALS = "since long, notes long, tokens long, gone long, segment long"
#: An update that makes more segments than this compacts the index.
SEGMENTS = 16
#: Replaced files up to this number are broadcast.
FEW = 200_000


@dataclass
class TextIndex:
    """notes: key, file, title, body, n (tokens); postings: token, key, file, n, field, positions; both live rows only. total notes, mean n."""

    notes: DataFrame
    postings: DataFrame
    total: int
    mean: float


@dataclass
class _State:
    segment: int = 0
    since: int = 1
    notes: int = 0
    tokens: int = 0
    gone: int = 0


def _state(spark: SparkSession, base: str) -> _State:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/totals")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return _State()
    rows = spark.read.schema(TOTALS).parquet(f"{base}/totals").orderBy(F.desc("segment")).limit(1).collect()
    return _State(**rows[0].asDict()) if rows else _State()


def _live(spark: SparkSession, base: str, table: str, s: _State) -> DataFrame:
    """The rows of a table that no later segment has replaced."""
    in_state = F.col("segment").between(s.since, s.segment)
    rows = spark.read.parquet(f"{base}/{table}").where(in_state)
    if not s.gone:
        return rows
    upto = spark.read.parquet(f"{base}/gone").where(in_state).groupBy("file").agg(F.max("segment").alias("_upto"))
    both = rows.join(F.broadcast(upto) if s.gone <= FEW else upto, "file", "left")
    return both.where("_upto is null or segment >= _upto").select(*rows.columns)


def _rows(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The notes and postings that a segment stores of notes (key, title, body and perhaps file)."""
    file = F.col("file") if "file" in notes.columns else F.col("key")
    t = notes.select("key", file.alias("file"), "title", "body", tokens(F.col("title")).alias("_title"), tokens(F.col("body")).alias("_body"))
    n = (F.size("_title") + F.size("_body")).cast("long").alias("n")
    kinds = dict(t.dtypes)
    posted = t.select("key", "file", "_title", "_body").mapInArrow(_posted, f"token string, key {kinds['key']}, file {kinds['file']}, n long, field string, positions array<int>")
    return t.select("key", "file", "title", "body", n), posted.repartitionByRange("token", "key").sortWithinPartitions("token", "key", "field")


#: About how many tokens are sorted at once.
SORTED = 500_000


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of notes (key, file, tokens of the title, of the body).

    A note's postings are whole before they are shuffled, so a row travels for each of its words, not for each occurrence;
    and they leave in the order of the tokens, in which they pack well.
    """
    for b in batches:
        sizes = [pc.list_value_length(b.column(i)).to_numpy(zero_copy_only=False) for i in (2, 3)]
        n = np.array(sizes[0] + sizes[1], np.int64)
        part = np.cumsum(n) // SORTED
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(n)] if len(n) else [0]
        for i, j in pairwise(map(int, cuts)):
            some = b.slice(i, j - i)
            for field, column in (("title", 2), ("body", 3)):
                yield _postings_of(some, n[i:j], field, some.column(column))


def _postings_of(b: pa.RecordBatch, n: np.ndarray, field: str, lists: pa.Array) -> pa.RecordBatch:
    coded = pc.dictionary_encode(lists.flatten())
    note = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.bincount(note, minlength=len(b)) if len(note) else np.zeros(len(b), np.int64)
    pos = np.arange(len(note)) - (np.cumsum(size) - size)[note]
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    group = rank[coded.indices.to_numpy(zero_copy_only=False)] * len(b) + note
    order = np.argsort(group, kind="stable")  # positions stay in order
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    first, row = order[starts], note[order[starts]]
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(pos[order], pa.int32()))
    token = coded.dictionary.take(coded.indices.take(pa.array(first)))
    whole = [token, b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(n[row], pa.int64()), pa.array([field]).take(pa.array(np.zeros(len(row), np.int64))), positions]
    return pa.RecordBatch.from_arrays(whole, ["token", "key", "file", "n", "field", "positions"])


def _write(df: DataFrame, base: str, table: str, segment: int) -> None:
    df.write.mode("overwrite").parquet(f"{base}/{table}/segment={segment}")


def _publish(spark: SparkSession, base: str, s: _State) -> None:
    row = spark.createDataFrame([(s.since, s.notes, s.tokens, s.gone)], "since long, notes long, tokens long, gone long")
    _write(row.coalesce(1), base, "totals", s.segment)


def _sums(notes: DataFrame) -> tuple[int, int]:
    r = notes.agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    return r["notes"], r["tokens"]


def build(notes: DataFrame, base: str) -> TextIndex:
    """Writes the index of notes (key, title, body and perhaps file, the unit of replacement, else the key) below base, which must be new."""
    spark = notes.sparkSession
    rows, posted = _rows(notes)
    _write(rows, base, "notes", 1)
    _write(posted, base, "postings", 1)
    _write(rows.select("file").limit(0), base, "gone", 1)
    n, size = _sums(spark.read.parquet(f"{base}/notes/segment=1"))
    _publish(spark, base, _State(1, 1, n, size))
    return open_index(spark, base)


def open_index(spark: SparkSession, base: str) -> TextIndex:
    s = _state(spark, base)
    if not s.segment:
        raise FileNotFoundError(f"no index at {base}")
    notes, posted = (_live(spark, base, t, s).drop("segment") for t in ("notes", "postings"))
    return TextIndex(notes, posted, s.notes, s.tokens / s.notes if s.notes else 0.0)


def update(base: str, notes: DataFrame, files: DataFrame, compact_at: int = SEGMENTS) -> TextIndex:
    """Replaces all that the index holds of files (column file) by notes, whose files are among them; files without notes are deleted.

    Both are read more than once. Doing it twice changes nothing that a search sees.
    """
    spark = notes.sparkSession
    s = _state(spark, base)
    if not s.segment:
        return build(notes, base)
    number, files = s.segment + 1, files.select("file").distinct()
    rows, posted = _rows(notes)
    _write(files, base, "gone", number)
    _write(rows, base, "notes", number)
    _write(posted, base, "postings", number)
    gone = spark.read.schema(files.schema).parquet(f"{base}/gone/segment={number}")
    n_gone = gone.count()
    lost = _sums(_live(spark, base, "notes", s).select("file", "n").join(F.broadcast(gone) if n_gone <= FEW else gone, "file", "left_semi"))
    new = _sums(spark.read.schema(rows.schema).parquet(f"{base}/notes/segment={number}"))
    _publish(spark, base, _State(number, s.since, s.notes - lost[0] + new[0], s.tokens - lost[1] + new[1], s.gone + n_gone))
    if number - s.since >= compact_at:
        compact(spark, base)
    return open_index(spark, base)


def compact(spark: SparkSession, base: str) -> None:
    """Writes all live rows as one segment. Segments that the compaction before had replaced are deleted."""
    s = _state(spark, base)
    number = s.segment + 1
    notes, posted = (_live(spark, base, t, s).drop("segment") for t in ("notes", "postings"))
    _write(notes, base, "notes", number)
    _write(posted.repartitionByRange("token", "key").sortWithinPartitions("token", "key", "field"), base, "postings", number)
    _write(notes.select("file").limit(0), base, "gone", number)
    _publish(spark, base, _State(number, number, s.notes, s.tokens))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for table in ("totals", "notes", "postings", "gone"):
        for st in fs.listStatus(path(f"{base}/{table}")):
            if int(st.getPath().getName().partition("=")[2] or s.since) < s.since:
                fs.delete(st.getPath(), True)


def frequency(positions: str = "positions") -> Column:
    """How often a posting's note holds its token in the posting's field."""
    return F.size(positions).cast("long")
