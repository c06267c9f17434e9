"""What searches read: the text index and the vectors of a table, built once per session and state of the table, in the shared folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import search
from ..operators.workspace import shared_dir

_places: dict[tuple[str, str, str], tuple[SparkSession, str, int]] = {}


def new_place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/noteloom-index-{uuid.uuid4().hex}"


def state(spark: SparkSession, path: str) -> int:
    """A number that changes with the names, sizes and times of the files below path, which are listed and not read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    found = []
    while files.hasNext():
        st = files.next()
        found.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return hash(tuple(sorted(found)))


def built(spark: SparkSession, kind: str, source: str, write: Callable[[str], object], again: bool = False) -> str:
    """Where the `kind` made from the table at source stands; write(place) makes it where it is missing, older than source, or asked for again."""
    key, now = (spark.sparkContext.applicationId, kind, source), state(spark, source)
    if again or key not in _places or _places[key][2] != now:
        place = new_place(spark)
        write(place)
        old = _places.get(key)
        _places[key] = (spark, place, now)
        if old:
            _delete(*old[:2])
    return _places[key][1]


def text_index(spark: SparkSession, kind: str, source: str, notes: Callable[[], DataFrame], again: bool = False) -> search.TextIndex:
    return search.open_index(spark, built(spark, kind, source, lambda place: search.build_index(notes(), place), again))


def stored(spark: SparkSession, kind: str, source: str, rows: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """rows, written once and read back."""
    return spark.read.parquet(built(spark, kind, source, lambda place: rows().write.parquet(place), again))


def _delete(spark: SparkSession, place: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _release() -> None:
    for spark, place, _ in _places.values():
        try:
            _delete(spark, place)
        except Exception:  # the session has ended; the shared folder's owner clears what is left
            return
