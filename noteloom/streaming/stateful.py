"""Index upkeep as state of a stream: what each file last was, what waits for it to settle, what waits for a vector.

upkeep() takes changes of notes (path, content, mtime; null content deletes) in any order and number, and gives what has
to be done, as rows. State is keyed by path, so a file's changes meet in one place and files spread over all tasks:

* a change waits until none has come for `settle_ms`; of several changes the one of largest mtime stays (the last of
  equal ones);
* then its content hash is compared with the one that was chunked last: an equal one does nothing, another one gives a
  row `replace`, and a deletion of a known file a row `delete`; either drops what the file still had pending;
* the new chunks wait in a queue, of which every tick of the timer gives `batch` rows `embed`, until it is empty.

State lies in the checkpoint, so a restarted query goes on with the same hashes, timers and queues.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.markdown import chunk_markdown

CHUNK = "ord int, heading string, start long, end long, text string"
ROW = f"path string, op string, batch int, {CHUNK}"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = [x.strip().split()[0] for x in ROW.split(",")]


class Upkeep(StatefulProcessor):
    def __init__(self, settle_ms: int = 150, batch: int = 32, most: int = 1600):
        self.settle_ms, self.batch, self.most = settle_ms, batch, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "content string, mtime long")
        self.known = handle.getValueState("known", "hash string")
        self.pending = handle.getListState("pending", CHUNK)
        self.given = handle.getValueState("given", "batches int")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.waiting.get() if self.waiting.exists() else None
        for frame in rows:
            for content, mtime in zip(frame.content, frame.mtime, strict=True):
                if last is None or mtime >= last[1]:
                    last = (None if pd.isna(content) else content, int(mtime))
        if last is not None:
            self.waiting.update(tuple(last))
            self._timer(timerValues.getCurrentProcessingTimeInMs() + self.settle_ms)
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, path = [], key[0]
        if self.waiting.exists():
            content, _ = self.waiting.get()
            self.waiting.clear()
            out += self._settled(path, content)
        queue = list(self.pending.get()) if self.pending.exists() else []
        if queue:
            nth = self.given.get()[0] if self.given.exists() else 0
            out += [(path, "embed", nth, *row) for row in queue[: self.batch]]
            self.given.update((nth + 1,))
            self.pending.clear()
            if queue[self.batch :]:
                self.pending.put(queue[self.batch :])
                self._timer(timerValues.getCurrentProcessingTimeInMs() + 1)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def _settled(self, path: str, content: str | None) -> list[tuple]:
        known = self.known.get()[0] if self.known.exists() else None
        if content is None:
            self.known.clear()
            self.pending.clear()
            return [(path, "delete", *[None] * 6)] if known else []
        found = hashlib.sha1(content.encode()).hexdigest()
        if found == known:
            return []
        self.known.update((found,))
        self.pending.clear()
        self.given.clear()
        if chunks := chunk_markdown(content, self.most):
            self.pending.put([(i, *c) for i, c in enumerate(chunks)])
        return [(path, "replace", *[None] * 6)]

    def close(self) -> None:
        pass


def upkeep(changes: DataFrame, settle_ms: int = 150, batch: int = 32, most: int = 1600) -> DataFrame:
    """path, op (replace, delete, embed), and of `embed` rows: the number of the batch, and the chunk with a number in its file.

    changes: a stream. Sets the session's state store to the one that keyed state of this kind needs.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    keyed = changes.select("path", "content", "mtime").groupBy("path")
    return keyed.transformWithStateInPandas(Upkeep(settle_ms, batch, most), ROW, "Append", "ProcessingTime")
