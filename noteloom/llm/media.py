"""Media columns: a payload stored as an 8-bit WAV, read back by the wave module, and its spectral fingerprint.

The payload is the text in UTF-8, filled up with spaces to a positive multiple of `frame` bytes. It is stored as mono
8-bit samples, which is lossless, and read back from the stored bytes. A short-time Fourier transform (a window of
one frame, moved by half a frame, with half a frame of silence before and after the samples, so that a single frame has
three slots; silence is the level of the filling spaces) gives magnitudes. A peak is a bin above its neighbours; in each
time slot each of two frequency bands keeps its strongest peak, without peaks its strongest bin, and none if it is silent.
Peaks are paired with those of the next two slots. A pair is one integer (both
bins and the distance in slots) with the slot as its time code. The arrays are whole: every pair of every slot is there.

Null text counts as empty. Repeated rows stay. Empty tables give none. Memory is in proportion to one text.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import arrow_limits

FRAME = 192
RATE = 8000
SILENCE = 32
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "pair_times array<int>, pair_codes array<int>"
)


def payload(text: str | None, frame: int = FRAME) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(frame, -(-len(raw) // frame) * frame), b"\x20")


def stored(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peak_pairs(samples: bytes, frame: int = FRAME, slots: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and pair codes. Blocks of `slots` windows bound the memory of the transform."""
    x = np.pad(np.frombuffer(samples, np.uint8).astype(np.float32) - SILENCE, frame // 2)  # for the transform alone
    windows = np.lib.stride_tricks.sliding_window_view(x, frame)[:: frame // 2]
    taper = np.hamming(frame).astype(np.float32)
    half = frame // 4
    peaks = np.empty((len(windows), 2), np.int32)
    for i in range(0, len(windows), slots):
        power = np.abs(np.fft.rfft(windows[i : i + slots] * taper, axis=1)).round(1)  # rounded, so that noise makes no peak
        inner = power[:, 1:-1]  # bin j stands at j - 1
        tops = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        for band, part in enumerate((slice(0, half - 1), slice(half - 1, None))):
            own = np.where(tops[:, part].any(1, keepdims=True), tops[:, part], inner[:, part])
            peaks[i : i + slots, band] = np.where(own.any(1), own.argmax(1) + part.start + 1, 0)
    times, codes = [], []
    for d in (1, 2):
        for a in (0, 1):
            for b in (0, 1):
                here, there = peaks[: len(peaks) - d, a], peaks[d:, b]
                both = np.flatnonzero((here > 0) & (there > 0))
                times.append(both.astype(np.int32))
                codes.append((here[both] << 16) | (there[both] << 4) | d)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def features(docs: DataFrame, frame: int = FRAME, rate: int = RATE) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored). See the module's text.

    feature: the number of pairs and a digest of the time-coded pairs, which follow whole in pair_times and pair_codes.
    """

    def one(doc_id, text):
        n, samples = payload(text, frame)
        media = stored(samples, rate)
        back = read_back(media)
        times, codes = peak_pairs(back, frame)
        digest = hashlib.blake2b(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes(), digest_size=16).hexdigest()
        return doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(times)}:{digest}", times, codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = [x.strip().split()[0] for x in SCHEMA.split(",")]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids), 256):
                rows = [one(k, t.as_py()) for k, t in zip(ids[i : i + 256], texts[i : i + 256], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    arrow_limits(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)
