"""Vectors of texts from a model of token vectors: opened once per Python worker, asked in batches, pooled by the mean.

A model is anything with token_vectors(texts), which gives a matrix (tokens, dims) for each text. open_model makes it, in
the worker that needs it; the worker keeps it for its later tasks under the given name. How many dims there are is asked
of the model itself by a probe, a job of one row, so the driver never opens it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH = 32
PROBE = "dimension probe"


class VectorModel(Protocol):
    def token_vectors(self, texts: list[str]) -> list[np.ndarray]: ...


class TokenTable:
    """An offline model: a vector for each known token (a run of letters or digits in lower case); others have none."""

    def __init__(self, vectors: dict[str, list[float]]):
        self.vectors = {k: np.asarray(v, np.float32) for k, v in vectors.items()}
        self.dims = len(next(iter(self.vectors.values()), ()))

    @classmethod
    def load(cls, path: str) -> TokenTable:
        """From an .npz file with `tokens` and a matrix `vectors`."""
        with np.load(path, allow_pickle=False) as f:
            return cls(dict(zip(f["tokens"].tolist(), f["vectors"], strict=True)))

    def token_vectors(self, texts: list[str]) -> list[np.ndarray]:
        none = np.zeros((0, self.dims), np.float32)
        found = ([self.vectors[t] for t in re.findall(r"[^\W_]+", x.lower()) if t in self.vectors] for x in texts)
        return [np.stack(v) if v else none for v in found]


def opened(name: str, open_model: Callable[[], VectorModel]) -> VectorModel:
    """The worker's model of this name, opened if it has none. Code that travels to executors has no module of its own to keep it in."""
    held = sys.modules.setdefault("noteloom_models", ModuleType("noteloom_models")).__dict__
    if name not in held:
        held[name] = open_model()
    return held[name]


def pooled(model: VectorModel, texts: list[str], dims: int) -> np.ndarray:
    """The mean of each text's token vectors, scaled to unit length; zero for a text without tokens."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, tokens in enumerate(model.token_vectors(texts)):
        if len(tokens):
            if tokens.shape[1] != dims:
                raise ValueError(f"the model gave {tokens.shape[1]} dims, its probe {dims}")
            mean = tokens.astype(np.float64).mean(0)
            out[i] = mean / (np.sqrt((mean * mean).sum()) or 1.0)
    return out


def probed_dims(spark: SparkSession, name: str, open_model: Callable[[], VectorModel]) -> int:
    """How many dims the model's token vectors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([opened(name, open_model).token_vectors([PROBE])[0].shape[1]], pa.int32())], ["dims"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "dims int").first()["dims"]


def embedded(rows: DataFrame, text: str, name: str, open_model: Callable[[], VectorModel], batch: int = BATCH, dims: int | None = None) -> DataFrame:
    """rows with an embedding column (array<float>) of the column text; one that is there gives way. Null text counts as empty."""
    rows = rows.drop("embedding")
    dims = probed_dims(rows.sparkSession, name, open_model) if dims is None else dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(name, open_model)
        for b in batches:
            at = b.schema.get_field_index(text)
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                x = pooled(model, [t or "" for t in part.column(at).to_pylist()], dims)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dims, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "embedding"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", embedding array<float>")
