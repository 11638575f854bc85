"""Embeddings: the hook for a model, and a hashing embedder that needs none."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: texts -> a matrix with a row for each; made once in each task by a factory, so that a model is loaded there.
Embedder = Callable[[list[str]], np.ndarray]

#: As functions.text.TERM: one Han character, or a run of other letters and digits.
_HAN = "\u2e80-\u2fdf\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_TERM = re.compile(f"[{_HAN}]|[^\\W_{_HAN}]+")


class HashingEmbedder:
    """Counts of terms, each in a dimension and with a sign that its md5 digest says; of unit length unless zero."""

    def __init__(self, dims: int = 64):
        self.dims = dims
        self.places: dict[str, tuple[int, int]] = {}

    def place(self, term: str) -> tuple[int, int]:
        found = self.places.get(term)
        if found is None:
            if len(self.places) > 200_000:
                self.places.clear()
            digest = hashlib.md5(term.encode("utf-8", "surrogatepass")).hexdigest()
            found = self.places[term] = int(digest[:8], 16) % self.dims, 1 - 2 * (int(digest[8], 16) % 2)
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            for term in _TERM.findall(text.lower()):
                at, sign = self.place(term)
                row[at] += sign
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)


def _embedded(batches: Iterator[pa.RecordBatch], factory: Callable[[], Embedder], most: int) -> Iterator[pa.RecordBatch]:
    embedder = factory()
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            vectors = np.asarray(embedder([t or "" for t in part.column(1).to_pylist()]), np.float64)
            offsets = pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], ["id", "vector"])


def embed(rows: DataFrame, id_col: str, text_col: str = "text", factory: Callable[[], Embedder] = HashingEmbedder, batch: int = 256) -> DataFrame:
    """id, vector of each row; a null text is embedded as an empty one. Texts go to the embedder `batch` at a time, in
    the task that reads them: nothing is shuffled."""
    given = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(partial(_embedded, factory=factory, most=batch), f"id {given.schema['id'].dataType.simpleString()}, vector array<double>")
