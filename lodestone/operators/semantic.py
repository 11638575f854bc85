"""Embeddings learned from a collection: a truncated singular value decomposition of its tf-idf matrix.

The matrix has a row of unit length for each text and a column for each term of the vocabulary, the `most_terms` terms
that most texts hold. Its rows are made once and kept as sparse arrays. The range finder multiplies a random basis of
terms by the matrix and its transpose, power after power; each task adds up its rows' share, so one matrix of terms by
directions comes out of a task however many rows it has read. The small QR and eigenvalue problems of these directions
are solved in the driver. The vocabulary and the directions bound all that is sent: 50,000 terms by 80 directions are
32 MB. The embedding of a text is its row times the right singular vectors, of unit length; a text without known terms
has zeros.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import listed, terms
from lodestone.operators.embedding import _TERM
from lodestone.session import kept

ROWS = "at array<int>, weight array<double>"


class Vocabulary(NamedTuple):
    place: dict[str, int]
    idf: np.ndarray


class Model(NamedTuple):
    vocabulary: Vocabulary
    vectors: np.ndarray  # terms x dims: right singular vectors
    values: np.ndarray  # singular values, falling


def vocabulary(docs: DataFrame, most_terms: int = 50_000, text: str = "text") -> Vocabulary:
    """The terms that most texts hold, of equal ones the first in order, with ln((1 + n) / (1 + df)) + 1."""
    held = listed(docs, F.array_distinct(terms(F.col(text))), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = held.orderBy(F.col("df").desc(), "term").limit(most_terms).collect()
    n = docs.count()
    return Vocabulary({r["term"]: i for i, r in enumerate(found)}, np.array([math.log((1 + n) / (1 + r["df"])) + 1 for r in found]))


def weighted(text: str | None, words: Vocabulary) -> tuple[list[int], np.ndarray]:
    """Places and weights, (1 + ln tf) * idf at unit length, of the known terms of a text."""
    counts = Counter(p for p in map(words.place.get, _TERM.findall((text or "").lower())) if p is not None)
    at = sorted(counts)
    weight = np.array([1 + math.log(counts[p]) for p in at]) * words.idf[at] if at else np.zeros(0)
    length = math.sqrt(float(weight @ weight))
    return at, weight / length if length else weight


def _sparse(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [weighted(t, shared.value) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([at for at, _ in rows], pa.list_(pa.int32())), pa.array([w for _, w in rows], pa.list_(pa.float64()))], ["at", "weight"])


def matrix(docs: DataFrame, words: Vocabulary, text: str = "text") -> DataFrame:
    """at, weight: the rows of the tf-idf matrix, kept in the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    return kept(docs.select(text).mapInArrow(partial(_sparse, shared=shared), ROWS).filter(F.size("at") > 0))


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and weight of each entry of a batch of sparse rows."""
    at, weight = batch.column(0), batch.column(1)
    row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
    return row, at.flatten().to_numpy(), weight.flatten().to_numpy()


def _times(row: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """The n rows times the basis: n x directions."""
    return np.stack([np.bincount(row, weight * column[place], minlength=n) for column in basis.T], axis=1)


def _powered(batches: Iterator[pa.RecordBatch], shared, block: int) -> Iterator[pa.RecordBatch]:
    """The transpose times (the rows times the basis), summed over a task, in blocks of terms."""
    basis = shared.value
    total = np.zeros(basis.shape)
    for batch in batches:
        if batch.num_rows:
            row, place, weight = _entries(batch)
            made = _times(row, place, weight, batch.num_rows, basis)
            for j in range(basis.shape[1]):
                total[:, j] += np.bincount(place, weight * made[row, j], minlength=len(basis))
    parts = range(0, len(basis), block)
    yield pa.RecordBatch.from_arrays([pa.array([a // block for a in parts], pa.int32()), pa.array([total[a : a + block].tobytes() for a in parts], pa.binary())], ["part", "sums"])


def _gram(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The products of the directions with each other, over the rows of a task."""
    basis = shared.value
    total = np.zeros((basis.shape[1], basis.shape[1]))
    for batch in batches:
        if batch.num_rows:
            made = _times(*_entries(batch), batch.num_rows, basis)
            total += made.T @ made
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.float64) for b in table.column("sums").to_pylist())
    return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _summed(rows: DataFrame, run: Callable, basis: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of what run() yields, a block of terms a group."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    sums = rows.mapInArrow(partial(run, shared=shared), "part int, sums binary")
    found = sums.groupBy("part").applyInArrow(_added, "part int, sums binary").collect()
    shared.unpersist()
    return np.frombuffer(b"".join(bytes(r["sums"]) for r in sorted(found, key=lambda r: r["part"])), np.float64).reshape(shape)


def decompose(rows: DataFrame, n_terms: int, dims: int = 64, more: int = 16, powers: int = 4, seed: int = 3, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The `dims` first right singular vectors (n_terms x dims) and singular values of sparse rows (at, weight), from
    dims + more directions and so many powers; fewer if the vocabulary has fewer terms. Tasks of one read are joined into
    four for each core, so that sums, not rows, decide what moves."""
    directions = min(dims + more, n_terms)
    basis = np.random.default_rng(seed).normal(size=(n_terms, directions))
    rows = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)
    for _ in range(powers):
        basis = np.linalg.qr(_summed(rows, partial(_powered, block=block), np.linalg.qr(basis)[0], basis.shape))[0]
    squares, turned = np.linalg.eigh(_summed(rows, _gram, basis, (directions, directions)))
    first = np.argsort(-squares)[:dims]
    vectors = basis @ turned[:, first]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * signs, np.sqrt(np.maximum(squares[first], 0))


def fit(docs: DataFrame, dims: int = 64, most_terms: int = 50_000, text: str = "text", **settings) -> Model:
    """The model of all texts of docs."""
    words = vocabulary(docs, most_terms, text)
    if not words.place:
        return Model(words, np.zeros((0, dims)), np.zeros(dims))
    vectors, values = decompose(matrix(docs, words, text), len(words.place), dims, **settings)
    return Model(words, vectors, values)


class SemanticEmbedder:
    """An embedder of a model: texts -> a matrix with a row of unit length, or zeros, for each."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.model.vectors.shape[1]))
        for i, text in enumerate(texts):
            at, weight = weighted(text, self.model.vocabulary)
            if at:
                out[i] = weight @ self.model.vectors[at]
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)


def _from_broadcast(shared) -> SemanticEmbedder:
    return SemanticEmbedder(shared.value)


def factory(spark: SparkSession, model: Model) -> Callable[[], SemanticEmbedder]:
    """What embed(), local_search() and rebuild_vectors() take: the model goes to each executor once."""
    return partial(_from_broadcast, spark.sparkContext.broadcast(model))


def save(spark: SparkSession, model: Model, folder: str) -> None:
    """The model as tables: terms (place, term, idf, vector) and values."""
    rows = [(i, term, float(model.vocabulary.idf[i]), model.vectors[i].tolist()) for term, i in model.vocabulary.place.items()]
    spark.createDataFrame(rows, "place int, term string, idf double, vector array<double>").write.parquet(f"{folder}/terms")
    spark.createDataFrame([(model.values.tolist(),)], "singular array<double>").write.parquet(f"{folder}/values")


def load(spark: SparkSession, folder: str) -> Model:
    rows = spark.read.parquet(f"{folder}/terms").orderBy("place").collect()
    words = Vocabulary({r["term"]: r["place"] for r in rows}, np.array([r["idf"] for r in rows]))
    return Model(words, np.array([r["vector"] for r in rows]), np.array(spark.read.parquet(f"{folder}/values").first()["singular"]))
