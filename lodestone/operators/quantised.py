"""Vector search over product-quantised residuals in a stored coarse index.

A vector belongs to the cell of its nearest centre; what is left of it, its residual, is cut into parts, and each part
is stored as the number of its nearest codeword: `parts` bytes for a vector. A query looks its inner products with all
codewords up in one table, so the likeness to a stored vector is one product with its cell's centre and a sum of table
entries. The best `short` by that go on to the exact product; only their whole vectors are read.

    index/model            centres and codebooks, one row
    index/codes/cell=<c>   id, code
    index/vectors/cell=<c> id, vector

Centres and codewords are fitted on a bounded sample of vectors; every vector is indexed. A vector is left out that is
null, holds a null, or is of another length than the index; a query of another length raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.operators.retrieval import top_k


class Model(NamedTuple):
    centres: np.ndarray  # cells x length
    codebooks: np.ndarray  # parts x codewords x length of a part


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray, block: int = 8192) -> np.ndarray:
    own = (centres * centres).sum(1)
    return np.concatenate([(own - 2 * x[a : a + block] @ centres.T).argmin(1) for a in range(0, len(x), block)] or [np.zeros(0, int)])


def _means(x: np.ndarray, n: int, turns: int, seed: int) -> np.ndarray:
    """Centres of k-means; each that loses all its points stays where it was."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(turns):
        at = _nearest(x, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def _whole(vectors: DataFrame, length: int) -> DataFrame:
    return vectors.filter((F.size("vector") == length) & ~F.exists("vector", lambda x: x.isNull()))


def fit(vectors: DataFrame, cells: int = 64, parts: int = 16, codewords: int = 64, sample: int = 20_000, turns: int = 12, seed: int = 3) -> Model:
    """The model of vectors (id, vector), from at most `sample` of them by the hash of the id."""
    whole = vectors.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    some = whole.orderBy(F.xxhash64("id")).limit(sample).select("vector").toArrow().column("vector")
    lengths = {len(v) for v in some}
    if len(lengths) != 1:
        raise ValueError(f"vectors of one length are needed, these have {sorted(lengths)}")
    x = _matrix(some)
    if x.shape[1] % parts:
        raise ValueError(f"{parts} parts don't divide {x.shape[1]} numbers")
    centres = _means(x, cells, turns, seed)
    rest = x - centres[_nearest(x, centres)]
    books = [_means(part, codewords, turns, seed + 1 + m) for m, part in enumerate(np.split(rest, parts, axis=1))]
    return Model(centres, np.stack(books))


def _coded(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("vector"))
        cell = _nearest(x, model.centres)
        rest = np.split(x - model.centres[cell], len(model.codebooks), axis=1)
        codes = np.stack([_nearest(part, book) for part, book in zip(rest, model.codebooks, strict=True)], axis=1).astype(np.uint8)
        code = pa.array([c.tobytes() for c in codes], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id"), code, batch.column("vector")], ["cell", "id", "code", "vector"])


def build(vectors: DataFrame, folder: str, model: Model | None = None, rows: int = 1_000_000, **settings) -> None:
    """Writes the index of vectors (id, vector). A large cell is spread over a file for each `rows` rows or so."""
    model = model or fit(vectors, **settings)
    if model.codebooks.shape[1] > 256:
        raise ValueError("a codeword's number has to fit a byte")
    given = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    kinds = f"cell int, id {given.schema['id'].dataType.simpleString()}, code binary, vector array<double>"
    coded = _whole(given, model.centres.shape[1]).mapInArrow(partial(_coded, model=model), kinds)
    n = vectors.count()
    dealt = coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(1 + n // (rows * len(model.centres)))))
    dealt.select("cell", "id", "vector").write.partitionBy("cell").parquet(f"{folder}/vectors")
    spark = vectors.sparkSession
    # of what is written, so that a code and its vector can't come from two readings of the source
    back = spark.read.parquet(f"{folder}/vectors").select("id", "vector", "cell")
    back.mapInArrow(partial(_coded, model=model), kinds).select("cell", "id", "code").write.partitionBy("cell").parquet(f"{folder}/codes")
    row = (model.centres.tolist(), model.codebooks.tolist(), n)
    spark.createDataFrame([row], "centres array<array<double>>, codebooks array<array<array<double>>>, n long").coalesce(1).write.parquet(f"{folder}/model")


class Index(NamedTuple):
    model: Model
    codes: DataFrame  # cell, id, code
    vectors: DataFrame  # cell, id, vector
    n: int


def opened(spark: SparkSession, folder: str) -> Index:
    row = spark.read.parquet(f"{folder}/model").first()
    return Index(Model(np.array(row["centres"]), np.array(row["codebooks"])), spark.read.parquet(f"{folder}/codes"), spark.read.parquet(f"{folder}/vectors"), row["n"])


def _probing(batches: Iterator[pa.RecordBatch], model: Model, probes: int) -> Iterator[pa.RecordBatch]:
    """Each query with its nearest cells."""
    own = (model.centres * model.centres).sum(1)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("sought"))
        cells = np.argsort(own - 2 * x @ model.centres.T, axis=1, kind="stable")[:, :probes]
        rows = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), batch.column("query_id").take(rows), batch.column("sought").take(rows)], ["cell", "query_id", "sought"])


def _looked_up(model: Model, short: int, kinds: pa.Schema):
    """The best of a block of codes for each query of a block, by table lookups."""

    def run(codes: pa.Table, queries: pa.Table) -> pa.Table:
        if not codes.num_rows or not queries.num_rows:
            return kinds.empty_table()
        x = _matrix(queries.column("sought"))
        code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
        cell = codes.column("cell")[0].as_py()
        likeness = np.repeat((x @ model.centres[cell])[:, None], len(code), axis=1)
        for m, (part, book) in enumerate(zip(np.split(x, len(model.codebooks), axis=1), model.codebooks, strict=True)):
            likeness += (part @ book.T)[:, code[:, m]]
        most = min(short, len(code))
        best = np.argpartition(-likeness, most - 1, axis=1)[:, :most]
        asked = queries.column("query_id").take(pa.array(np.repeat(np.arange(len(x)), most)))
        ids = codes.column("id").take(pa.array(best.ravel()))
        cells = pa.array(np.full(best.size, cell), pa.int32())
        return pa.Table.from_arrays([asked, cells, ids, pa.array(np.take_along_axis(likeness, best, 1).ravel())], schema=kinds)

    return run


def shortlist(index: Index, queries: DataFrame, short: int, probes: int = 48, rows: int = 65_536, asked: int = 256) -> DataFrame:
    """query_id, cell, doc_id, likeness: the `short` best of each query (id, vector) in its nearest `probes` cells. Codes
    and queries of a cell meet in blocks of about `rows` and `asked`, each pair of blocks in one lookup."""
    length = index.model.centres.shape[1]
    given = queries.select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("sought"))
    wrong = given.filter(F.col("sought").isNull() | (F.size("sought") != length) | F.exists("sought", lambda x: x.isNull())).first()
    if wrong is not None:
        raise ValueError(f"query {wrong['query_id']!r} isn't a vector of {length} numbers")
    kind = given.schema["query_id"].dataType
    near = given.mapInArrow(partial(_probing, model=index.model, probes=probes), f"cell int, query_id {kind.simpleString()}, sought array<double>")
    blocks = lambda d, size, name: d.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))
    cells = blocks(index.codes, rows, "n_c").join(blocks(near, asked, "n_q"), "cell")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = index.codes.join(cells, "cell").select("cell", "id", "code", own("id", "n_c").alias("c"), other("n_q").alias("q"))
    right = near.join(cells, "cell").select(F.col("cell").alias("of"), "query_id", "sought", other("n_c").alias("at_c"), own("query_id", "n_q").alias("at_q"))
    kinds = T.StructType([T.StructField("query_id", kind), T.StructField("cell", T.IntegerType()), T.StructField("doc_id", index.codes.schema["id"].dataType), T.StructField("likeness", T.DoubleType())])
    found = left.groupBy("cell", "c", "q").cogroup(right.groupBy("of", "at_c", "at_q")).applyInArrow(_looked_up(index.model, short, to_arrow_schema(kinds)), kinds)
    return top_k(found, short, "likeness").drop("rank")


def search(index: Index, queries: DataFrame, k: int, short: int | None = None, probes: int = 48) -> DataFrame:
    """query_id, doc_id, sim, rank: the k best of a short list of `short` (10 * k, but no more than an eighth of all
    vectors, and at least k) by their exact inner product with each query (id, vector), rounded as in knn()."""
    short = short or max(k, min(10 * k, index.n // 8))
    listed = shortlist(index, queries, short, probes)
    asked = queries.select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("sought"))
    rows = listed.join(index.vectors.withColumnRenamed("id", "doc_id"), ["cell", "doc_id"]).join(asked, "query_id")
    sim = F.round(F.aggregate(F.zip_with("vector", "sought", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6)
    return top_k(rows.select("query_id", "doc_id", sim.alias("sim")), k, "sim")
