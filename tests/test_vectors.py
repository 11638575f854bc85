import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import quantised, retrieval

FOLDER = "/root/testdata/sf0.1"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


def test_queries_of_each_length_meet_their_own(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 1.0, 1.0]), (5, None), (6, []), (7, [None, 1.0])], "id long, vector array<double>")
    got = sorted((r.query_id, r.doc_id, r.sim) for r in retrieval.knn(rows, rows, 5).collect())
    assert got == [(1, 1, 1.0), (1, 2, 0.6), (2, 1, 0.6), (2, 2, 1.0), (3, 3, 1.0), (3, 4, 1.0), (4, 3, 1.0), (4, 4, 3.0)]


def test_likeness_is_that_of_the_decoded_vectors(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(300, 12))
    model = quantised.fit(frame(spark, x), cells=5, parts=4, codewords=8)
    quantised.build(frame(spark, x), f"{tmp_path}/index", model)
    index = quantised.opened(spark, f"{tmp_path}/index")
    assert np.array_equal(index.model.centres, model.centres) and np.array_equal(index.model.codebooks, model.codebooks)
    codes = {r.id: (r.cell, list(r.code)) for r in index.codes.collect()}
    assert sorted(codes) == list(range(300)) == sorted(r.id for r in index.vectors.collect())
    decoded = np.array([model.centres[codes[i][0]] + np.concatenate([model.codebooks[m, c] for m, c in enumerate(codes[i][1])]) for i in range(300)])
    assert ((decoded - x) ** 2).sum() < 0.6 * (x**2).sum()
    found = quantised.shortlist(index, frame(spark, x[:3]), 300, probes=5, rows=40, asked=2).collect()
    assert len(found) == 900
    for r in found:
        assert r.likeness == pytest.approx(decoded[r.doc_id] @ x[r.query_id], abs=1e-9)


def test_a_full_short_list_is_exact(spark, tmp_path):
    x = np.round(np.random.default_rng(2).normal(size=(200, 8)), 1)
    x[50:90] = x[7]  # one vector with a fifth of all rows
    rows = frame(spark, x)
    quantised.build(rows, f"{tmp_path}/index", cells=4, parts=2, codewords=4, rows=10)
    index = quantised.opened(spark, f"{tmp_path}/index")
    plain = lambda d: sorted((r.query_id, r.doc_id, r.sim, r["rank"]) for r in d.collect())
    assert plain(quantised.search(index, rows.limit(9), 6, short=200, probes=4)) == plain(retrieval.knn(rows, rows.limit(9), 6))


def test_broken_vectors(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, None]), ("e", [0.0, 1.0])], "id string, vector array<double>")
    quantised.build(rows, f"{tmp_path}/index", cells=9, parts=1, codewords=9)
    index = quantised.opened(spark, f"{tmp_path}/index")
    assert sorted(r.id for r in index.vectors.collect()) == ["a", "e"]
    assert quantised.search(index, rows.filter("id = 'a'"), 1).first().doc_id == "a"
    for bad in ("b", "c"):
        with pytest.raises(ValueError):
            quantised.search(index, rows.filter(F.col("id") == bad), 1)
    with pytest.raises(ValueError):
        quantised.search(index, spark.createDataFrame([("z", [1.0])], "id string, vector array<double>"), 1)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", FOLDER, "/root/testdata/check_s"])
def test_recall(spark, tmp_path, folder):
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    quantised.build(rows, f"{tmp_path}/index")
    index = quantised.opened(spark, f"{tmp_path}/index")
    asked = rows.filter("id % 20 = 0")
    pairs = lambda d: {(r.query_id, r.doc_id) for r in d.collect()}
    true = pairs(retrieval.knn(rows, asked, 10))
    found = pairs(quantised.search(index, asked, 10))
    n = rows.count()
    print(folder, n, "recall", len(true & found) / len(true), "vectors read for a query", min(100, n // 8) / n)
    assert len(true & found) / len(true) >= 0.9 and min(100, n // 8) <= n / 8
