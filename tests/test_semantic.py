import os
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import agent, embedding, semantic

FOLDER = "/root/testdata/sf0.001"


def dense(spark, docs, words):
    out = np.zeros((docs.count(), len(words.place)))
    for i, r in enumerate(docs.collect()):
        at, weight = semantic.weighted(r.text, words)
        out[i, at] = weight
    return out


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_singular_values_equal_a_dense_decomposition(spark, docs):
    words = semantic.vocabulary(docs, 3000)
    assert len(words.place) == 3000
    a = dense(spark, docs, words)
    _, true, right = np.linalg.svd(a, full_matrices=False)
    vectors, values = semantic.decompose(semantic.matrix(docs.repartition(3), words), 3000, dims=12, more=28, powers=12)
    assert np.allclose(values[:4], true[:4], rtol=1e-9) and np.allclose(values, true[:12], rtol=1e-3)
    assert np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-9)
    for j in range(4):  # the first ones are apart enough to be compared one by one
        assert abs(abs(vectors[:, j] @ right[j]) - 1) < 1e-4
    # however the rows are cut
    again, same = semantic.decompose(semantic.matrix(docs.repartition(7), words), 3000, dims=12, more=28, powers=12)
    assert np.allclose(values, same, rtol=1e-6) and np.allclose(again[:, :4], vectors[:, :4], atol=1e-6)


def test_vocabulary_and_rows_by_hand(spark):
    rows = spark.createDataFrame([("b a a",), ("B c",), (None,), ("",)], "text string")
    words = semantic.vocabulary(rows, 2)
    assert words.place == {"b": 0, "a": 1} and np.allclose(words.idf, [np.log(5 / 3) + 1, np.log(5 / 2) + 1])
    at, weight = semantic.weighted("a c a b", words)
    want = np.array([words.idf[0], (1 + np.log(2)) * words.idf[1]])
    assert at == [0, 1] and np.allclose(weight, want / np.linalg.norm(want))


def test_few_texts_and_none(spark):
    model = semantic.fit(spark.createDataFrame([("x y",), ("x",)], "text string"), dims=8)
    assert model.vectors.shape == (2, 2)
    made = semantic.SemanticEmbedder(model)(["x", "", "unknown", "x y y"])
    assert np.allclose(np.linalg.norm(made, axis=1), [1, 0, 0, 1])
    none = semantic.fit(spark.createDataFrame([], "text string"), dims=4)
    assert semantic.SemanticEmbedder(none)(["x"]).tolist() == [[0.0] * 4]


def test_saved_models_embed_alike_and_serve_the_agent(spark, docs, tmp_path):
    model = semantic.fit(docs, dims=16, powers=2)
    semantic.save(spark, model, f"{tmp_path}/model")
    back = semantic.load(spark, f"{tmp_path}/model")
    assert np.allclose(back.vectors, model.vectors) and np.allclose(back.values, model.values)
    given = semantic.factory(spark, back)
    made = {r.id: np.array(r.vector) for r in embedding.embed(docs, "doc_id", factory=given).collect()}
    a = dense(spark, docs, model.vocabulary) @ model.vectors
    for r, row in zip(docs.collect(), a):
        length = np.linalg.norm(row)
        assert np.allclose(made[r.doc_id], row / length if length else row)
    asked = spark.read.parquet(f"{FOLDER}/benchmark.parquet").limit(5).withColumnRenamed("item_id", "query_id")
    outside = spark.createDataFrame([(1, "nothing")], "doc_id long, text string")
    tools = agent.TOOLS | {"local_search": partial(agent.local_search, factory=given)}
    assert agent.answer(asked, docs, outside, tools=tools).count() == 5


def test_passages_find_their_documents(spark, docs):
    """A passage's own documents are among the ten nearest more often by learned than by hashed embeddings."""
    from lodestone.operators.retrieval import knn

    asked = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    true = docs.crossJoin(F.broadcast(asked.withColumnRenamed("text", "passage"))).filter("contains(text, passage)").select("item_id", "doc_id").collect()
    found = {}
    for name, given in {"learned": semantic.factory(spark, semantic.fit(docs, dims=64)), "hashed": embedding.HashingEmbedder}.items():
        hits = {(r.query_id, r.doc_id) for r in knn(embedding.embed(docs, "doc_id", factory=given), embedding.embed(asked, "item_id", factory=given), 10).collect()}
        found[name] = sum((r.item_id, r.doc_id) in hits for r in true)
    assert found["learned"] >= found["hashed"] and found["learned"] >= 1
