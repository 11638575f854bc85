import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import embedding, evaluation, retrieval


def test_chinese_terms_are_single_characters(spark):
    rows = spark.createDataFrame([(1, "高血压 stage 2"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.term for r in retrieval.tokenize(rows, "doc_id").collect()] == ["高", "血", "压", "stage", "2"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c c c d")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "a c a")], "q long, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(retrieval.build_index(docs), retrieval.query_terms(queries, "q")).collect()}

    def part(df, tf, dl):
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 3))

    assert got == {1: round(part(1, 2, 3), 6), 2: round(part(2, 1, 2), 6), 3: round(part(2, 3, 4), 6)}


def test_chunks_restore_the_text(spark):
    texts = ["", "a", "abcdefghij" * 7, "é漢" * 33, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size, overlap in ((10, 0), (10, 3), (7, 6)):
        got: dict[int, list] = {}
        for r in retrieval.chunk(docs, size, overlap).orderBy("doc_id", "chunk_no").collect():
            got.setdefault(r.doc_id, []).append(r.text)
        for i, t in enumerate(texts):
            pieces = got.get(i, [])
            assert "".join(p if k == 0 else p[overlap:] for k, p in enumerate(pieces)) == (t or "")


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    got = retrieval.knn(rows, rows.filter("id % 20 = 0"), 4, rows=16, asked=2).collect()
    for q in (0, 20, 40):
        sims = np.round(v @ v[q], 6)
        want = sorted(range(60), key=lambda i: (-sims[i], i))[:4]
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_knn_leaves_out_broken_vectors_and_takes_string_ids(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [0.6, 0.8]), ("e", [None, 1.0])], "id string, vector array<double>")
    got = retrieval.knn(rows, rows.filter("id in ('a', 'b')"), 3).collect()
    assert sorted((r.query_id, r.doc_id, r.sim) for r in got) == [("a", "a", 1.0), ("a", "d", 0.6)]


def test_passages_as_they_stand(spark):
    texts = {1: "xa bc de fg", 2: "one two three four five six seven eight\nnine", 3: "short", 4: "", 5: None, 6: "a b  c d"}
    asked = {1: "a bc d", 2: "two three four five six", 3: "two three four five six seven", 4: "hor", 5: "eight\nni", 6: "", 7: None, 8: "b  c", 9: "o two three four five six seven eight\nn", 10: "s", 11: "a b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    passages = spark.createDataFrame(list(asked.items()), "item_id int, text string")
    want = {(q, d) for q, p in asked.items() for d, t in texts.items() if p and t and p in t}
    assert {tuple(r) for r in evaluation.passages_in(docs, passages).collect()} == want
    assert evaluation.passages_in(docs, passages.limit(0)).count() == 0


def test_embedder_is_a_hook(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, text string")
    lengths = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    assert {r.id: r.vector for r in embedding.embed(rows, "id", factory=lengths, batch=2).collect()} == {1: [2, 1], 2: [0, 1], 3: [0, 1]}


def test_cells_find_nine_of_ten(spark):
    folder = "/root/testdata/sf0.01"
    from lodestone.plans import QUERIES

    exact = {(r.query_id, r.doc_id) for r in QUERIES["knn_exact"](spark, folder).filter("rank <= 9").collect()}
    found = {(r.query_id, r.doc_id) for r in QUERIES["knn_cells"](spark, folder).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_fusion_of_a_single_candidate_and_missing_sides(spark):
    text = spark.createDataFrame([(1, 5, 3.0, 1), (2, 5, 3.0, 1), (2, 6, 1.0, 2)], "query_id long, doc_id long, score double, rank int")
    sims = spark.createDataFrame([(2, 6, 0.9, 1), (2, 7, 0.5, 2)], "query_id long, doc_id long, sim double, rank int")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.fuse(text, sims).collect()}
    assert got == {(1, 5): 0.5, (2, 5): 0.5, (2, 6): 0.5, (2, 7): 0.0}


def test_gap_threshold_is_strict(spark):
    sims = spark.createDataFrame([(1, 0.69), (1, 0.2), (2, 0.70), (3, 0.71)], "query_id int, sim double")
    assert [tuple(r) for r in retrieval.gaps(sims).collect()] == [(1, 0.69)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6, unique=True), st.sets(st.integers(1, 12), min_size=1))
def test_metrics_lie_between_0_and_1(spark, ranking, relevant):
    ranked = spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(ranking)], "query_id int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, d) for d in relevant], "query_id int, doc_id int")
    r = evaluation.metrics(ranked, qrels, 5).first()
    hits = [k + 1 for k, d in enumerate(ranking[:5]) if d in relevant]
    assert r.recall == round(len(hits) / len(relevant), 6) and r.hit == int(bool(hits))
    assert r.rr == (round(1 / hits[0], 6) if hits else 0.0) and 0 <= r.ndcg <= 1
