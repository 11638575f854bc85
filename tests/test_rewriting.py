import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval, rewriting


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_all_words_within_the_edits_are_found(spark, most):
    r = random.Random(2)
    made = {"".join(r.choice("abc高é") for _ in range(r.randrange(1, 8))) for _ in range(400)} | {"x" * 40, "x" * 39 + "y"}
    words, asked = sorted(made), sorted(made)[::7] + ["zzzz", "x" * 41, "a"]
    index = rewriting.spelling_index(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, df long"), most)
    got = {(r.word, r.term, r.edits) for r in rewriting.within(index, spark.createDataFrame([(w,) for w in asked], "word string"), most).collect()}
    assert got == {(a, w, d) for a in asked for w in words if (d := distance(a, w)) <= most}


def test_deletions_by_hand(spark):
    row = spark.range(1).select(F.sort_array(rewriting.deletions(F.lit("aab"), 2)).alias("two"), rewriting.deletions(F.lit(""), 2).alias("none")).first()
    assert row.two == ["a", "aa", "aab", "ab", "b"] and row.none == [""]


def test_corrections(spark):
    df = spark.createDataFrame([("pressure", 9), ("pleasure", 2), ("salt", 5), ("malt", 5)], "term string, df long")
    queries = spark.createDataFrame([(1, "presure"), (1, "salt"), (2, "xalt"), (2, "qqqqqq"), (3, "xal")], "query_id long, term string")
    got = {(r.query_id, r.given): r.term for r in rewriting.corrected(queries, df, rewriting.spelling_index(df)).collect()}
    assert got == {(1, "presure"): "pressure", (1, "salt"): "salt", (2, "xalt"): "malt", (2, "qqqqqq"): "qqqqqq", (3, "xal"): "xal"}


def test_feedback_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c c c"), (3, "d")], "doc_id long, text string")
    index = retrieval.build_index(docs)
    queries = spark.createDataFrame([(7, "a"), (8, "unknown")], "query_id long, term string")
    hits = spark.createDataFrame([(7, 1, 3.0), (7, 2, 1.0)], "query_id long, doc_id long, score double")
    got = {(r.query_id, r.term): r.weight for r in rewriting.feedback(index, queries, hits, n_terms=2).collect()}
    a, b = 0.75 / 2 + 0.25 / 4, 0.75 / 2
    assert got == {(7, "a"): round(0.5 + 0.5 * a / (a + b), 6), (7, "b"): round(0.5 * b / (a + b), 6), (8, "unknown"): 1.0}
    found = {r.doc_id: r.score for r in retrieval.bm25(index, rewriting.feedback(index, queries, hits)).collect()}
    assert set(found) == {1, 2}
