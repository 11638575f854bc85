import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import gate

FOLDER = "/root/testdata/sf0.01"


def test_scores_by_hand(spark):
    rows = [(i, t, c) for i, (t, c) in enumerate([("a a b", "x"), ("a c", "x"), ("d d", "y"), ("a d e", "y"), ("b", "x")] * 8)] + [(99, "a", None)]
    given = spark.createDataFrame(rows, "id long, text string, class string")
    made = gate.fit(given)
    taught = given.filter(F.col("class").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(5)) != 0)).collect()
    counts = {c: Counter(w for r in taught if r["class"] == c for w in r.text.split()) for c in "xy"}
    terms = {w for c in counts.values() for w in c}
    p = lambda w, c: math.log((counts[c][w] + 0.1) / (sum(counts[c].values()) + 0.1 * (len(terms) + 1)))
    prior = {c: math.log(sum(r["class"] == c for r in taught) / len(taught)) for c in "xy"}
    asked = {1: "a b", 2: "d d e", 3: "new words", 4: "", 5: None}
    found = {r.query_id: r for r in gate.judge(made, spark.createDataFrame(list(asked.items()), "query_id long, text string")).collect()}
    for q in (1, 2, 3):
        words = asked[q].split()
        score = {c: prior[c] + sum(p(w, c) for w in words) for c in "xy"}
        best = max("xy", key=lambda c: score[c])
        assert found[q]["class"] == best and found[q].margin == pytest.approx(abs(score["x"] - score["y"]) / len(words), abs=1e-6)
        assert found[q].fit == pytest.approx(sum(p(w, best) for w in words) / len(words), abs=1e-6)
    assert [found[q].why for q in (3, 4, 5)] == ["strange", "no terms", "no terms"] and not found[2].refused


def test_the_limit_reaches_the_wanted_share(spark):
    r = random.Random(3)
    word = lambda c: f"{c}{r.randrange(30)}" if r.random() < 0.2 else f"n{r.randrange(200)}"
    rows = [(i, " ".join(word(c) for _ in range(r.choice((2, 4, 30)))), c) for i in range(1500) for c in [r.choice("xyz")]]
    given = spark.createDataFrame(rows, "id long, text string, class string").repartition(3)
    fresh = [(i, " ".join(word(c) for _ in range(r.choice((2, 4, 30)))), c) for i in range(600) for c in [r.choice("xyz")]]
    made = gate.fit(given, right=0.97)
    found = {r_.query_id: r_ for r_ in gate.judge(made, spark.createDataFrame(fresh, "query_id long, text string, class string")).collect()}
    every = sum(found[i]["class"] == c for i, _, c in fresh) / 600
    taken = [(i, c) for i, _, c in fresh if not found[i].refused]
    share = sum(found[i]["class"] == c for i, c in taken) / len(taken)
    assert every < 0.9 < 0.93 <= share and len(taken) > 150
    again = gate.fit(given.repartition(7), right=0.97)
    assert (again.least_margin, again.least_fit) == (made.least_margin, made.least_fit)


def held_out(spark, folder):
    """Accuracy of accepted held-out documents, refusal rate of these, and of texts of another domain."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.col("lang").alias("class"))
    apart = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    made = gate.fit(docs.filter(~apart), row_id="doc_id")
    found = gate.judge(made, docs.filter(apart), "doc_id").join(docs.select("doc_id", F.col("class").alias("true")), "doc_id")
    row = found.agg(F.avg((~F.col("refused")).cast("int")).alias("taken"), F.avg(F.when(~F.col("refused"), (F.col("class") == F.col("true")).cast("int"))).alias("right"), F.count(F.lit(1)).alias("n")).first()
    strange = docs.filter(apart).select(F.col("doc_id").alias("query_id"), F.translate(F.lower("text"), "aeioustnr", "kqxzjwvyp").alias("text"))
    other = gate.judge(made, strange).agg(F.avg(F.col("refused").cast("int"))).first()[0]
    return row.n, row.right, 1 - row.taken, other


def test_held_out_documents(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    n, right, refused, other = held_out(spark, FOLDER)
    assert n > 200 and right >= 0.95 and refused <= 0.1 and other >= 0.9
