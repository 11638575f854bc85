import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval, selfplay, significance


def records(spark, runs):
    rows = [(run, i, "m", None if v is None else float(v)) for run, values in runs.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, item_id long, metric string, value double")


def plain(rows):
    return {(r.run_a, r.run_b): r for r in rows.collect()}


def test_reruns_and_partitions_agree(spark):
    r = np.random.default_rng(1)
    given = records(spark, {"a": r.normal(size=80), "b": r.normal(size=80) + 0.1, "c": r.normal(size=80)})
    want = plain(significance.compare(given, 200))
    for parts in (1, 6):
        assert plain(significance.compare(given.repartition(parts), 200)) == want
    other = plain(significance.compare(given, 200, seed=8))
    assert any(other[k].p != want[k].p for k in want)


def test_intervals_hold_a_known_truth(spark):
    """Of 40 comparisons whose true difference is 0.3, about 95 in 100 intervals hold it."""
    r = np.random.default_rng(2)
    rows = [(f"{g}{run}", i, f"m{g}", float(r.normal() + 0.3 * (run == "b"))) for g in range(40) for run in "ab" for i in range(60)]
    found = significance.compare(spark.createDataFrame(rows, "run_id string, item_id long, metric string, value double"), 400).collect()
    assert len(found) == 40 and all(f.low <= f.difference <= f.high for f in found)
    assert sum(f.low <= 0.3 <= f.high for f in found) >= 34


def test_draws_are_poisson_and_signs_even(spark):
    rows = spark.range(300).select(F.col("id").alias("item_id"), F.lit("m").alias("metric"), F.lit("a").alias("run_a"), F.lit("b").alias("run_b"), F.lit(1).cast("long").alias("difference"))
    drawn = significance.replicates(rows, 300).toPandas()
    n = 300 * 300
    assert abs(drawn.weights.sum() - n) < 5 * np.sqrt(n) and abs(drawn.flipped.sum()) < 5 * np.sqrt(n)
    assert abs(drawn.weights.var() / 300 - 1) < 0.35  # of a Poisson sum the variance is its mean
    limits = significance.poisson_limits()
    assert abs(limits[0] / 2**32 - 0.36788) < 1e-4 and limits == sorted(limits)


def test_p_by_all_signs_and_holm_by_hand(spark):
    values = [0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.45, 0.55]
    got = plain(significance.compare(records(spark, {"a": [0.0] * 8, "b": values}), 2000))["a", "b"]
    exact = 2 / 2**8  # only all signs alike reach the sum
    assert abs(got.p - exact) < 0.006 and got.items == 8 and got.difference == pytest.approx(np.mean(values), abs=1e-6) and got.significant
    tests = spark.createDataFrame([("m", "a", "b", 0.01), ("m", "a", "c", 0.04), ("m", "b", "c", 0.03), ("n", "a", "b", 0.5)], "metric string, run_a string, run_b string, p double")
    assert sorted(r.p_holm for r in significance.holm(tests).collect()) == [0.04, 0.09, 0.09, 0.5]


def test_equal_missing_and_no_runs(spark):
    got = plain(significance.compare(records(spark, {"a": [1, 2, None, 4], "b": [1, 2, 3, None]}), 50))["a", "b"]
    assert (got["items"], got.difference, got.low, got.high, got.p, got.significant) == (2, 0.0, 0.0, 0.0, 1.0, False)
    assert significance.compare(records(spark, {"a": [1.0]}), 50).count() == 0


def dense_ratings(games, prior):
    """The same maximum by Newton steps on the logarithms."""
    players = sorted({p for g in games for p in g[:2]})
    at, x = {p: i for i, p in enumerate(players)}, np.zeros(len(players))
    for _ in range(200):
        gradient, curve = np.zeros(len(x)), np.zeros((len(x), len(x)))
        for a, b, wins, n in games:
            i, j, w, m = at[a], at[b], wins + prior, n + 2 * prior
            p = 1 / (1 + np.exp(x[j] - x[i]))
            gradient[i] += w - m * p
            gradient[j] -= w - m * p
            c = m * p * (1 - p)
            curve[[i, j], [i, j]] += c
            curve[i, j] -= c
            curve[j, i] -= c
        x = x + np.linalg.lstsq(curve, gradient, rcond=None)[0]
        x -= x.mean()
    return dict(zip(players, x))


def test_ratings_equal_a_dense_solution(spark):
    r = random.Random(3)
    games = [(a, b, r.randrange(0, 21) / 2, 10) for a in "abcdef" for b in "abcdef" if a < b and (a, b) not in (("a", "f"), ("b", "e"))]
    games[0] = ("a", "b", 0.0, 10)
    found = {g.player: g.rating for g in selfplay.ratings(spark.createDataFrame(games, "a string, b string, wins double, n long")).collect()}
    want = dense_ratings(games, 0.5)
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-4 for p in want)


def test_games_by_hand(spark):
    got = {(g.a, g.b): (g.wins, g.n) for g in selfplay.games(records(spark, {"a": [1, 1, 0, None], "b": [0, 1, 1, 1], "c": [None, None, None, 2]})).collect()}
    assert got == {("a", "b"): (1.5, 3), ("b", "c"): (0.0, 1)}


def test_halving_keeps_the_better_half(spark):
    r = random.Random(6)
    texts = {i: " ".join(r.choice("abcdefgh") for _ in range(r.choice((3, 60)))) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    # short texts are the relevant ones, so that strategies which mind the length win
    short = [i for i, t in texts.items() if len(t) < 10]
    queries = spark.createDataFrame([(q, texts[d]) for q, d in enumerate(short[:16])], "q long, text string")
    qrels = spark.createDataFrame([(q, d) for q, d in enumerate(short[:16])], "query_id long, doc_id long")
    grid = {"minds": (1.2, 0.9), "some": (1.2, 0.5), "little": (1.2, 0.1), "not": (1.2, 0.0)}
    found = selfplay.halving(retrieval.build_index(docs), retrieval.query_terms(queries, "q"), qrels, grid).collect()
    assert [(f.rung, f.queries) for f in found] == [(0, 4)] * 4 + [(1, 8)] * 2
    assert {f.strategy for f in found if f.rung == 0 and f.stays} == {f.strategy for f in found if f.rung == 1}
    assert sum(f.stays for f in found if f.rung == 1) == 1
