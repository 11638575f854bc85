"""Strategies against each other: games by query, Bradley-Terry ratings, successive halving.

Two strategies play a game on each query: the one with the better value wins, equal values are half a win for both.
Ratings are the maximum of the Bradley-Terry likelihood, climbed by minorise-maximise steps that are joins and sums over
the table of games, so players may be many. In a halving all strategies play on few queries, the better half of them on
twice as many, and so on until one is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.evaluation import metrics
from lodestone.operators.retrieval import Index, top_k, weighed
from lodestone.session import kept, stored


def grid_scores(index: Index, queries: DataFrame, grid: dict[str, tuple[float, float]]) -> DataFrame:
    """query_id, strategy, doc_id, score by BM25 with each (k1, b) of the grid: all in one pass over the postings, which
    stay where they are, as in bm25()."""
    part = lambda k1, b: F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    sums = [F.round(F.sum(part(k1, b)), 6).alias(f"s{i}") for i, (k1, b) in enumerate(grid.values())]
    rows = index.tf.join(F.broadcast(weighed(index, queries)), "term").groupBy("query_id", F.col("id").alias("doc_id")).agg(*sums)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("strategy"), F.col(f"s{i}").alias("score")) for i, name in enumerate(grid))))
    return rows.select("query_id", "doc_id", each.alias("s")).select("query_id", "s.strategy", "doc_id", "s.score")


def records(scores: DataFrame, qrels: DataFrame, k: int = 10, metric: str = "ndcg", strategies: list[str] | None = None) -> DataFrame:
    """run_id (the strategy), item_id, metric, value for each judged query (qrels: query_id, doc_id) and strategy. Of the
    scores only the k best of each are kept, and those of judged queries alone are ranked. Unless the strategies are
    named, all scores are made a second time to find them."""
    both = F.struct("query_id", "strategy").alias("query_id")
    judged_only = scores.join(F.broadcast(qrels.select("query_id").distinct()), "query_id", "left_semi")
    ranked = kept(top_k(judged_only.select(both, "doc_id", "score"), k))
    players = scores.select("strategy").distinct() if strategies is None else scores.sparkSession.createDataFrame([(s,) for s in strategies], "strategy string")
    judged = qrels.crossJoin(F.broadcast(players)).select(both, "doc_id")  # as many strategies as the grid has
    found = metrics(ranked, judged, k)
    return found.select(F.col("query_id.strategy").alias("run_id"), F.col("query_id.query_id").alias("item_id"), F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"))


def games(values: DataFrame) -> DataFrame:
    """a, b, wins (of a, halves for equal values), n of each pair of players a < b that met, of values (run_id, item_id,
    value)."""
    of_item = values.filter("value IS NOT NULL").groupBy("item_id").agg(F.collect_list(F.struct("run_id", "value")).alias("runs"))
    a = of_item.select("runs", F.explode("runs").alias("a"))
    met = a.select("a", F.explode(F.filter("runs", lambda r: r["run_id"] > F.col("a.run_id"))).alias("b"))
    win = F.when(F.col("a.value") > F.col("b.value"), 1.0).when(F.col("a.value") == F.col("b.value"), 0.5).otherwise(0.0)
    return met.groupBy(F.col("a.run_id").alias("a"), F.col("b.run_id").alias("b")).agg(F.sum(win).alias("wins"), F.count(F.lit(1)).alias("n"))


def ratings(played: DataFrame, prior: float = 0.5, turns: int = 200, over: float = 1.5, close: float = 1e-6) -> DataFrame:
    """player, rating (natural logarithm, 0 in the mean) of games(). Each pair that met gets `prior` more wins on both
    sides, so that a player who never won has a rating too. Steps are taken `over` times as far as the bound they rest
    on says, which brings them to the same end sooner, until none changes a rating by more than `close`."""
    sides = [played.select(F.col(x).alias("player"), F.col(y).alias("other"), wins.alias("wins"), (F.col("n") + 2 * prior).alias("n")) for x, y, wins in (("a", "b", F.col("wins") + prior), ("b", "a", F.col("n") - F.col("wins") + prior))]
    both = stored(sides[0].unionByName(sides[1]))
    now = stored(both.groupBy("player").agg(F.sum("wins").alias("won")).withColumn("rating", F.lit(0.0)))
    for _ in range(turns):
        other = now.select(F.col("player").alias("other"), F.col("rating").alias("other_rating"))
        met = both.join(now, "player").join(other, "other")
        made = met.groupBy("player", "won", "rating").agg(F.sum(F.col("n") / (F.exp("rating") + F.exp("other_rating"))).alias("share"))
        step = over * (F.log(F.col("won") / F.col("share")) - F.col("rating"))
        then = stored(made.select("player", "won", (F.col("rating") + step).alias("rating"), F.abs(step).alias("moved")))
        far = then.agg(F.max("moved")).first()[0]
        now = then.drop("moved")
        if far is None or far < close:
            break
    mean = now.agg(F.avg("rating")).first()[0] or 0.0
    return now.select("player", F.round(F.col("rating") - mean, 6).alias("rating"))


def halving(index: Index, queries: DataFrame, qrels: DataFrame, grid: dict[str, tuple[float, float]], share: float = 0.25, k: int = 10) -> DataFrame:
    """rung, strategy, queries, rating, stays: all strategies play on a `share` of the judged queries, by the md5 of
    their ids, the better half of them on twice as many, and so on until one stays. queries: query_id, term."""
    spark = queries.sparkSession
    order = Window.orderBy(F.md5(F.col("query_id").cast("string")), "query_id")
    judged = kept(qrels.select("query_id").distinct().withColumn("nth", F.row_number().over(order)))  # ids of judged queries only
    n = judged.count()
    rung, left, out = 0, dict(grid), []
    while left:
        size = min(n, max(1, round(n * share * 2**rung)))
        playing = judged.filter(F.col("nth") <= size).select("query_id")
        scores = grid_scores(index, queries.join(playing, "query_id", "left_semi"), left)
        found = ratings(games(records(scores, qrels.join(playing, "query_id", "left_semi"), k, strategies=list(left))))
        rated = {r["player"]: r["rating"] for r in found.collect()}  # a row a strategy
        best = sorted(left, key=lambda s: (-rated.get(s, 0.0), s))
        stay = best[: max(1, len(best) // 2)]
        out += [(rung, s, size, rated.get(s, 0.0), s in stay) for s in sorted(left)]
        left = {s: left[s] for s in stay} if len(stay) > 1 else {}
        rung += 1
    return spark.createDataFrame(out, "rung int, strategy string, queries long, rating double, stays boolean")
