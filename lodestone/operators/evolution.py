"""Gaps, memory, strategies and rules: what the service learns from its own records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import listed, terms
from lodestone.operators.embedding import embed
from lodestone.operators.retrieval import Index, bm25, knn, top_k


def fill_gaps(open_gaps: DataFrame, outside: DataFrame) -> DataFrame:
    """query_id, top_sim, status, doc_id, score: the best outside hit of each gap; without one it stays open."""
    best = top_k(outside, 1).select("query_id", "doc_id", "score")
    rows = open_gaps.join(best, "query_id", "left")
    return rows.withColumn("status", F.when(F.col("doc_id").isNull(), "open").otherwise("filled"))


def memory(turns: DataFrame) -> DataFrame:
    """question, answer, hits, first_conv: each question with its most frequent answer (the first of equals), and in
    how many turns it was asked."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select("conv_id", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("then"), F.lead("text").over(w).alias("answer"))
    pairs = pairs.filter("role = 'user' and then = 'assistant'")
    answers = pairs.groupBy("question", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_conv"))
    best = Window.partitionBy("question").orderBy(F.col("n").desc(), "answer")
    asked = Window.partitionBy("question")
    rows = answers.withColumns({"hits": F.sum("n").over(asked), "first_conv": F.min("first_conv").over(asked), "k": F.row_number().over(best)})
    return rows.filter("k = 1").select("question", "answer", "hits", "first_conv")


def recall_memory(bank: DataFrame, queries: DataFrame, k: int = 3, least: float = 0.0, **options) -> DataFrame:
    """query_id, question, answer, sim, rank: what the memory (the result of memory()) holds for questions most like
    each query (query_id, text), by their embeddings."""
    keyed = bank.withColumn("key", F.md5("question"))
    found = knn(embed(keyed, "key", "question", **options), embed(queries, "query_id", **options), k).filter(F.col("sim") >= least)
    return found.join(keyed.select(F.col("key").alias("doc_id"), "question", "answer"), "doc_id").select("query_id", "question", "answer", "sim", "rank")


def strategy_grid(index: Index, queries: DataFrame, qrels: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """k1, b, mrr, champion: the mean reciprocal rank in the top 10 of each parameter pair over the judged queries."""
    n = qrels.select("query_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    runs = None
    for k1, b in grid:
        ranked = top_k(bm25(index, queries, k1, b), 10).join(qrels, ["query_id", "doc_id"]).groupBy("query_id").agg((1 / F.min("rank")).alias("rr"))
        run = ranked.agg(F.coalesce(F.sum("rr"), F.lit(0.0)).alias("total")).select(F.lit(k1).alias("k1"), F.lit(b).alias("b"), "total")
        runs = run if runs is None else runs.unionAll(run)
    scored = runs.crossJoin(F.broadcast(n)).select("k1", "b", F.round(F.col("total") / F.greatest("n", F.lit(1)), 6).alias("mrr"))
    first = F.row_number().over(Window.orderBy(F.col("mrr").desc(), "k1", "b"))  # as many rows as the grid
    return scored.withColumn("champion", first == 1)


def rule_support(docs: DataFrame, labels: DataFrame, least: int = 20) -> DataFrame:
    """rule_id, text, support, success, weight: each term of a labelled document, wherever it stands, is a rule; how many
    documents it holds in, and in which share of them the document is good. A rule's weight is its log odds with one
    added to each side. Documents meet their labels before their terms are listed, and counts are summed in each task
    before they move."""
    held = listed(docs.join(labels.select("doc_id", "quality"), "doc_id"), F.array_distinct(terms(F.col("text"))), "rule", "quality")
    rows = held.groupBy("rule").agg(F.count(F.lit(1)).alias("support"), F.sum("quality").cast("long").alias("good")).filter(F.col("support") >= least)
    return rows.select(
        F.md5("rule").alias("rule_id"),
        F.col("rule").alias("text"),
        "support",
        F.round(F.col("good") / F.col("support"), 6).alias("success"),
        F.round(F.log((F.col("good") + 1.0) / (F.col("support") - F.col("good") + 1.0)), 6).alias("weight"),
    )
