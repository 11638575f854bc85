"""Query rewriting from the collection itself: feedback of the best documents, and spelling.

Feedback takes a query's best documents for relevant ones: a term weighs as much as its share of their texts, each text
weighted by its score (a relevance model), mixed with the query's own terms.

Spelling goes by symmetric deletions: two words within `most` edits have a string in common that each becomes by at most
`most` deletions. So the words of the collection are listed under all their deletions once, as a table to be stored, and
an unknown word meets only those that share one with it; their distance is then computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import counted, listed
from lodestone.operators.retrieval import Index, top_k
from lodestone.session import kept


def feedback(index: Index, queries: DataFrame, hits: DataFrame, n_terms: int = 20, own: float = 0.5) -> DataFrame:
    """query_id, term, weight: the queries' terms (query_id, term) and the `n_terms` that weigh most in their hits
    (query_id, doc_id, score), weights adding up to 1. A query without hits, or whose hits all score 0, keeps its own.

    Hits and the terms that weigh most are few and read several times, so they are kept: the search runs once. The texts
    of other documents go before they are cut into terms."""
    of_query = Window.partitionBy("query_id")
    shares = hits.select("query_id", F.col("doc_id").alias("id"), F.try_divide("score", F.sum("score").over(of_query)).alias("share")).filter("share > 0")
    shares = kept(shares)
    rows = index.rows.join(F.broadcast(shares.select("id").distinct()), "id", "left_semi")  # the texts stay where they are
    held = listed(rows, counted(F.col("terms")), "c", "id", "dl").select("id", "dl", "c.term", "c.tf").join(F.broadcast(shares), "id")
    weights = held.groupBy("query_id", "term").agg(F.round(F.sum(F.col("share") * F.col("tf") / F.col("dl")), 9).alias("weight"))
    best = top_k(weights, n_terms, "weight", "term")
    best = kept(best.withColumn("weight", F.col("weight") / F.sum("weight").over(of_query)))
    asked = queries.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(of_query))
    fed = best.select("query_id").distinct().withColumn("fed", F.lit(1))
    asked = asked.join(fed, "query_id", "left").select("query_id", "term", (F.col("weight") * F.when(F.col("fed") == 1, own).otherwise(1.0)).alias("weight"))
    both = asked.unionByName(best.select("query_id", "term", ((1 - own) * F.col("weight")).alias("weight")))
    return both.groupBy("query_id", "term").agg(F.round(F.sum("weight"), 6).alias("weight"))


def deletions(word: Column, most: int) -> Column:
    """The word and all it becomes by up to `most` deletions of a character, each once."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    found = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda w: F.when(F.length(w) > 0, less(w)).otherwise(F.array().cast("array<string>")))))
        found = F.array_union(found, last)
    return found


def spelling_index(words: DataFrame, most: int = 2) -> DataFrame:
    """deleted, term, df of words (term, df): the table to store."""
    return listed(words, deletions(F.col("term"), most), "deleted", "term", "df").select("deleted", "term", "df")


def within(index: DataFrame, asked: DataFrame, most: int = 2) -> DataFrame:
    """word, term, df, edits: for each of asked (word) every word of the index, made for as many edits or more, that is
    within `most` insertions, deletions and replacements."""
    wanted = listed(asked.select("word").distinct(), deletions(F.col("word"), most), "deleted", "word")
    pairs = index.join(wanted, "deleted").select("word", "term", "df").distinct()
    return pairs.withColumn("edits", F.levenshtein("word", "term")).filter(F.col("edits") <= most)


def corrected(queries: DataFrame, df: DataFrame, index: DataFrame, most: int = 2, least_length: int = 4) -> DataFrame:
    """query_id, term, given: the queries' terms (query_id, term), where those that no document holds (df: term, df) and
    that have `least_length` characters give way to the word that takes the fewest edits, then the most frequent, then
    the first. Without such a word they stay."""
    unknown = queries.select("term").distinct().join(df, "term", "left_anti").filter(F.length("term") >= least_length)
    found = within(index, unknown.select(F.col("term").alias("word")), most)
    best = found.groupBy("word").agg(F.min_by("term", F.struct("edits", -F.col("df"), "term")).alias("better"))
    rows = queries.join(best, queries["term"] == best["word"], "left")
    return rows.select("query_id", F.coalesce("better", "term").alias("term"), F.col("term").alias("given"))
