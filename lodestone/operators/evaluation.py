"""Evaluation of rankings, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import listed
from lodestone.operators.retrieval import bm25, build_index, query_terms, top_k


def sample(items: DataFrame, n: int, id_col: str) -> DataFrame:
    """n items by the md5 of their id: the same ones each time, without a seed."""
    return items.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(n)


def metrics(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, n_relevant, recall, precision, hit, rr, ndcg at k, with binary gain, of each query in qrels
    (query_id, doc_id); ranked: query_id, doc_id, rank."""
    wanted = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = ranked.filter(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"]).groupBy("query_id")
    hits = hits.agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = wanted.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.select(
        "query_id",
        "n_relevant",
        F.round(F.col("hits") / F.col("n_relevant"), 6).alias("recall"),
        F.round(F.col("hits") / F.lit(k), 6).alias("precision"),
        (F.col("hits") > 0).cast("int").alias("hit"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
    )


def _runs(tokens: Column, size: int) -> Column:
    """Distinct hashes of the runs of so many tokens. The tokens are named once: written into the inner function they
    would be made anew for each run."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
    return F.get(F.transform(F.array(tokens), lambda w: F.when(F.size(w) >= size, F.array_distinct(runs(w)))), F.lit(0))


def passages_in(docs: DataFrame, passages: DataFrame, words: int = 6) -> DataFrame:
    """query_id, doc_id: documents that contain a passage (item_id, text) as it stands, as a substring; null and empty
    passages are in none.

    Between its first and its last blank a passage consists of whole words of the text around it. So the hash of a run
    of at most `words` of these words, that of a passage's second word on, meets the hashes of all runs of each
    document; shorter runs are made where shorter passages ask for them. Passages of one or two words have no such
    word and are met by their first characters instead. The passages go to the documents by a broadcast, so that no run
    of a document moves; of documents that are dealt by their id (session.dealt) the pairs found meet the texts where
    they are."""
    asked = passages.filter(F.length("text") > 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    blanks = F.split("passage", " ")
    inner = F.least(F.lit(words), F.size(blanks) - 2)
    anchored = asked.withColumns({"n": F.greatest(inner, F.lit(0)), "m": F.when(inner < 1, F.least(F.lit(8), F.length("passage"))).otherwise(0)})
    sizes = anchored.select("n", "m").distinct().collect()  # at most words + 8 rows
    hits = None
    for n, m in sorted(map(tuple, sizes)):
        key = F.xxhash64(F.slice(blanks, 2, n)) if n else F.xxhash64(F.array(F.substring("passage", 1, m)))
        wanted = anchored.filter((F.col("n") == n) & (F.col("m") == m)).select("query_id", key.alias("run"))
        tokens = F.split("text", " ") if n else F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (m - 1), F.lit(1))), lambda i: F.substring("text", i, F.lit(m)))  # noqa: B023
        found = listed(docs, _runs(tokens, n or 1), "run", "doc_id").join(F.broadcast(wanted), "run").select("query_id", "doc_id")
        hits = found if hits is None else hits.unionAll(found)
    if hits is None:
        return asked.select("query_id", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    pairs = docs.select("doc_id", "text").hint("shuffle_hash").join(hits.distinct(), "doc_id").join(F.broadcast(asked), "query_id")
    return pairs.filter(F.col("text").contains(F.col("passage"))).select("query_id", "doc_id").distinct()


def run(test_set: DataFrame, n: int, docs: DataFrame, run_id: str, k: int = 10) -> DataFrame:
    """run_id, item_id, metric, value: the records of a run over n samples of a test set (item_id, text), whose items
    are found by BM25 and judged by the documents that hold them as they stand."""
    items = sample(test_set, n, "item_id")
    ranked = top_k(bm25(build_index(docs), query_terms(items, "item_id")), k)
    found = metrics(ranked, passages_in(docs, items), k)
    names = ["recall", "precision", "hit", "rr", "ndcg"]
    values = found.select(F.col("query_id").alias("item_id"), *(F.col(c).cast("double") for c in names))
    return values.unpivot("item_id", names, "metric", "value").select(F.lit(run_id).alias("run_id"), "item_id", "metric", "value")


def two_proportion_z(rows: DataFrame, group: str, outcome: str, limit: float = 1.959964) -> DataFrame:
    """n_0, n_1, z, significant: whether the outcome (0 or 1) is as frequent in group 1 as in group 0."""
    side = lambda g, f, c: F.coalesce(f(F.when(F.col(group) == g, c)), F.lit(0))
    one = rows.agg(*(side(g, F.count, F.lit(1)).alias(f"n_{g}") for g in (0, 1)), *(side(g, F.sum, F.col(outcome)).alias(f"x_{g}") for g in (0, 1)))
    p = (F.col("x_0") + F.col("x_1")) / (F.col("n_0") + F.col("n_1"))
    z = (F.col("x_1") / F.col("n_1") - F.col("x_0") / F.col("n_0")) / F.sqrt(p * (1 - p) * (1 / F.col("n_0") + 1 / F.col("n_1")))
    z = F.when((F.col("n_0") > 0) & (F.col("n_1") > 0) & (p > 0) & (p < 1), z)
    return one.select("n_0", "n_1", F.round(z, 6).alias("z")).withColumn("significant", F.coalesce(F.abs("z") > limit, F.lit(False)))


def compare_runs(records: DataFrame) -> DataFrame:
    """run_id, metric, value, change from the run before it, of records (run_id, metric, value)."""
    rows = records.groupBy("run_id", "metric").agg(F.round(F.avg("value"), 6).alias("value"))
    before = F.lag("value").over(Window.partitionBy("metric").orderBy("run_id"))
    return rows.withColumn("change", F.round(F.col("value") - before, 6))
