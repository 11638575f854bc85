"""BM25 over an index in blocks that know their best postings: exact best hits from a part of the postings.

The postings of a term are dealt by the hash of the document into blocks of about `size` postings, each sorted by
document. A block keeps its peaks: the (tf, dl) pairs that no other pair of the block beats in both. For any average
length they give the largest score a posting of the block can add, so bounds stay exact while a collection grows.

A search has two phases. The first scores the postings of each query's rarest terms, looks the best of these documents
up in the blocks of all its terms, and takes the k-th of their exact scores as the threshold. The second drops terms
which together can't reach the threshold as long as they come without others, then the blocks of the other terms that
can't reach it even with the best of all others. The documents found are looked up in the dropped terms' blocks, in
rounds that each take about half of what the terms left can add, the most telling first; before and after each round
those go whose score so far and best rest don't reach the threshold. Since every step goes by bounds, the result is that
of retrieval.bm25 and top_k.

The queries' terms, with what is known of each, go to the blocks and to the documents found by broadcast. A search reads
the index once, for the blocks of its queries' terms, which it keeps. Blocks only move to be looked up, and then only those
of the terms that are looked up, or those asked for where these are no more than the queries tell.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import build_index, document_counts, idf, top_k
from lodestone.session import kept, stored

#: Scores are rounded to 6 decimals; bounds leave room for that and for the order of sums.
ROOM = 2e-6


class Blocks(NamedTuple):
    """An index of one or more segments.

    postings: segment, term, block, docs (array of id, tf, dl, sorted by id), peaks (array of tf, dl)
    terms: segment, term, n_blocks
    df: term, df over all segments, without dead documents
    dead: segment, id of documents that are deleted, or None
    n_docs, avg_dl: of the documents that are not
    """

    postings: DataFrame
    terms: DataFrame
    df: DataFrame
    dead: DataFrame | None
    n_docs: int
    avg_dl: float


def block_of(doc_id: Column, n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), n_blocks.cast("long")).cast("int")


def blocked(tf: DataFrame, size: int = 128, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (term, block, docs, peaks) and terms (term, df, n_blocks) of tf (id, term, tf, dl). Terms that are known
    already are not counted again."""
    if terms is None:
        terms = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("n_blocks", _n_blocks(size))
    rows = tf.hint("merge").join(terms.select("term", "n_blocks"), "term")
    posting = F.struct("id", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))
    blocks = rows.groupBy("term", block_of(F.col("id"), F.col("n_blocks")).alias("block")).agg(F.array_sort(F.collect_list(posting)).alias("docs"))
    return blocks.withColumn("peaks", _peaks("docs")), terms


def _n_blocks(size: int) -> Column:
    return F.ceil(F.col("df") / size).cast("int")


def _peaks(docs: str) -> Column:
    """The pairs (tf, dl) of postings that no other beats in both: the shortest texts first, then each larger tf."""
    by_length = f"array_sort(transform({docs}, d -> struct(d.dl AS dl, -d.tf AS less)))"
    none = "CAST(array() AS array<struct<tf: int, dl: int>>)"
    more = "concat(found, array(named_struct('tf', -d.less, 'dl', d.dl)))"
    return F.expr(f"aggregate({by_length}, {none}, (found, d) -> if(size(found) = 0 OR element_at(found, -1).tf < -d.less, {more}, found))")


def build_blocks(docs: DataFrame, size: int = 128, doc_id: str = "doc_id", text: str = "text") -> Blocks:
    """The index of docs as one segment, kept in the shared folder. The texts are cut twice: for the terms and the
    corpus' figures, and then for the postings, whose blocks need the counts of the terms."""
    index = build_index(docs, doc_id, text)
    counts = stored(document_counts(index).withColumn("segment", F.lit("0")).withColumn("n_blocks", _n_blocks(size)))
    terms = counts.filter("term <> ''")
    postings, _ = blocked(index.tf, size, terms)
    postings = stored(postings.withColumn("segment", F.lit("0")))  # packed, and read by column
    corpus = counts.filter("term = ''").first()  # None without documents
    n_docs, length = (corpus["df"], corpus["length"]) if corpus else (0, 0)
    return Blocks(postings, terms.select("segment", "term", "n_blocks"), terms.select("term", "df"), None, n_docs, length / n_docs if n_docs else 0.0)


class Steps(NamedTuple):
    """What a search made on its way: asked (query_id, term, df, ...), scored (query_id of each posting that was scored),
    and the hits (query_id, doc_id, score, rank)."""

    asked: DataFrame
    scored: DataFrame
    hits: DataFrame


def _impact(tf: Column, dl: Column, avg_dl: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avg_dl)))


def steps(index: Blocks, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, seed_postings: int = 100, seed_docs: int = 5, rounds: int = 4) -> Steps:
    """The steps of a search for the k best documents of each query (query_id, term; each term once).

    The rarest terms are seeds until they have `seed_postings` * k postings; the best `seed_docs` * k of their documents
    are scored exactly to find the threshold. These and `rounds` only decide how much is dropped, not what is found."""
    impact = lambda tf, dl: _impact(tf, dl, index.avg_dl, k1, b)
    cap = F.array_max(F.transform("peaks", lambda p: impact(p["tf"], p["dl"]))).alias("cap")

    wanted = kept(queries.join(index.df, "term").select("query_id", "term", "df", idf(F.lit(index.n_docs), F.col("df")).alias("idf")))
    sought = F.broadcast(wanted.select("term").distinct())
    held = stored(index.postings.join(sought, "term", "left_semi").select("segment", "term", "block", "docs", cap))
    caps = held.select("segment", "term", "block", "cap")
    n_blocks = kept(index.terms.join(sought, "term", "left_semi").select("segment", "term", "n_blocks"))
    asked = wanted.join(caps.groupBy("term").agg(F.max("cap").alias("top")), "term").withColumn("most", F.col("idf") * F.col("top"))
    of_query = Window.partitionBy("query_id")
    rarer = F.sum("df").over(of_query.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    asked = kept(asked.withColumns({"seed": F.coalesce(rarer, F.lit(0)) < seed_postings * k, "all": F.sum("most").over(of_query)}))

    def parts(blocks: DataFrame) -> DataFrame:
        """query_id, segment, id, part of each posting in blocks (query_id, idf, segment, docs) that isn't dead."""
        rows = blocks.select("query_id", "segment", "idf", F.explode("docs").alias("d"))
        rows = rows.select("query_id", "segment", F.col("d.id").alias("id"), (F.col("idf") * impact(F.col("d.tf"), F.col("d.dl"))).alias("part"))
        return rows if index.dead is None else rows.join(index.dead, ["segment", "id"], "left_anti")

    def placed(candidates: DataFrame, terms: DataFrame) -> DataFrame:
        """Each candidate (query_id, segment, id) with each of its query's terms, and the block it would be in."""
        rows = candidates.join(F.broadcast(terms.select("query_id", "term", "idf").join(n_blocks, "term")), ["query_id", "segment"])
        return rows.withColumn("block", block_of(F.col("id"), F.col("n_blocks"))).drop("n_blocks")

    def looked_up(places: DataFrame, postings: DataFrame) -> DataFrame:
        """query_id, segment, id, part of the places that hold a posting."""
        found = places.join(postings.select("segment", "term", "block", "docs").hint("merge"), ["segment", "term", "block"])
        found = found.withColumn("d", F.expr("filter(docs, d -> d.id = id)")).filter(F.size("d") > 0).withColumn("d", F.col("d")[0])
        return found.select("query_id", "segment", "id", (F.col("idf") * impact(F.col("d.tf"), F.col("d.dl"))).alias("part"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("query_id", "segment", "id").agg(F.sum("part").alias("part"))

    seeds = parts(held.join(F.broadcast(asked.filter("seed")), "term"))
    best = top_k(summed(seeds), seed_docs * k, "part", "id")
    at = F.xxhash64("segment", "term", "block").alias("at")
    places = kept(placed(best.select("query_id", "segment", "id"), asked))  # `seed_docs` * k for each term of a query
    first = kept(looked_up(places, held.withColumn("at", at).join(F.broadcast(places.select(at).distinct()), "at", "left_semi")))
    exact = summed(first).select("query_id", F.round("part", 6).alias("score"), F.col("id").alias("doc_id"))
    floor = top_k(exact, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    lower = F.sum("most").over(of_query.orderBy("most", "term"))  # of this term and all that can add less
    asked = asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - ROOM)
    asked = asked.withColumn("essential", lower >= F.col("floor"))
    others = F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("most"))).over(of_query)  # what the terms left can add
    before = others - F.when(F.col("essential"), 0.0).otherwise(lower)  # of it, in terms that can add more than this one
    turn = F.when(F.col("essential"), -1).otherwise(F.least(F.lit(rounds - 1), F.floor(-F.log2(F.greatest(F.lit(1e-9), 1 - before / others))).cast("int")))
    asked = kept(asked.withColumn("turn", turn))
    after = [F.sum(F.when(F.col("turn") > r, F.col("most")).otherwise(0.0)).alias(f"after{r}") for r in range(-1, rounds)]
    bounds = F.broadcast(kept(asked.groupBy("query_id").agg(F.first("floor").alias("floor"), *after)))  # a row a query

    reach = held.join(F.broadcast(asked.filter("essential")), "term")
    scored = parts(reach.filter(F.col("idf") * F.col("cap") + F.col("all") - F.col("most") >= F.col("floor")))

    def able(rows: DataFrame, r: int) -> DataFrame:
        return rows.join(bounds, "query_id").filter(F.col("part") + F.col(f"after{r}") >= F.col("floor")).select(*key, "part")

    key = ["query_id", "segment", "id"]
    left = kept(able(summed(scored), -1))
    all_scored = scored.select("query_id").unionAll(seeds.select("query_id")).unionAll(first.select("query_id"))
    for r in range(rounds):
        turns = asked.filter(F.col("turn") == r)
        places = placed(left.select(*key), turns)
        room = places.join(caps, ["segment", "term", "block"]).groupBy(*key).agg(F.sum(F.col("idf") * F.col("cap")).alias("room"))
        worth = left.join(room, key, "left").join(bounds, "query_id").filter(F.col("part") + F.coalesce("room", F.lit(0.0)) + F.col(f"after{r}") >= F.col("floor"))
        worth = kept(worth.select(*key, "part"))
        found = kept(looked_up(placed(worth.select(*key), turns), held.join(F.broadcast(turns.select("term").distinct()), "term", "left_semi")))
        all_scored = all_scored.unionAll(found.select("query_id"))
        left = kept(able(summed(worth.unionByName(found)), r))
    hits = top_k(left.select("query_id", F.col("id").alias("doc_id"), F.round("part", 6).alias("score")), k)
    return Steps(asked, all_scored, hits)


def search(index: Blocks, queries: DataFrame, k: int, **settings) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query, exactly; as steps()."""
    return steps(index, queries, k, **settings).hits


def work(made: Steps) -> DataFrame:
    """query_id, matches (postings of all its terms), scored (how many were scored; one that is scored twice counts twice)."""
    scored = made.scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("scored"))
    return made.asked.groupBy("query_id").agg(F.sum("df").alias("matches")).join(scored, "query_id", "left").fillna(0, ["scored"])
