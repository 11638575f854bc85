"""The question-answering loop as a fixed plan of five gated stages.

Language models are out of scope: stages decide by explicit rules, and the answer is the evidence it would cite.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.text import terms
from lodestone.operators.blockmax import Blocks, search
from lodestone.operators.embedding import Embedder, HashingEmbedder, embed
from lodestone.operators.retrieval import COLLECTIONS, bm25, build_index, collection_of, covered, fuse, knn, min_max, query_terms, rerank, top_k, weight_collections
from lodestone.session import kept

Scorer = Callable[[Column, Column], Column]

#: The four disease areas with keywords; the short words are stand-ins that the test texts have.
KEYWORDS = (
    ("hypertension", "高血压"),
    ("hypertension", "the"),
    ("hyperlipidaemia", "高血脂"),
    ("hyperlipidaemia", "la"),
    ("type-2 diabetes", "糖尿病"),
    ("type-2 diabetes", "und"),
    ("comorbidity", "心脑血管"),
    ("comorbidity", "une"),
)


def keyword_hits(queries: DataFrame, keywords: tuple[tuple[str, str], ...] = KEYWORDS, query_id: str = "query_id") -> DataFrame:
    """query_id, disease, hits: how many of a disease's keywords each text holds, as a term or, in Han script, as a
    part. Each text is read once, against a list that is part of the plan."""
    found = terms(F.col("text"))
    by: dict[str, list[str]] = {}
    for disease, word in keywords:
        by.setdefault(disease, []).append(word)
    holds = lambda w: F.array_contains("found", w) if w.isascii() else F.col("text").contains(w)
    counts = [F.struct(F.lit(d).alias("disease"), sum((holds(w).cast("int") for w in ws), F.lit(0)).alias("hits")) for d, ws in sorted(by.items())]
    rows = queries.select(query_id, "text", found.alias("found")).select(query_id, F.explode(F.array(*counts)).alias("k"))
    return rows.select(query_id, "k.disease", F.coalesce("k.hits", F.lit(0)).alias("hits"))


def gate(queries: DataFrame, query_id: str = "query_id", **options) -> DataFrame:
    """query_id, refused: whether a text has no keyword of the domain."""
    return keyword_hits(queries, query_id=query_id, **options).groupBy(query_id).agg((F.sum("hits") == 0).alias("refused"))


def classify(queries: DataFrame, query_id: str = "query_id", **options) -> DataFrame:
    """query_id, disease, hits: the disease with most keywords, the first by name of equals; null without any."""
    hits = keyword_hits(queries, query_id=query_id, **options)
    most = hits.groupBy(query_id).agg(F.max("hits").alias("hits"))
    first = hits.filter("hits > 0").join(most, [query_id, "hits"]).groupBy(query_id).agg(F.min("disease").alias("disease"))
    return most.join(first, query_id, "left").select(query_id, "disease", "hits")


def evidence(ranked: DataFrame, min_hits: int = 3, min_score: float = 10.0, min_collections: int = 2) -> DataFrame:
    """query_id, n_good, n_collections, sufficient, confidence. ranked: query_id, doc_id, collection, score. Confidence
    is the weight of the good hits' collections over that of ten hits of the best collection, at most 1."""
    weight = F.element_at(F.create_map(*(F.lit(x) for p in COLLECTIONS.items() for x in p)), F.col("collection"))
    good = F.col("score") >= min_score
    rows = ranked.groupBy("query_id").agg(
        F.count_if(good).alias("n_good"),
        F.countDistinct(F.when(good, F.col("collection"))).alias("n_collections"),
        F.round(F.least(F.lit(1.0), F.coalesce(F.sum(F.when(good, weight)), F.lit(0.0)) / (10 * max(COLLECTIONS.values()))), 6).alias("confidence"),
    )
    return rows.withColumn("sufficient", (F.col("n_good") >= min_hits) & (F.col("n_collections") >= min_collections))


def bundle(ranked: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """query_id, references: array of (rank, id and the columns `more`), in order; its length is that of the ranking."""
    return ranked.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(doc_id).alias("id"), *more))).alias("references"))


def reference_text(references: str = "references") -> F.Column:
    return F.array_join(F.transform(references, lambda r: F.concat_ws(":", r["rank"], r["id"])), " ")


def coverage(queries: DataFrame, ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, top_sim: the greatest share of a query's distinct terms that one of its documents holds; 0 for a query
    without any document."""
    asked = queries.groupBy("query_id").agg(F.collect_set("term").alias("asked"))
    held = docs.select("doc_id", F.array_distinct(terms(F.col("text"))).alias("held"))
    rows = held.join(F.broadcast(ranked.select("query_id", "doc_id")), "doc_id").join(asked, "query_id")  # hits are few, texts stay
    best = rows.groupBy("query_id").agg(F.round(F.max(F.size(F.array_intersect("asked", "held")) / F.size("asked")), 6).alias("top_sim"))
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("top_sim", F.lit(0.0)).alias("top_sim"))


def local_search(queries: DataFrame, docs: DataFrame, pool: int = 50, candidates: int = 20, scorer: Scorer = covered, factory: Callable[[], Embedder] = HashingEmbedder, index: Blocks | None = None, vectors: bool = True, rescored: bool = True) -> DataFrame:
    """query_id, doc_id, collection, score, rank: the `pool` best by BM25 and by vectors, fused, weighted by collection,
    cut to `candidates` and scored anew. queries: query_id, text; docs: doc_id, text, source. With a stored index of the
    documents (sources.segments) the terms of the texts are not counted again. Without `vectors` the scores of BM25, scaled
    as in the fusion, stand alone; without `rescored` hits keep their weighted scores."""
    asked = query_terms(queries, "query_id")
    by_terms = top_k(bm25(build_index(docs), asked), pool) if index is None else search(index, asked, pool)
    if vectors:
        embedded = embed(docs, "doc_id", factory=factory).repartition("id")  # knn() counts and compares them: both read this exchange
        fused = fuse(by_terms, knn(embedded, embed(queries, "query_id", factory=factory), pool))
    else:
        fused = by_terms.select("query_id", "doc_id", F.round(min_max(by_terms), 6).alias("score"))
    known = docs.select("doc_id", collection_of(F.col("source")).alias("collection"))
    found = top_k(weight_collections(fused, known), candidates)
    if not rescored:
        return found.select("query_id", "doc_id", "collection", "score", "rank")
    return rerank(found, queries, docs, candidates, scorer).join(known, "doc_id")


def external_search(queries: DataFrame, external: DataFrame, candidates: int = 20, scorer: Scorer = covered) -> DataFrame:
    """query_id, doc_id (-1 - the given one), collection, score: the best external texts (doc_id, text) by BM25, scored
    as local ones are."""
    found = top_k(bm25(build_index(external), query_terms(queries, "query_id")), candidates)
    rows = rerank(found, queries, external, candidates, scorer)
    return rows.select("query_id", (-1 - F.col("doc_id")).alias("doc_id"), F.lit("coll_common_study").alias("collection"), "score")


#: The tools of the loop, by name.
TOOLS: dict[str, Callable[..., DataFrame]] = {"query_classifier": classify, "local_search": local_search, "external_search": external_search, "evidence_evaluator": evidence}


def answer(queries: DataFrame, docs: DataFrame, external: DataFrame, k: int = 10, threshold: float = 0.7, min_score: float = 0.3, tools: dict[str, Callable[..., DataFrame]] = TOOLS) -> DataFrame:
    """The columns of `queries` but for its text (query_id, and user_id and conversation_id where they are given), status,
    disease, top_sim, rounds_used, confidence, answer (the beginning of the best reference) and references, an array of
    structs (rank, id, title, authors, year); the last three are null where docs and external lack them.

    1 domain gate and class; 2 local search; 3 where its best similarity is below the threshold or its evidence does
    not suffice, search of the external texts, which rank after local ones of equal score; 4 evidence; 5 bundle. Hits
    of score 0 are not cited. Classes, open queries and hits are kept in the shared folder between the rounds, which all
    read them."""
    asked = queries.select("query_id", "text")
    known = kept(tools["query_classifier"](asked).join(gate(asked), "query_id"))
    open_queries = kept(asked.join(known.filter(~F.col("refused")).select("query_id"), "query_id", "left_semi"))
    local = kept(tools["local_search"](open_queries, docs))
    sims = open_queries.select("query_id").join(local.groupBy("query_id").agg(F.max("score").alias("best")), "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("top_sim"))
    enough = tools["evidence_evaluator"](local.filter(F.col("rank") <= k), min_score=min_score).filter("sufficient").select("query_id")
    searched = kept(sims.filter(F.col("top_sim") < threshold).select("query_id").unionAll(sims.select("query_id").join(enough, "query_id", "left_anti")).distinct())
    outside = tools["external_search"](open_queries.join(searched, "query_id", "left_semi"), external)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), (F.col("doc_id") < 0).cast("int"), F.abs("doc_id"))
    both = local.select("query_id", "doc_id", "collection", "score").unionByName(outside)
    ranked = kept(both.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    texts = _described(docs, F.col("doc_id")).unionByName(_described(external, -1 - F.col("doc_id")))
    cited = bundle(texts.join(F.broadcast(ranked), "doc_id"), more=("title", "authors", "year", "begins")).withColumn("answer", F.col("references")[0]["begins"])
    cited = cited.withColumn("references", F.transform("references", lambda r: r.dropFields("begins")))
    rows = queries.drop("text").join(known, "query_id").join(sims, "query_id", "left").join(evidence(ranked, min_score=min_score), "query_id", "left").join(cited, "query_id", "left")
    rows = rows.join(searched.withColumn("searched", F.lit(True)), "query_id", "left")
    status = F.when(F.col("refused"), "refused").when(F.coalesce("sufficient", F.lit(False)), "success").otherwise("insufficient")
    rounds = F.when(F.col("refused"), 1).when(F.coalesce("searched", F.lit(False)), 5).otherwise(4)
    request = [c for c in queries.columns if c != "text"]
    none = F.array().cast(cited.schema["references"].dataType)
    return rows.select(*request, status.alias("status"), "disease", "top_sim", rounds.alias("rounds_used"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("references", none).alias("references"))


def answer_with(settings: Settings, queries: DataFrame, docs: DataFrame, external: DataFrame, **local) -> DataFrame:
    """answer() by the settings of the service; `local` are further arguments of local_search()."""
    search_ = partial(local_search, pool=settings.pool, candidates=settings.candidates, vectors=settings.embeddings, rescored=settings.rerank, **local)
    outside = partial(external_search, candidates=settings.candidates)
    return answer(queries, docs, external, settings.k, settings.threshold, settings.min_score, TOOLS | {"local_search": search_, "external_search": outside})


def _described(docs: DataFrame, doc_id: Column) -> DataFrame:
    """doc_id, title, authors, year, begins (200 characters of the text)."""
    kinds = {"title": "string", "authors": "string", "year": "int"}
    given = [(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    return docs.select(doc_id.alias("doc_id"), *given, F.substring("text", 1, 200).alias("begins"))


def context(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, before (roles so far, in order), previous (text of the turn before)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.array_join(F.collect_list("role").over(w.rowsBetween(Window.unboundedPreceding, -1)), ">")
    return turns.select("conv_id", "turn", "role", before.alias("before"), F.lag("text").over(w).alias("previous"))


def synonyms(spark: SparkSession) -> DataFrame:
    """term, synonym: a small fixed list."""
    return spark.createDataFrame([("the", "this"), ("and", "with"), ("und", "mit"), ("la", "le")], "term string, synonym string")
