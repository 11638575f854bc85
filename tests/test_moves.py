"""What moves between tasks: neither postings nor pairs of queries and documents, where documents are dealt by their id."""

import re
from collections import Counter
from functools import partial

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.text import counted
from lodestone.operators import agent, blockmax, embedding, evaluation, positions, retrieval, rewriting, selfplay
from lodestone.plans import evidence
from lodestone.session import dealt
from lodestone.sources import segments

TEXTS = ["the cat sat on the mat", "a dog sat", "", None, "the the cat", "on a mat a cat sat on the mat again and again"]


def docs(spark):
    rows = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    return dealt(rows, "doc_id", 2)


def asked(spark):
    return spark.createDataFrame([(1, "the cat"), (2, "sat on the mat")], "query_id long, text string")


def moved(frame) -> list[str]:
    """The keys of the exchanges of a plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc")), min_size=1, max_size=5))
def test_counts_within_a_row(spark, lists):
    got = spark.createDataFrame(list(enumerate(lists)), "id long, items array<string>").select("id", counted(F.col("items")).alias("c")).collect()
    assert {r.id: {c.term: c.tf for c in r.c} for r in got} == {i: dict(Counter(w)) for i, w in enumerate(lists)}


def test_scores_are_cut_before_they_move(spark):
    index, terms = retrieval.build_index(docs(spark)), retrieval.query_terms(asked(spark), "query_id")
    scored = retrieval.bm25(index, terms)
    assert set(moved(retrieval.top_k(scored, 3))) == {"doc_id", "term", "query_id"}
    grid = selfplay.grid_scores(index, terms, {"x": (1.2, 0.75), "y": (0.9, 0.4)})
    assert set(moved(grid)) == {"doc_id", "term"}
    weighted = retrieval.weight_collections(scored, docs(spark).withColumn("collection", F.lit("coll_cn_guide")))
    assert set(moved(weighted)) == {"doc_id", "term"}
    assert "SortMergeJoin [doc_id" not in weighted._jdf.queryExecution().executedPlan().toString()


def test_texts_and_runs_stay(spark):
    passages = asked(spark).withColumnRenamed("query_id", "item_id")
    found = evaluation.passages_in(docs(spark), passages)
    assert "run" not in moved(found)
    assert {tuple(r) for r in found.collect()} == {(1, 0), (1, 4), (2, 0), (2, 5)}
    candidates = spark.createDataFrame([(1, 0), (2, 5)], "query_id long, doc_id long")
    assert moved(retrieval.rerank(candidates, asked(spark), docs(spark), 5)).count("doc_id") == 1  # that of docs()
    fed = rewriting.feedback(retrieval.build_index(docs(spark)), retrieval.query_terms(asked(spark), "query_id"), candidates.withColumn("score", F.lit(1.0)))
    assert "id" not in moved(fed)
    starts = positions.phrases(positions.positional(docs(spark)), positions.query_places(asked(spark)))
    assert {tuple(r) for r in starts.select("query_id", "doc_id", F.col("starts")[0]).collect()} == {(1, 0, 0), (1, 4, 1), (2, 0, 2), (2, 5, 5)}


def test_feedback_searches_once(spark):
    index, terms = retrieval.build_index(docs(spark)), retrieval.query_terms(asked(spark), "query_id")
    fed = rewriting.feedback(index, terms, retrieval.top_k(retrieval.bm25(index, terms), 3))
    assert "ln(" not in fed._jdf.queryExecution().executedPlan().toString()  # no idf: the search isn't part of what is left


def test_both_runs_rank_the_hits_of_one_search(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    asked(spark).withColumnRenamed("query_id", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = evidence.eval_compare_runs(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ln(" not in plan and "regexp_extract_all" not in plan  # no search is part of what is left
    assert [r.run_id for r in found.orderBy("run_id").collect()] == ["1-plain", "2-weighted"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 12)), st.sampled_from([None, "coll_cn_guide", "coll_rct_meta", "other"])), min_size=1, max_size=16), st.lists(st.integers(1, 4), min_size=13, max_size=13), st.integers(1, 3))
def test_contenders_hold_both_rankings(spark, rows, scores, k):
    known = spark.createDataFrame(rows, "doc_id long, collection string")  # ids and rows that come twice, null ids and collections
    ids = [None, *range(13)]
    scored = spark.createDataFrame([(q, i, float(scores[(i or 0) - q])) for q in (0, 1) for i in ids], "query_id long, doc_id long, score double")
    some = retrieval.contenders(scored, known, k)
    plain = lambda d: Counter(map(tuple, retrieval.top_k(d, k).select("query_id", "doc_id", "score", "rank").collect()))
    assert plain(some) == plain(scored)
    assert plain(retrieval.weight_collections(some, known)) == plain(retrieval.weight_collections(scored, known))


def counting(spark, rows):
    """The rows, and an accumulator of how many of them have been read."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(passed, rows.schema), seen


def test_the_agent_embeds_once_and_classifies_once(spark):
    seen = spark.sparkContext.accumulator(0)

    class Embedder(embedding.HashingEmbedder):
        def __call__(self, texts):
            seen.add(sum(t.startswith("document") for t in texts))
            return super().__call__(texts)

    texts = docs(spark).withColumn("text", F.concat(F.lit("document "), F.coalesce("text", F.lit(""))))
    queries, read = counting(spark, asked(spark))
    search = partial(agent.local_search, factory=Embedder)
    found = agent.answer(queries, texts, texts.select("doc_id", "text").limit(0), tools=agent.TOOLS | {"local_search": search})
    assert seen.value == len(TEXTS) and read.value <= 5 * 2  # 2 queries: the class asks three times, the gate once, the open ones once
    assert [r.status for r in found.orderBy("query_id").collect()] == ["success", "insufficient"]


def test_blocks_stay_where_they_are(spark):
    index, terms = blockmax.build_blocks(docs(spark), size=2), retrieval.query_terms(asked(spark), "query_id")
    made = blockmax.steps(index, terms, 2)
    assert moved(made.scored) == []  # the queries' terms go to the blocks
    hits = retrieval.top_k(retrieval.bm25(retrieval.build_index(docs(spark)), terms), 2)
    assert {tuple(r) for r in made.hits.collect()} == {tuple(r) for r in hits.collect()}


def test_a_segment_moves_its_postings_once(spark, tmp_path, monkeypatch):
    written, write = [], segments.Store._write_segment
    monkeypatch.setattr(segments.Store, "_write_segment", lambda self, tf, rows: written.append(rows) or write(self, tf, rows))
    plain = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    segments.Store(spark, str(tmp_path)).add(plain)
    assert moved(written[0]) == []  # the terms of a document are made within its row
