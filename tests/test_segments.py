import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import agent, blockmax, retrieval
from lodestone.sources.segments import Conflict, Store

WORDS = [f"w{i}" for i in range(60)]


def text(r, n):
    return " ".join(r.choice(WORDS[: r.choice((3, 10, 60))]) for _ in range(n))


def collection(spark, ids, seed=0):
    r = random.Random(seed)
    return {i: text(r, r.randrange(30)) for i in ids}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def asked(spark, n=8):
    r = random.Random(99)
    queries = spark.createDataFrame([(q, text(r, r.randrange(1, 9)) + " unknown") for q in range(n)], "q long, text string")
    return retrieval.query_terms(queries, "q")


def plain(rows):
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in rows.collect())


def wanted(spark, texts, k):
    index = retrieval.build_index(frame(spark, texts))
    return plain(retrieval.top_k(retrieval.bm25(index, asked(spark)), k))


@pytest.mark.parametrize(("k", "size", "settings"), [(3, 4, {}), (1, 1, {"seed_postings": 1, "seed_docs": 1, "rounds": 1}), (400, 128, {})])
def test_block_max_search_equals_the_whole_search(spark, k, size, settings):
    texts = collection(spark, range(300)) | {1000: "w1 " * 3000, 1001: "", 1002: None, 1003: "w1", 1004: "w1"}
    found = blockmax.search(blockmax.build_blocks(frame(spark, texts), size), asked(spark), k, **settings)
    assert plain(found) == wanted(spark, texts, k)


def test_peaks_bound_every_posting(spark):
    index = blockmax.build_blocks(frame(spark, collection(spark, range(200))), 16)
    for r in index.postings.collect():
        ids = [d.id for d in r.docs]
        assert ids == sorted(ids) and all(any(p.tf >= d.tf and p.dl <= d.dl for p in r.peaks) for d in r.docs)
        assert {(p.tf, p.dl) for p in r.peaks} <= {(d.tf, d.dl) for d in r.docs}
        assert not any(p.tf >= q.tf and p.dl <= q.dl for p in r.peaks for q in r.peaks if p is not q)


def test_few_postings_are_scored(spark):
    r = random.Random(4)
    zipf = [f"z{min(int(r.paretovariate(0.9)), 3000)}" for _ in range(60_000)]
    texts = {i: " ".join(zipf[i * 20 : i * 20 + 20]) for i in range(3000)}
    queries = spark.createDataFrame([(i, texts[i * 37]) for i in range(20)], "q long, text string")
    index, terms = blockmax.build_blocks(frame(spark, texts), 32), retrieval.query_terms(queries, "q")
    made = blockmax.steps(index, terms, 5, seed_postings=20)
    assert plain(made.hits) == plain(retrieval.top_k(retrieval.bm25(retrieval.build_index(frame(spark, texts)), terms), 5))
    total = blockmax.work(made).agg(F.sum("matches").alias("matches"), F.sum("scored").alias("scored")).first()
    assert total.scored < 0.5 * total.matches


def counting(spark, rows):
    """The rows, and an accumulator of how many of them have been read."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(passed, rows.schema), seen


def test_texts_are_cut_twice_and_the_index_is_read_once(spark):
    texts = collection(spark, range(120)) | {1000: "", 1001: None}
    docs, cut = counting(spark, frame(spark, texts))
    index = blockmax.build_blocks(docs, 8)
    assert cut.value == 2 * len(texts)  # for the counts of terms, and for the blocks
    postings, blocks = counting(spark, index.postings)
    terms, known = counting(spark, index.terms)
    found = blockmax.search(index._replace(postings=postings, terms=terms), asked(spark), 3)
    assert plain(found) == wanted(spark, texts, 3)
    assert blocks.value == index.postings.count() and known.value == index.terms.count()


def test_no_queries_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert blockmax.search(blockmax.build_blocks(none), asked(spark), 3).count() == 0
    index = blockmax.build_blocks(frame(spark, {1: "w1"}))
    assert blockmax.search(index, asked(spark).limit(0), 3).count() == 0


def test_increments_and_deletions_equal_a_full_build(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), size=8)
    texts = {}

    def same(k=5):
        m = store.manifest()
        assert plain(blockmax.search(store.index(m), asked(spark), k)) == wanted(spark, texts, k)
        assert {r.id for r in store.documents(m).collect()} == set(texts)

    for step in range(3):
        new = collection(spark, range(step * 40, step * 40 + 60), step)  # 20 ids replace earlier ones
        store.add(frame(spark, new))
        texts |= new
    store.delete(spark.createDataFrame([(i,) for i in (3, 45, 45, 70, 9999)], "id long"))
    for i in (3, 45, 70):
        del texts[i]
    same()
    store.add(frame(spark, {3: "w1 w2", 500: "", 501: None}))
    texts |= {3: "w1 w2", 500: "", 501: None}
    before = store.manifest()
    assert len(before.segments) == 4
    after = store.merge(fan=3, least=1000)
    assert len(after.segments) == 1 and not after.dead and after.segments[0].docs == len(texts)
    same()
    assert store.merge(fan=3) == after  # nothing is due
    store.delete(spark.createDataFrame([(500,)], "id long"))
    del texts[500]
    same()
    store.merge_all()
    store.vacuum(keep=1)
    same()
    assert len(os.listdir(tmp_path / "store" / "postings")) == 1 and store.versions() == [store.manifest().version]


def test_a_failed_change_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"), size=8)
    texts = collection(spark, range(30))
    first = store.add(frame(spark, texts))

    def dies(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(Store, "_swap", dies)
        with pytest.raises(OSError):
            store.add(frame(spark, collection(spark, range(90), 7)))
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string"))
    assert store.manifest() == first
    (tmp_path / "store" / "manifests" / f"{first.version + 1:012d}.json").write_text('{"segments": [')  # half a manifest
    assert store.manifest() == first and {r.id for r in store.documents().collect()} == set(texts)
    second = store.add(frame(spark, {77: "w1"}))
    assert second.version == first.version + 2 and json.loads((tmp_path / "store" / "manifests" / f"{second.version:012d}.json").read_text())
    store.vacuum(keep=1)
    assert plain(blockmax.search(store.index(), asked(spark), 5)) == wanted(spark, texts | {77: "w1"}, 5)


def test_of_two_changes_to_one_version_the_second_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    base = store.add(frame(spark, {1: "w1"}))
    store.add(frame(spark, {2: "w2"}))
    with pytest.raises(Conflict):
        store._swap(base, list(base.segments), [])
    assert len(store.manifest().segments) == 2 and store.manifest(base.version) == base


def test_the_agent_answers_alike_from_a_stored_index(spark, tmp_path):
    texts = collection(spark, range(40))
    docs = frame(spark, texts).withColumn("source", F.concat(F.lit("src"), F.col("doc_id") % 5))
    store = Store(spark, str(tmp_path / "store"), size=8)
    store.add(docs.filter("doc_id < 25"))
    store.add(docs.filter("doc_id >= 25"))
    queries = spark.createDataFrame([(q, " ".join(WORDS[q : q + 4])) for q in range(5)], "query_id long, text string")
    plainly = agent.local_search(queries, docs)
    stored = agent.local_search(queries, docs, index=store.index())
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plainly.collect()))
