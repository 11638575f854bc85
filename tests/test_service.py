import datetime

from pyspark.sql import functions as F

from lodestone.operators import agent, evolution, retrieval, safety
from lodestone.plans.relational import asof_join, range_join
from lodestone.sources import files
from lodestone.streaming import incremental


def test_gate_and_class_of_chinese_questions(spark):
    rows = [(1, "高血压患者如何用药"), (2, "糖尿病和高血压"), (3, "今天天气"), (4, None), (5, "")]
    q = spark.createDataFrame(rows, "query_id int, text string")
    assert {r.query_id: r.refused for r in agent.gate(q).collect()} == {1: False, 2: False, 3: True, 4: True, 5: True}
    assert {r.query_id: r.disease for r in agent.classify(q).collect()} == {1: "hypertension", 2: "hypertension", 3: None, 4: None, 5: None}


def test_loop_refuses_and_searches_outside(spark):
    docs = spark.createDataFrame([(1, "the heart and the salt", "src0"), (2, "the salt", "src1")], "doc_id long, text string, source string")
    outside = spark.createDataFrame([(4, "the rare molecule study"), (5, "nothing")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "the salt"), (2, "the rare molecule trial"), (3, "weather")], "query_id int, text string")
    got = {r.query_id: r for r in agent.answer(q, docs, outside).collect()}
    assert (got[3].status, got[3].rounds_used, got[3].references) == ("refused", 1, [])
    assert got[1].rounds_used == 5 and got[1].top_sim == 1.0 and got[1].answer == "the heart and the salt"  # one hit is no sufficient evidence
    assert got[2].rounds_used == 5 and -5 in [r.id for r in got[2].references]


def test_queries_without_local_hits_are_gaps(spark):
    docs = spark.createDataFrame([(1, "the heart and the salt", "src0")], "doc_id long, text string, source string")
    outside = spark.createDataFrame([(4, "la rara molecula"), (5, "nothing")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "the salt"), (2, "la rara molecula"), (3, "une histoire")], "query_id int, text string")
    got = {r.query_id: r for r in agent.answer(q, docs, outside).collect()}
    assert (got[2].top_sim, got[2].rounds_used, [r.id for r in got[2].references]) == (0.0, 5, [-5])
    assert (got[3].top_sim, got[3].status, got[3].references) == (0.0, "insufficient", [])
    asked = retrieval.query_terms(q, "query_id")
    ranked = retrieval.top_k(retrieval.bm25(retrieval.build_index(docs), asked), 10)
    gaps = agent.coverage(asked, ranked, docs).filter("top_sim < 0.95")
    filled = evolution.fill_gaps(gaps, retrieval.bm25(retrieval.build_index(outside), asked))
    assert {r.query_id: (r.status, r.doc_id) for r in filled.collect()} == {2: ("filled", 4), 3: ("open", None)}


def test_risk_levels(spark):
    docs = spark.createDataFrame([(1, "a@b.org"), (2, "x"), (3, "x"), (4, "1.2.3.4"), (5, None)], "doc_id int, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 0, 0)], "doc_id int, quality int, toxic int")
    assert {r.doc_id: r.risk for r in safety.risk(docs, labels).collect()} == {1: 4, 2: 3, 3: 2, 4: 2, 5: 1}


def test_answers_carry_the_request_and_described_references(spark):
    rows = [(i, f"the salt and the heart of patient {i}", f"src{i % 3}", f"T{i}", "A", 2000 + i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, title string, authors string, year int")
    q = spark.createDataFrame([(1, "the salt", "u1", "c9")], "query_id int, text string, user_id string, conversation_id string")
    r = agent.answer(q, docs, docs.limit(0)).first()
    assert (r.user_id, r.conversation_id, r.status, r.rounds_used, len(r.references)) == ("u1", "c9", "success", 4, 6)
    assert (r.references[0].id, r.references[0].title, r.references[0].year) == (0, "T0", 2000)
    tools = agent.TOOLS | {"local_search": lambda queries, docs: agent.local_search(queries, docs, scorer=lambda a, f: F.lit(0.5))}
    assert agent.answer(q, docs, docs.limit(0), tools=tools).first().top_sim == 0.5


def test_memory_finds_questions_put_otherwise(spark):
    bank = spark.createDataFrame([("how much salt is safe", "little"), ("when to walk", "daily")], "question string, answer string")
    q = spark.createDataFrame([(1, "salt: how much of it is safe"), (2, None)], "query_id int, text string")
    got = [(r.query_id, r.answer) for r in evolution.recall_memory(bank, q, 1, least=0.3).collect()]
    assert got == [(1, "little")]


def test_runs_go_on_from_batch_to_batch(spark, tmp_path):
    t0, at = datetime.datetime(2024, 1, 1), str(tmp_path / "in")
    kinds, got = ["aab", "bbba", "c"], []
    for n, part in enumerate(kinds):
        rows = [(1, 10 * n + i, t0 + datetime.timedelta(minutes=10 * n + i), k) for i, k in enumerate(part)]
        events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, event_type string")
        events.coalesce(1).write.mode("append").parquet(at)
        stream = incremental.longest_runs(incremental.landed(spark, at, events.schema))
        q = stream.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r.seen, r.longest) for r in got] == [(3, 2), (7, 4), (8, 4)]


def test_range_join_meets_each_pair_once(spark):
    p = spark.createDataFrame([(i, i * 0.7) for i in range(40)], "p int, at double")
    r = spark.createDataFrame([(1, 0.0, 9.1), (2, 5.0, 5.0), (3, -3.0, 30.0)], "r int, low double, high double")
    got = sorted((x.r, x.p) for x in range_join(p, r, "at", "low", "high", 4).collect())
    assert got == sorted((k, i) for k, lo, hi in [(1, 0, 9.1), (2, 5, 5), (3, -3, 30)] for i in range(40) if lo <= i * 0.7 <= hi)


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, at int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 6, 60)], "k string, at int, v int")
    assert sorted(map(tuple, asof_join(left, right, "k", "at", "v").collect()), key=str) == [("a", 1, None), ("a", 5, 50), ("b", 9, None)]


def test_stream_windows_equal_batch_but_for_the_open_ones(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=11 * i), "click") for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    stream = incremental.windowed(incremental.landed(spark, str(tmp_path / "in"), events.schema))
    q = stream.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = set(map(tuple, spark.table("w").collect()))
    end = rows[-1][1] - datetime.timedelta(minutes=10)
    want = {tuple(r) for r in incremental.windowed(events).collect()}
    assert got <= want and {w for w in want if w[0] + datetime.timedelta(hours=1) <= end} <= got


def test_incremental_load_adds_each_key_once(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "progress")}
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, text string")
    for batch in (one, spark.createDataFrame([(2, "b"), (3, "c")], one.schema)):
        batch.write.mode("append").parquet(at["in"])
        incremental.load_new(incremental.landed(spark, at["in"], one.schema), at["out"], at["progress"], "id")
    assert sorted(r.id for r in spark.read.parquet(at["out"]).collect()) == [1, 2, 3]


def test_tables_open_empty_and_append(spark, tmp_path):
    files.open_tables(spark, str(tmp_path))
    assert spark.table("table_knowledge_gap").count() == 0
    rows = spark.range(3).select(F.col("id").alias("query_id"), F.lit(0.5).alias("top_sim"), F.current_timestamp().alias("ts"), F.lit("open").alias("status"))
    files.append(rows, str(tmp_path), "table_knowledge_gap")
    files.open_tables(spark, str(tmp_path))
    assert spark.table("table_knowledge_gap").count() == 3


def test_sources_read_json_and_xml(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"item_id": 1, "text": "q"}, {"item_id": 2, "text": null}]')
    assert sorted(r.item_id for r in files.test_set(spark, str(tmp_path / "t.json")).collect()) == [1, 2]
    (tmp_path / "a.xml").write_text("<r><article><doc_id>4</doc_id><title>T</title><year>2020</year><full_text>x &amp; y</full_text></article></r>")
    row = files.xml_articles(spark, str(tmp_path / "a.xml")).first()
    assert (row.doc_id, row.title, row.year, row.full_text) == (4, "T", 2020, "x & y")


def test_every_registered_query_has_a_function():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 60
