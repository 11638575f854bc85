import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import neardup, registry, secret_scan
from tests.llm.tables import documents, prose

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    docs = documents(spark).drop("kept").unionByName(spark.createDataFrame([(50 + i, f"{prose(60 + i, 90)} password=b7db7aa4a5fcc7{i:04d}", "en", "d", 0) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long"))
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert {50 + i for i in range(30)} <= {r.doc_id for r in at.select("doc_id").collect()}
    assert at.filter(F.col("text").rlike("password=[0-9a-f]{18}")).count() == 0 and at.filter(F.length("text") != F.col("n_chars")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert last.count() == at.count() and last.filter("n_tokens < 3").count() == 0


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    count = lambda d: sorted((r.doc_id, r.n_tokens, r["count"]) for r in d.groupBy("doc_id", "n_tokens").count().collect())
    assert count(corpus_pipeline.run(spark, SF)) == count(docs)


def test_preference_twin(spark):
    got = registry.op1_preference_pairs(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = con.execute(registry.oracle_sql()["op1_preference_pairs"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_near_duplicates_take_one_python_worker_a_task(spark):
    """Two Python steps in one stage would hold two workers for each task, in that stage and after it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert kept.count() == neardup.near_classes(docs).select("class_key").distinct().count()


def test_the_forest_is_fitted_once_in_an_application(spark, monkeypatch):
    forest = secret_scan.default_forest(spark)
    monkeypatch.setattr(secret_scan, "train", None)
    assert secret_scan.default_forest(spark) == forest
