import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.operators import agent


def test_settings_from_the_environment():
    assert config.from_env({}) == config.Settings()
    given = config.from_env({"LODESTONE_K": "5", "LODESTONE_THRESHOLD": "0.5", "LODESTONE_RERANK": "false", "LODESTONE_EMBEDDINGS": "1", "K": "9"})
    assert given == config.Settings(k=5, threshold=0.5, rerank=False, embeddings=True)
    for bad in ({"LODESTONE_K": "x"}, {"LODESTONE_RERANK": "maybe"}, {"LODESTONE_K": "0"}, {"LODESTONE_CANDIDATES": "5"}):
        with pytest.raises(ValueError):
            config.from_env(bad)


def test_the_service_goes_by_its_settings(spark):
    docs = spark.createDataFrame([(1, "the salt and the pressure", "src0"), (2, "salt", "src1"), (3, "the sea", "src2"), (4, "pressure of the sea", "src0")], "doc_id long, text string, source string")
    outside = spark.createDataFrame([(1, "the salt")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "the salt pressure"), (8, "nothing of note")], "query_id long, text string")
    plainly = agent.answer(asked, docs, outside).withColumn("references", F.to_json("references"))
    same = agent.answer_with(config.Settings(), asked, docs, outside).withColumn("references", F.to_json("references"))
    assert sorted(map(tuple, same.collect()), key=repr) == sorted(map(tuple, plainly.collect()), key=repr)
    lean = agent.answer_with(config.Settings(embeddings=False, rerank=False, k=2, candidates=3), asked, docs, outside).collect()
    assert {r.query_id: r.status for r in lean}[8] == "refused" and all(len(r.references) <= 2 for r in lean)
    ranked = agent.local_search(asked.limit(1), docs, vectors=False, rescored=False).orderBy("rank").collect()
    # the highest scaled score is 1 and has the weight of its collection
    assert ranked[0].doc_id == 1 and ranked[0].score == pytest.approx(1.5)
