import pytest
from pyspark.sql import functions as F

from lodestone.streaming import conversations, incremental

SCHEMA = "conv_id long, turn long, role string, text string, at timestamp"


def turns(spark, rows):
    """rows: conv_id, turn, role, text, minute."""
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, minute long")
    return frame.withColumn("at", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000)).drop("minute")


def land(spark, rows, folder):
    turns(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def run(spark, at):
    conversations.run(incremental.landed(spark, f"{at}/landed", turns(spark, [(1, 0, "", "", 0)]).schema), f"{at}/target", f"{at}/progress")
    return spark.read.schema(conversations.OUT).parquet(f"{at}/target")


def plain(rows):
    return sorted((tuple(r) for r in rows.select("conv_id", "turn", "role", "nth", "said", "recent", "previous").collect()), key=repr)


def alive(spark, at):
    """Conversations with state of each kind."""
    rows = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{at}/progress")
    return {name: {r.key.conv_id for r in rows(name).select("key").collect()} for name in ("last", "counts", "roles")}


FIRST = [(1, 0, "system", "s", 0), (1, 1, "user", "a", 1), (2, 0, "user", "x", 1), (1, 2, "assistant", "b", 2), (3, 0, None, None, 2)]
SECOND = [(1, 3, "user", "c", 5), (1, 4, "assistant", "", 6), (2, 1, "assistant", "y", 7), (1, 5, "user", "d", 8)]


def test_a_restart_equals_a_batch(spark, tmp_path):
    land(spark, FIRST, f"{tmp_path}/landed")
    run(spark, tmp_path)
    land(spark, SECOND, f"{tmp_path}/landed")
    found = run(spark, tmp_path)
    want = plain(conversations.context(turns(spark, FIRST + SECOND)))
    assert plain(found.filter("not closed")) == want and len(want) == 9
    assert (1, 5, "user", 6, 2, "user>assistant>user>assistant", "") in want
    assert alive(spark, tmp_path) == {"last": {1, 2, 3}, "counts": {1, 2, 3}, "roles": {1, 2, 3}}


def test_expired_conversations_leave_no_state(spark, tmp_path):
    land(spark, FIRST + SECOND, f"{tmp_path}/landed")
    run(spark, tmp_path)
    land(spark, [(9, 0, "user", "late", 100), (2, 2, "user", "z", 99)], f"{tmp_path}/landed")
    run(spark, tmp_path)
    land(spark, [(9, 1, "user", "later", 101)], f"{tmp_path}/landed")
    closed = {r.conv_id: r.nth for r in run(spark, tmp_path).filter("closed").collect()}
    assert closed == {1: 6, 3: 1}
    assert all(found == {2, 9} for found in alive(spark, tmp_path).values())


def test_the_setting_of_the_state_is_put_back(spark):
    before = spark.conf.get(conversations.PROVIDER, None)
    with pytest.raises(RuntimeError), conversations.rocksdb(spark):
        assert "RocksDB" in spark.conf.get(conversations.PROVIDER)
        raise RuntimeError
    assert spark.conf.get(conversations.PROVIDER, None) == before
