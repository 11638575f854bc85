"""Conversations as state: what was said before each turn, kept while a conversation lives and dropped when it ends.

The state of a conversation is a list of its last roles, a map of how often each role has spoken, the last text, and a
timer. A turn moves the timer to `idle` after its own time; when the watermark passes it, the conversation is closed and
its state deleted. State is in RocksDB and in the checkpoint, so a stream goes on where it stopped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "conv_id long, turn long, role string, nth long, said long, recent string, previous string, closed boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Conversation(StatefulProcessor):
    """Rows of OUT: one for each turn, and one for each conversation that ends, with its number of turns as nth."""

    def __init__(self, recent: int, idle_ms: int):
        self.recent, self.idle = recent, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.roles = handle.getListState("roles", "role string")
        self.counts = handle.getMapState("counts", "role string", "n long")
        self.last = handle.getValueState("last", "nth long, text string, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values(["turn", "at"], kind="stable")
        known = self.last.get() if self.last.exists() else None
        nth, text, until = known if known is not None else (0, None, None)
        roles = [r[0] for r in self.roles.get()] if self.roles.exists() else []
        counts = {r[0]: n[0] for r, n in self.counts.iterator()} if self.counts.exists() else {}
        out, latest = [], until
        for t in turns.itertuples(index=False):
            said = counts.get(t.role, 0)
            out.append((key[0], t.turn, t.role, nth + 1, said, ">".join(roles), text, False))
            nth, text, counts[t.role] = nth + 1, t.text, said + 1
            roles = [*roles, t.role][-self.recent :]
            ends = int(t.at.timestamp() * 1000) + self.idle
            latest = ends if latest is None else max(latest, ends)
        self.roles.put([(r,) for r in roles])
        for role in set(turns["role"]):
            self.counts.updateValue((role,), (counts[role],))
        self.last.update((nth, text, latest))
        if latest != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "nth", "said", "recent", "previous", "closed"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        nth = self.last.get()[0] if self.last.exists() else 0
        for state in (self.roles, self.counts, self.last):
            state.clear()
        row = {"conv_id": [key[0]], "turn": [0], "role": [""], "nth": [nth], "said": [0], "recent": [""], "previous": [None], "closed": [True]}
        yield pd.DataFrame(row)

    def close(self) -> None:
        pass


def tracked(turns: DataFrame, recent: int = 4, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The rows of OUT of a stream of turns (conv_id, turn, role, text, at), in the order in which batches bring them, and
    within a batch in that of turns. A null role counts as an empty one."""
    seconds = turns.sparkSession.sql(f"SELECT CAST(INTERVAL {idle} AS INTERVAL SECOND)").first()[0].total_seconds()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "text", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("conv_id").transformWithStateInPandas(Conversation(recent, int(seconds * 1000)), OUT, "append", "EventTime")


def context(turns: DataFrame, recent: int = 4) -> DataFrame:
    """The same of a batch: conv_id, turn, role, nth, said, recent, previous. Unlike all roles so far, the last few make
    rows of bounded length."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    role = F.coalesce("role", F.lit(""))
    said = F.count(F.lit(1)).over(Window.partitionBy("conv_id", role).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    before = F.array_join(F.collect_list(role).over(w.rowsBetween(-recent, -1)), ">")
    return turns.select("conv_id", "turn", role.alias("role"), F.row_number().over(w).cast("long").alias("nth"), said.alias("said"), before.alias("recent"), F.lag("text").over(w).alias("previous"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within have their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Appends tracked() turns to a Parquet table and returns when all that has landed is in. The process that sets the
    state up has none of the driver's import path, so this module is sent to it by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    with rocksdb(stream.sparkSession):
        tracked(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
