"""Structured Streaming: incremental loads, audit windows, and answer frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def landed(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def load_new(stream: DataFrame, target: str, checkpoint: str, key: str) -> None:
    """Appends the stream's rows to a Parquet table, each key once, and returns when all that has landed is in. Keys seen
    are the stream's state, so a batch doesn't read the table; with the checkpoint a later call goes on from there, and
    the file sink's log keeps a batch that is run again from adding anything twice."""
    run(stream.dropDuplicates([key]), target, checkpoint)


def run(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Appends a stream to a Parquet table and returns when all that has landed is in."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, made: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Writes made(batch), a batch plan, for each batch of a stream; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, if its repeats come within the watermark, after which its key is forgotten."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.dropDuplicatesWithinWatermark([key]).drop("at")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n of windows that overlap."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, started, ended, n: sessions that a pause of at least `gap` ends, for a stream as for a batch."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy("user_id", F.session_window("at", gap)).agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("n")).drop("session_window")


def longest_runs(events: DataFrame) -> DataFrame:
    """user_id, seen, longest after each batch: how many events of a user came, and the longest run of one event_type
    among them by ts and event_id. The state of a user is the last type, its run, the longest one and the count; events
    of a user are taken in the order of the batches, and within a batch in that of time."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, run_, longest, seen = state.get if state.exists else ("", 0, 0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        kinds = rows["event_type"]
        number = (kinds != kinds.shift()).cumsum()
        sizes = kinds.groupby(number).size()
        first = int(sizes.iloc[0]) + (run_ if kinds.iloc[0] == last else 0)
        longest = max(longest, first, int(sizes.max()))
        run_ = first if len(sizes) == 1 else int(sizes.iloc[-1])
        seen += len(rows)
        state.update((kinds.iloc[-1], run_, longest, seen))
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "longest": [longest]})

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("event_type", F.lit("")).alias("event_type"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, seen long, longest long", "last string, run long, longest long, seen long", "update", "NoTimeout")


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, event_type, n over a watermark, for a stream as for a batch."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def frames(answers: DataFrame, size: int = 200) -> DataFrame:
    """query_id, seq, type, content: the frames of each answer in the order thinking, searching, chunk…, done. answers:
    query_id, answer, references (text)."""
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("answer") / F.lit(size)).cast("int") - 1, F.lit(0)))
    one = lambda kind, content: F.array(F.struct(F.lit(kind).alias("type"), content.alias("content")))
    chunks = F.transform(at, lambda i: F.struct(F.lit("chunk").alias("type"), F.substring("answer", i * size + 1, F.lit(size)).alias("content")))
    rows = F.concat(one("thinking", F.lit("")), one("searching", F.lit("")), chunks, one("done", F.col("references")))
    return answers.select("query_id", F.posexplode(rows).alias("seq", "f")).select("query_id", "seq", "f.type", "f.content")
