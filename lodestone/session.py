"""Sessions and tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library counts on; partitions are left to the cluster and to adaptive plans."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters are pushed into its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows, dealt out if their scan has fewer splits than there are cores, as that of a small file: texts are worth
    more work than their shuffle. Tables of many splits, as all large ones are, stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def dealt(rows: DataFrame, key: str, each: int = 4096) -> DataFrame:
    """The rows, dealt by the hash of a key into parts of about `each`. What is then grouped or joined by this key and
    others needs no further exchange, and the work of a task doesn't grow with the table."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-rows.count() // each)), key)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir; without that setting only a session on one
    machine has one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="shared-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, for plans that read them several times: with their lineage
    cut, they outlast the executors that made them. Spark removes the files with the frame where
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """As kept(), but as a Parquet table, for loops: a checkpoint keeps the constraints that its plan implies, and from
    turn to turn there are ever more of them for the optimiser to compare."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
