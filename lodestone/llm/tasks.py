"""What several operators share: Python over Arrow batches, and cutting lineage in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _batches(batches: Iterator[pa.RecordBatch], kept: list[str], texts: list[str], start: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    made = start()
    for batch in batches:
        rows = [made(*r) for r in zip(*(batch.column(t).to_pylist() for t in texts), strict=True)]
        new = list(zip(*rows, strict=True)) if rows else [[]] * (len(schema) - len(kept))
        arrays = [batch.column(k).cast(schema.field(i).type) for i, k in enumerate(kept)]
        arrays += [pa.array(v, schema.field(len(kept) + i).type) for i, v in enumerate(new)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        del rows, new, arrays
    del made  # the worker goes on to other stages, without what this one needed
    gc.collect()
    pa.default_memory_pool().release_unused()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Holds the session's Arrow batches to so many rows: a worker keeps a batch of texts several times over, and with
    Spark's 10,000 rows of long texts two workers and their JVM don't fit a small executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def _with(rows: DataFrame, kept: list[str], columns: str) -> T.StructType:
    return T.StructType([rows.schema[k] for k in kept] + T.StructType.fromDDL(columns).fields)


def per_row(rows: DataFrame, kept: list[str], texts: list[str], columns: str, start: Callable) -> DataFrame:
    """The columns `kept` of each row as they are, and new `columns` (a DDL string) that start()(*texts) returns as a
    tuple. start runs once a task; kept columns stay in Arrow, so that nulls and 64-bit ids lose nothing."""
    bounded_batches(rows.sparkSession)
    schema = _with(rows, kept, columns)
    run = partial(_batches, kept=kept, texts=texts, start=start, schema=to_arrow_schema(schema))
    return rows.select(*dict.fromkeys([*kept, *texts])).mapInArrow(run, schema)


def boxed(rows: DataFrame, without: tuple[str, ...] = (), **named: str) -> DataFrame:
    """A struct `given` of the rows' columns, but for those in `without`, beside the columns of `named` under the names
    given there: so the names of a caller's columns, whatever they are, don't meet those of an operator's own."""
    given = [F.col(f"`{c}`") for c in rows.columns if c not in without] or [F.lit(None).cast("int").alias("none")]
    return rows.select(F.struct(*given).alias("given"), *(F.col(f"`{c}`").alias(name) for name, c in named.items()))


def unboxed(columns: list[str], **new: Column) -> list[Column]:
    """The columns of boxed() rows in their order, those in `new` with their new values."""
    return [(new[c] if c in new else F.col(f"given.`{c}`")).alias(c) for c in columns]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where that is unset, a session on one
    machine, as in tests, gets a temporary one; on a cluster, whose executors would not share it, it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def written(rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written once as a Parquet table in the shared folder, and the path of that table."""
    path = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written once as a Parquet table in the shared folder: for wide rows or many, which take less disk so."""
    return written(rows)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def per_likely_row(rows: DataFrame, key: str, wanted: DataFrame, kept: list[str], texts: list[str], columns: str, start: Callable, most_bits: int = 1 << 30) -> DataFrame:
    """per_row() of the rows whose key occurs in the column `key` of `wanted`, and of a few others: a filter on the scan,
    for a join that follows. Its bitmap has about 16 bits for each wanted key and at most `most_bits`, 128 MB; with more
    keys than that more rows pass, and the join still decides. One Python worker both filters and makes the columns: as
    two steps they would take two for each task, which stay for the stages that follow."""
    bounded_batches(rows.sparkSession)
    n = wanted.count()
    bits = 1 << min(max(16, (16 * n).bit_length()), most_bits.bit_length() - 1)
    slot = F.xxhash64(key).bitwiseAND(F.lit(bits - 1)) + 1
    bitmap = np.zeros(bits // 8, np.uint8)
    parts = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    parts = stored(parts)  # else each shuffle partition is a job of its own, however small
    for part in parts.toLocalIterator():
        at = (part["part"] - 1) * 4096
        bitmap[at : at + 4096] |= np.frombuffer(part["bits"], np.uint8)[: bits // 8 - at]
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)
    schema = _with(rows, kept, columns)
    made = partial(_batches, kept=kept, texts=texts, start=start, schema=to_arrow_schema(schema))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot__").to_numpy()
            yield batch.filter(pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return rows.select(*dict.fromkeys([*kept, *texts]), (slot - 1).alias("slot__")).mapInArrow(lambda batches: made(passing(batches)), schema)


def join_uneven(rows: DataFrame, table: DataFrame, keys: list[str], n_rows: int, size: str = "n", most: int = 50_000) -> DataFrame:
    """Inner join of `rows` to `table`, which has one row for each key and, as `size`, how many of the `n_rows` rows
    have that key. The rows of keys above a limit don't move: those keys are broadcast. The limit grows with n_rows so
    that there are never more than `most` such keys, since their sizes add up to no more than n_rows."""
    limit = max(1024, -(-n_rows // most))
    if n_rows <= limit:
        return rows.join(table, keys)
    frequent = F.broadcast(table.filter(F.col(size) > limit))
    rare = rows.join(frequent.select(*keys), keys, "left_anti").join(table.filter(F.col(size) <= limit), keys)
    return rare.unionByName(rows.join(frequent, keys))
