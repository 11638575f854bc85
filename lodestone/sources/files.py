"""Sources and sinks: landed files, test sets, experiment logs, the tables of the service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.embedding import embed
from lodestone.operators.retrieval import chunk

#: The tables of the service with fixed schemas.
TABLES = {
    "table_article_meta": "doc_id long, title string, authors string, year int, full_text string, collection string",
    "table_chunk": "doc_id long, chunk_no int, text string, n_tokens long",
    "table_test_set": "item_id long, text string",
    "table_eval_record": "run_id string, item_id long, metric string, value double",
    "table_memory_bank": "mem_id long, conv_id long, question string, answer string, hits long",
    "table_knowledge_gap": "query_id long, top_sim double, ts timestamp, status string",
    "table_strategy_opt": "strategy_id string, round int, metric double, accepted boolean",
    "table_reasoning_rule": "rule_id long, text string, support long, weight double",
    "table_audit_log": "event_id long, ts timestamp, user_id long, action string, risk int, detail string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def open_tables(spark: SparkSession, folder: str) -> None:
    """A temporary view for each table; one without files yet is empty."""
    for name in TABLES:
        try:
            rows = spark.read.schema(schema(name)).parquet(f"{folder}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = spark.createDataFrame([], schema(name))
        rows.createOrReplaceTempView(name)


def append(rows: DataFrame, folder: str, name: str) -> None:
    """Appends rows to a table with its columns and types."""
    rows.select(*(F.col(f.name).cast(f.dataType) for f in schema(name))).write.mode("append").parquet(f"{folder}/{name}")


def test_set(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """item_id, text of a JSON file that holds an array of records, or, with `lines`, a record a line."""
    return spark.read.schema(schema("table_test_set")).json(path, multiLine=not lines)


def write_log(rows: DataFrame, path: str) -> None:
    """An experiment log as JSON lines."""
    rows.write.mode("overwrite").json(path)


def xml_articles(spark: SparkSession, path: str, tag: str = "article") -> DataFrame:
    """doc_id, title, authors, year, full_text of landed XML articles."""
    wanted = "doc_id long, title string, authors string, year int, full_text string"
    return spark.read.schema(wanted).option("rowTag", tag).format("xml").load(path)


def rebuild_vectors(docs: DataFrame, path: str, size: int = 500, overlap: int = 0, **options) -> None:
    """The vector store anew, a folder for each collection: docs (doc_id, text, collection) are cut into chunks, and
    each chunk is embedded; columns doc_id, chunk_no, vector, collection. Options are those of embed()."""
    chunks = chunk(docs, size, overlap).join(docs.select("doc_id", "collection"), "doc_id")
    key = F.struct("doc_id", "chunk_no", "collection").alias("key")
    vectors = embed(chunks.select(key, "text"), "key", **options)
    vectors.select("id.doc_id", "id.chunk_no", "vector", "id.collection").write.mode("overwrite").partitionBy("collection").parquet(path)
